"""From flows and adjacency to a weighted, normalized graph.

The zone table takes part in most joins. It is broadcast only after its rows were counted and found
to be at most ``BROADCAST_ZONES``; beyond that the joins are by shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .ordering import percentile, weighted_quantile

#: A zone's row of a broadcast is about 100 bytes.
BROADCAST_ZONES = 300_000
#: Distances between zones count at least this.
LEAST_DISTANCE = 0.001


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ZONES rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ZONES else df


def flow_edges(flows: DataFrame, zones: DataFrame) -> DataFrame:
    """``origin, destin, flow, dist`` of the flows above 0 between two different known zones, row by row."""
    rows = zones.count()
    from_, to = (small(zones.select(F.col("zone_id").alias(end), F.col("XCoord").alias(f"{end}_x"), F.col("YCoord").alias(f"{end}_y")), rows) for end in ("origin", "destin"))
    dist = F.greatest(F.hypot(F.col("origin_x") - F.col("destin_x"), F.col("origin_y") - F.col("destin_y")), F.lit(LEAST_DISTANCE))
    kept = flows.where("origin <> destin and flow > 0")
    return kept.join(from_, "origin").join(to, "destin").select("origin", "destin", "flow", dist.alias("dist"))


def median_distance(edges: DataFrame) -> float | None:
    """The flow-weighted median distance."""
    return weighted_quantile(edges, "dist", "flow", 0.5)


def flow_weights(edges: DataFrame, median: float) -> DataFrame:
    """``edges`` with ``w``: the log of the flow, halved for each median distance."""
    median = 1.0 if median < 1e-6 else median
    return edges.withColumn("w", F.log1p("flow") * F.pow(F.lit(0.5), F.col("dist") / F.lit(median)))


@dataclass(frozen=True)
class Weights:
    """Weighted flow edges ``origin, destin, flow, dist, w``, the median distance and the glue."""

    edges: DataFrame
    median: float
    glue: float


def weighted_flows(flows: DataFrame, zones: DataFrame, glue: float | None = None, glue_percentile: float = 75.0) -> Weights:
    """Weights of the flows, and the glue: as given, or a percentile of the weights."""
    edges = materialize(flow_edges(flows, zones), "flow_edges")
    median = median_distance(edges)
    if median is None:
        raise RuntimeError("no flow above 0 between two known zones; check the flow columns and the zone ids")
    weighted = flow_weights(edges, median)
    return Weights(weighted, median, float(glue) if glue is not None else percentile(weighted, "w", glue_percentile))


def known_neighbours(adj: DataFrame, zones: DataFrame) -> DataFrame:
    """The adjacency rows of two different known zones; repeated rows stay."""
    ids = zones.select("zone_id")
    count = ids.count()
    for end in ("focal", "neighbor"):
        adj = adj.join(small(ids.withColumnRenamed("zone_id", end), count), end, "left_semi")
    return adj.where("focal <> neighbor").select("focal", "neighbor")


def symmetric_edges(weighted: DataFrame, neighbours: DataFrame, glue: float) -> DataFrame:
    """``src, dst, w``: flow weights and glue, each in both directions, summed per pair."""
    one_way = weighted.select(F.col("origin").alias("src"), F.col("destin").alias("dst"), "w").unionByName(neighbours.select(F.col("focal").alias("src"), F.col("neighbor").alias("dst"), F.lit(float(glue)).alias("w")))
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return one_way.select(both.alias("e"), "w").select("e.src", "e.dst", "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def self_loops(zones: DataFrame, glue: float) -> DataFrame:
    """A loop of the glue's weight on every zone."""
    return zones.select(F.col("zone_id").alias("src"), F.col("zone_id").alias("dst"), F.lit(float(glue)).alias("w"))


def normalized(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """Each weight over the root of its ends' degrees (sums of incoming weights); 0 where a degree is not above 0. ``nodes`` is their number, counted if not given."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("deg"))
    inverse = degree.select("node", F.when(F.col("deg") > 0, 1 / F.sqrt("deg")).otherwise(0.0).alias("r"))
    rows = inverse.count() if nodes is None else nodes
    src, dst = (small(inverse.select(F.col("node").alias(end), F.col("r").alias(f"r_{end}")), rows) for end in ("src", "dst"))
    return edges.join(src, "src").join(dst, "dst").select("src", "dst", (F.col("w") * F.col("r_src") * F.col("r_dst")).alias("w"))


def build_graph(weighted: DataFrame, adj: DataFrame, zones: DataFrame, glue: float, times: int = 2) -> DataFrame:
    """The propagation operator: symmetric edges and loops, normalized ``times`` times. Twice is what a
    convolution that normalizes by itself makes of weights that are already normalized."""
    edges = materialize(symmetric_edges(weighted, known_neighbours(adj, zones), glue).unionByName(self_loops(zones, glue)), "edges")
    nodes = zones.count()
    for i in range(times):
        edges = normalized(edges, nodes)
        # the next round reads the edges twice, for the degrees and for the weights
        if i < times - 1:
            edges = materialize(edges, "normalized")
    return edges
