"""Flow metrics of an assignment of zones to clusters, from sums over the directed flows alone.

The modularity term of a cluster is its internal flow over all flow, less the square of its degree over
twice all flow; that equals the term of the symmetrized flow matrix, which is never made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flow_graph import small
from .prepare import as_double


def known_flows(flows: DataFrame, zones: DataFrame) -> DataFrame:
    """Flows summed per pair of known zones; self-flows stay."""
    ids = zones.select("zone_id")
    rows = ids.count()
    for end in ("origin", "destin"):
        flows = flows.join(small(ids.withColumnRenamed("zone_id", end), rows), end, "left_semi")
    return flows.groupBy("origin", "destin").agg(F.sum("flow").alias("flow"))


def node_flows(flows: DataFrame) -> DataFrame:
    """``zone_id, out, inn, deg``: outgoing and incoming flow of each zone that has any, and their sum."""
    ends = F.explode(F.array(F.struct(F.col("origin").alias("zone_id"), F.col("flow").alias("out"), F.lit(0.0).alias("inn")), F.struct(F.col("destin").alias("zone_id"), F.lit(0.0).alias("out"), F.col("flow").alias("inn"))))
    return flows.select(ends.alias("e")).select("e.*").groupBy("zone_id").agg(F.sum("out").alias("out"), F.sum("inn").alias("inn")).withColumn("deg", F.col("out") + F.col("inn"))


def total_flow(flows: DataFrame) -> float:
    """All flow; 1 if there is none."""
    return flows.agg(F.sum("flow")).first()[0] or 1.0


def cluster_flows(flows: DataFrame, part: DataFrame) -> DataFrame:
    """``cluster, internal, out, deg``: flow within the cluster, and of its members. ``part`` is ``zone_id, cluster``."""
    rows = part.count()
    o, d = (small(part.select(F.col("zone_id").alias(end), F.col("cluster").alias(f"c_{end}")), rows) for end in ("origin", "destin"))
    placed = flows.join(o, "origin", "left").join(d, "destin", "left")
    same = F.col("c_origin") == F.col("c_destin")
    ends = F.array(
        F.struct(F.col("c_origin").alias("cluster"), F.when(same, F.col("flow")).otherwise(0.0).alias("internal"), F.col("flow").alias("out"), F.col("flow").alias("deg")),
        F.struct(F.col("c_destin").alias("cluster"), F.lit(0.0).alias("internal"), F.lit(0.0).alias("out"), F.col("flow").alias("deg")),
    )
    found = placed.select(F.explode(ends).alias("e")).select("e.*").where("cluster is not null").groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("internal", "out", "deg")])
    none = part.select("cluster").distinct()
    return none.join(found, "cluster", "left").na.fill(0.0, ["internal", "out", "deg"])


def modularity_terms(flows: DataFrame, part: DataFrame, m: float | None = None) -> DataFrame:
    """``cluster, internal, out, deg, term, li``: modularity term and localization index of each cluster."""
    m = total_flow(flows) if m is None else m
    term = F.col("internal") / F.lit(m) - F.pow(F.col("deg") / F.lit(2 * m), F.lit(2.0))
    li = F.when(F.col("out") > 0, F.col("internal") / F.col("out")).otherwise(0.0)
    return cluster_flows(flows, part).withColumns({"term": term, "li": li})


def total_modularity(flows: DataFrame, part: DataFrame, m: float | None = None) -> float:
    """The sum of the terms; zones that no flow knows and flows of zones without cluster don't count."""
    return modularity_terms(flows, part, m).agg(F.sum("term")).first()[0] or 0.0


def cluster_attributes(zones: DataFrame, part: DataFrame, columns: list[str]) -> DataFrame:
    """``cluster, n_zones`` and per column sum, min and max; missing values are skipped: without any the sum is 0 and
    min and max are NaN."""
    value = {c: F.when(~F.isnan(as_double(zones, c)), as_double(zones, c)) for c in columns}
    picked = zones.select("zone_id", *[v.alias(f"v{i}") for i, v in enumerate(value.values())]).join(part.select("zone_id", "cluster"), "zone_id")
    nan = F.lit(float("nan"))
    aggs = [a for i, c in enumerate(columns) for a in (F.coalesce(F.sum(f"v{i}"), F.lit(0.0)).alias(f"{c}_sum"), F.coalesce(F.min(f"v{i}"), nan).alias(f"{c}_min"), F.coalesce(F.max(f"v{i}"), nan).alias(f"{c}_max"))]
    return picked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_zones"), *aggs)


def over_caps(zones: DataFrame, part: DataFrame, caps: dict[str, float]) -> DataFrame:
    """``cluster`` and the sum of each capped column, of the clusters above any cap; missing values count 0."""
    value = [F.coalesce(F.when(~F.isnan(as_double(zones, c)), as_double(zones, c)), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(caps)]
    sums = zones.select("zone_id", *value).join(part.select("zone_id", "cluster"), "zone_id").groupBy("cluster").agg(*[F.sum(f"v{i}").alias(c) for i, c in enumerate(caps)])
    above = [F.col(c) > F.lit(float(v)) for c, v in caps.items()]
    return sums.where(reduce(lambda a, b: a | b, above, F.lit(False)))


def cluster_count(part: DataFrame) -> int:
    """How many clusters there are; zones without one don't count."""
    return part.agg(F.countDistinct("cluster")).first()[0]
