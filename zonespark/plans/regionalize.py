"""The two stages, embed and partition, and the pipeline that runs both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_degrees
from ..operators import diffuse, flow_graph, partition
from ..operators.compact import compactness, dissolved
from ..operators.contiguity import contiguity
from ..operators.features import features
from ..operators.metrics import cluster_attributes, known_flows, modularity_terms, total_modularity
from ..operators.prepare import ORDER, adjacency_of, embedding_zones, flows_of, in_row_order, key_of, located_zones, partition_zones, unique_zones
from ..operators.ordering import number_rows
from ..operators.validate import check_adjacency, check_flows
from .config import BACKBONES, Constraint, EmbeddingConfig, PartitionConfig, PipelineConfig, check_constraints, hospital_column, partition_config, population_column_of
from .runtime import materialize

Layers = Sequence[tuple[np.ndarray, np.ndarray]]


def embed_zones(zones: DataFrame, flows: DataFrame, adj: DataFrame, cfg: EmbeddingConfig | None = None, layers: Layers | None = None) -> DataFrame:
    """``ZoneID, Emb_X, Emb_Y`` from normal tables: ``zones`` with ``zone_id, row_ord, XCoord, YCoord``, ``flows`` with
    ``origin, destin, flow``, ``adj`` with ``focal, neighbor``. ``layers`` are the weights of the gcn backbone."""
    cfg = cfg or EmbeddingConfig()
    backbone = str(cfg.backbone).lower()
    if backbone not in BACKBONES:
        raise ValueError(f"unknown backbone {cfg.backbone!r}; one of {', '.join(BACKBONES)}")
    zones = materialize(located_zones(zones), "zones")
    weights = flow_graph.weighted_flows(flows, zones, cfg.spatial_glue, cfg.w_adj_percentile)
    operator = flow_graph.build_graph(weights.edges, adj, zones, weights.glue)
    try:
        hospital = hospital_column(zones)
    except KeyError:
        hospital = None
    values, names = features(zones, flows, cfg.feature_mode, hospital)
    if backbone == "sgcn":
        return diffuse.sgcn(operator, values, names, cfg.k_hops)
    sizes = [len(names), *[cfg.gcn_hidden] * (cfg.gcn_layers - 1), 2]
    return diffuse.gcn(operator, values, names, layers or diffuse.glorot(sizes, cfg.seed))


def build_embedding(coords: DataFrame, flows: DataFrame, adj: DataFrame, cfg: EmbeddingConfig | None = None, origin: str | None = None, destin: str | None = None, flow: str | None = None, layers: Layers | None = None) -> DataFrame:
    """Embedding of a table that has ``ZoneID, XCoord, YCoord``; ends of flows and adjacency that are no zones are left out."""
    zones = in_row_order(coords).withColumn("zone_id", key_of(coords, "ZoneID"))
    return embed_zones(zones, flows_of(flows, origin, destin, flow), adjacency_of(adj), cfg, layers)


class Embedder:
    """Embed zones by their flows: checks on construction, ``embed`` gives the table with two columns more."""

    def __init__(self, coords: DataFrame, flows: DataFrame, id_column: str | None = None, w: DataFrame | str = "queen", k_hops: int = 5, w_adj_percentile: float = 75.0, origin: str | None = None, destin: str | None = None, flow: str | None = None, coordxy: str | None = None):
        self.coords, self.id_column = in_row_order(coords), id_column
        self.config = EmbeddingConfig(k_hops=k_hops, w_adj_percentile=w_adj_percentile)
        self.zones = materialize(embedding_zones(self.coords, id_column, coordxy), "zones")
        self.flows = flows_of(flows, origin, destin, flow)
        check_flows(self.flows, self.zones)
        self.adj = contiguity(self.zones, w)
        if isinstance(w, DataFrame):
            check_adjacency(self.adj, self.zones)

    def embed(self, x_column: str = "Emb_X", y_column: str = "Emb_Y") -> DataFrame:
        """All rows of the zone table as given, with the embedding of their zone; null where a zone has no coordinates."""
        taken = [c for c in (x_column, y_column) if c in self.coords.columns]
        if taken:
            raise ValueError(f"the zone table already has {', '.join(taken)}")
        made = embed_zones(self.zones, self.flows, self.adj, self.config)
        return attach(self.coords, self.id_column, made.select(F.col("ZoneID").alias("_zone"), F.col("Emb_X").alias(x_column), F.col("Emb_Y").alias(y_column)))


def attach(rows: DataFrame, id_column: str | None, found: DataFrame) -> DataFrame:
    """Left join of the rows as given, each of them kept, with ``found`` on the normal form of their id: ``_zone`` in ``found``."""
    if id_column is None:
        keyed = number_rows(rows, [ORDER], "_place").withColumn("_zone", F.col("_place").cast("string")).drop("_place")
    else:
        keyed = rows.withColumn("_zone", key_of(rows, id_column))
    return keyed.join(found, "_zone", "left").drop("_zone")


@dataclass(frozen=True)
class PartitionResult:
    """``cluster``: the zone table as given with its cluster; ``result``: one row per cluster; ``modularity`` of all;
    ``part``: ``ZoneID, Community_ID, Comm_Pop, Comm_Hosp, Comm_LI`` per zone."""

    cluster: DataFrame
    result: DataFrame
    modularity: float
    part: DataFrame


def partition_zones_table(zones: DataFrame, flows: DataFrame, adj: DataFrame, embedding: DataFrame, cfg: PartitionConfig, local: bool | None = None) -> tuple[DataFrame, float]:
    """``ZoneID, Community_ID, Comm_Pop, Comm_Hosp, Comm_LI`` per zone from normal tables, and all flow."""
    problem = partition.pose(zones, flows, adj, embedding, cfg)
    label = materialize(partition.solve(problem, local), "label")
    sums = problem.nodes.join(label, "zone_id").groupBy("cluster").agg(F.sum("popu").alias("Comm_Pop"), F.sum("hosp").alias("Comm_Hosp"))
    li = modularity_terms(known_flows(flows, zones), label, problem.m).select("cluster", F.col("li").alias("Comm_LI"))
    part = label.join(sums, "cluster").join(li, "cluster")
    return part.select(F.col("zone_id").alias("ZoneID"), F.col("cluster").cast("int").alias("Community_ID"), "Comm_Pop", "Comm_Hosp", "Comm_LI"), problem.m


def partition_table(embedding: DataFrame, flows: DataFrame, adj: DataFrame, coords: DataFrame, cfg: PartitionConfig | None = None, local: bool | None = None) -> tuple[DataFrame, DataFrame, float]:
    """The partition of a table that has ``ZoneID`` and the population column, by an embedding with ``ZoneID`` and the two
    columns the settings name; the flows between its zones summed per pair, and all flow. Ids are not checked: ends
    of flows and adjacency that are no zones are left out."""
    cfg = cfg or PartitionConfig()
    for c in ("ZoneID", cfg.embedding_x_col, cfg.embedding_y_col):
        if c not in embedding.columns:
            raise KeyError(c)
    zones = materialize(unique_zones(coords), "zones")
    moves = flows_of(flows, cfg.origin_col, cfg.destin_col, cfg.flow_col)
    places = in_row_order(embedding).select(key_of(embedding, "ZoneID").alias("zone_id"), ORDER, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in ((cfg.embedding_x_col, "emb_x"), (cfg.embedding_y_col, "emb_y"))])
    part, m = partition_zones_table(zones, moves, adjacency_of(adj), places, cfg, local)
    return materialize(part, "part"), known_flows(moves, zones), m


class Partitioner:
    """Cut zones into clusters under constraints: checks on construction, ``partition`` gives the result."""

    def __init__(
        self, coords: DataFrame, flows: DataFrame, id_column: str | None = None, emb: tuple[str, str] = ("Emb_X", "Emb_Y"), w: DataFrame | str = "queen", constraints: Sequence[Constraint] = (), min_local_index: float = 0.3,
        population_column: str | None = None, hospital_column: str | None = None, origin: str | None = None, destin: str | None = None, flow: str | None = None, cluster_column: str = "cluster", degrees: bool = False, crs: str | None = None,
    ):
        constraints = list(constraints or [])
        missing = [c for c in emb if c not in coords.columns]
        if missing:
            raise KeyError(f"no column {', '.join(missing)}")
        check_constraints(constraints, coords)
        self.coords, self.id_column, self.cluster_column, self.degrees = in_row_order(coords), id_column, cluster_column, degrees or (crs is not None and in_degrees(crs))
        self.zones = materialize(partition_zones(self.coords, id_column), "zones")
        self.flows = flows_of(flows, origin, destin, flow)
        check_flows(self.flows, self.zones)
        self.adj = contiguity(self.zones, w)
        if isinstance(w, DataFrame):
            check_adjacency(self.adj, self.zones)
        self.embedding = self.zones.select("zone_id", ORDER, F.col(emb[0]).cast("double").alias("emb_x"), F.col(emb[1]).cast("double").alias("emb_y"))
        self.constraints = constraints
        self.config = partition_config(constraints, population_column or population_column_of(constraints), hospital_column, min_local_index, origin, destin, flow)

    def partition(self, local: bool | None = None) -> PartitionResult:
        """Clusters of every zone, metrics of every cluster, and the modularity of all."""
        part, m = partition_zones_table(self.zones, self.flows, self.adj, self.embedding, self.config, local)
        part = materialize(part, "part")
        label = part.select(F.col("ZoneID").alias("zone_id"), F.col("Community_ID").alias("cluster"))
        q = total_modularity(known_flows(self.flows, self.zones), label, m)
        cluster = attach(self.coords, self.id_column, label.select(F.col("zone_id").alias("_zone"), F.col("cluster").alias(self.cluster_column)))
        wanted = {c for c, _, _ in self.constraints} | {self.config.population_column, self.config.hospital_column}
        return PartitionResult(cluster, per_cluster(self.zones, part, [c for c in wanted if c], self.degrees), q, part)


def per_cluster(zones: DataFrame, part: DataFrame, columns: Sequence[str], degrees: bool = False) -> DataFrame:
    """One row per cluster of ``part`` (``ZoneID, Community_ID, Comm_..``), in order: number of zones, the cluster's own values,
    sum, least and greatest of each of ``columns`` that ``zones`` has, by name, compactness, and the dissolved shape if there are shapes."""
    columns = sorted(set(columns) & set(zones.columns))
    label = part.select(F.col("ZoneID").alias("zone_id"), F.col("Community_ID").alias("cluster"))
    each = part.groupBy(F.col("Community_ID").alias("cluster")).agg(*[F.first(c).alias(c) for c in ("Comm_LI", "Comm_Pop", "Comm_Hosp")])
    result = cluster_attributes(zones, label, columns).join(each, "cluster")
    ordered = ["cluster", "n_zones", "Comm_LI", "Comm_Pop", "Comm_Hosp", *[f"{c}_{a}" for c in columns for a in ("sum", "min", "max")]]
    nan = F.lit(float("nan"))
    if "geometry" not in zones.columns:
        return result.select(*ordered, nan.alias("reock"), nan.alias("polsby_popper")).orderBy("cluster")
    shapes = zones.select("zone_id", "geometry").join(label, "zone_id")
    measures = compactness(shapes, degrees=degrees).select("cluster", "reock", "polsby_popper")
    return result.join(measures, "cluster", "left").join(dissolved(shapes), "cluster", "left").select(*ordered, F.coalesce("reock", nan).alias("reock"), F.coalesce("polsby_popper", nan).alias("polsby_popper"), "geometry").orderBy("cluster")


@dataclass(frozen=True)
class PipelineResult:
    """What the pipeline made: embedding, partition, the flows it summed, all flow and the modularity."""

    embedding: DataFrame
    part: DataFrame
    flows: DataFrame
    total_flow: float
    modularity: float


def run_pipeline(coords: DataFrame, flows: DataFrame, adj: DataFrame, cfg: PipelineConfig | None = None) -> PipelineResult:
    """Embed and partition a table that has ``ZoneID, XCoord, YCoord`` and the population column, without checks of
    ids: ends of flows and adjacency that are no zones are left out. Named flow columns reach the second stage alone."""
    cfg = cfg or PipelineConfig()
    coords = in_row_order(coords)
    embedding = materialize(build_embedding(coords, flows, adj, cfg.embedding), "embedding")
    part, pairs, m = partition_table(embedding, flows, adj, coords, cfg.partition)
    label = part.select(F.col("ZoneID").alias("zone_id"), F.col("Community_ID").alias("cluster"))
    return PipelineResult(embedding, part, pairs, m, total_modularity(pairs, label, m))
