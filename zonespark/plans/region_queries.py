"""Queries of the regionalization operators, with the SQL that states the same results.

Two kinds of input: a grid world made of the star-schema tables (customers are residents, suppliers
hospitals, line items flows; flows stay within a radius), and the written zone, flow and adjacency tables
themselves, keyed by zone key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import centroid, polygon_area
from ..functions.keys import is_number, norm_zone_key, zone_key
from ..operators import compact, contiguity, diffuse, features, flow_graph, forest, metrics, partition, prepare, validate
from ..sources.tables import table
from .config import EmbeddingConfig, PartitionConfig
from .regionalize import Partitioner, attach, embed_zones, partition_zones_table
from .runtime import materialize


@dataclass(frozen=True)
class Grid:
    """A world of side x side zones; suppliers are spread by ``spread``, flows reach at most ``radius``."""

    side: int
    spread: int
    radius: int


F1, F2 = Grid(5, 1, 2), Grid(20, 7, 4)


@dataclass(frozen=True)
class World:
    zones: DataFrame
    flows: DataFrame
    adj: DataFrame


def world(spark: SparkSession, folder: str, grid: Grid) -> World:
    """The grid world of a data folder. ``popu`` is the number of customers of a zone, ``hosp`` whether it has a supplier."""
    n, g = grid.side**2, grid.side
    customer, supplier, orders, lineitem = (table(spark, folder, t) for t in ("customer", "supplier", "orders", "lineitem"))
    cz = customer.groupBy((F.col("c_custkey") % n).alias("zid")).agg(F.count(F.lit(1)).cast("double").alias("popu"), F.sum("c_acctbal").cast("double").alias("acctbal"))
    hz = supplier.select(((F.col("s_suppkey") * grid.spread) % n).alias("zid")).distinct().withColumn("h", F.lit(1.0))
    z = F.col("zid").cast("double")
    zones = cz.join(F.broadcast(hz), "zid", "left").select(
        F.col("zid").cast("string").alias("zone_id"),
        F.col("zid").cast("long").alias("row_ord"),
        ((F.col("zid") % g).cast("double") + 0.3 * F.sin(z)).alias("XCoord"),
        (F.floor(F.col("zid") / g).cast("double") + 0.3 * F.cos(3 * z)).alias("YCoord"),
        F.col("popu").alias("POPU"),
        F.coalesce("h", F.lit(0.0)).alias("hosp"),
        "acctbal",
    )
    ends = (
        lineitem.select("l_orderkey", (F.col("l_suppkey") * grid.spread % n).alias("d"), F.col("l_quantity").cast("double").alias("f"))
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % n).alias("o")), "l_orderkey")
        .groupBy("o", "d")
        .agg(F.sum("f").alias("flow"))
    )
    apart = F.abs(F.col("o") % g - F.col("d") % g) + F.abs(F.floor(F.col("o") / g) - F.floor(F.col("d") / g))
    flows = ends.where(apart <= grid.radius).select(F.col("o").cast("string").alias("origin"), F.col("d").cast("string").alias("destin"), "flow")
    here = cz.select("zid")
    steps = here.select("zid", F.explode(F.array(F.when(F.col("zid") % g < g - 1, F.col("zid") + 1), F.col("zid") + g)).alias("to")).join(here.withColumnRenamed("zid", "to"), "to")
    adj = steps.select(F.col("zid").cast("string").alias("focal"), F.col("to").cast("string").alias("neighbor"))
    return World(materialize(zones, "zones"), materialize(flows, "flows"), materialize(adj, "adj"))


def _sql_world(grid: Grid) -> str:
    n, g = grid.side**2, grid.side
    return f"""
cz as (select c_custkey % {n} as zid, count(*) as popu, sum(c_acctbal) as acctbal from customer group by 1),
hz as (select distinct (s_suppkey * {grid.spread}) % {n} as zid from supplier),
zones as (select cast(cz.zid as varchar) as zone_id, cz.zid as row_ord, cast(cz.zid % {g} as double) + 0.3 * sin(cz.zid) as x, cast(floor(cz.zid / {g}.0) as double) + 0.3 * cos(3 * cz.zid) as y,
  cast(popu as double) as popu, case when hz.zid is null then 0.0::double else 1.0::double end as hosp, cast(acctbal as double) as acctbal from cz left join hz on cz.zid = hz.zid),
od as (select o_custkey % {n} as o, (l_suppkey * {grid.spread}) % {n} as d, sum(cast(l_quantity as double)) as flow from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
flows as (select cast(o as varchar) as origin, cast(d as varchar) as destin, flow from od where abs(o % {g} - d % {g}) + abs(floor(o / {g}.0) - floor(d / {g}.0)) <= {grid.radius}),
adj as (select cast(a.zid as varchar) as focal, cast(b.zid as varchar) as neighbor from cz a join cz b on (b.zid = a.zid + 1 and a.zid % {g} < {g} - 1) or b.zid = a.zid + {g})"""


_SQL_KEY = r"nullif(upper(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]+', '', 'g')), '')"


def written(spark: SparkSession, folder: str) -> World:
    """The written tables by zone key: of each zone its record with the lowest row_id; flows and adjacency rows with blank ends left out."""
    coords, flow, adj = (table(spark, folder, t) for t in ("coords_df", "df_flow", "df_adj"))
    keyed = coords.withColumn("zone_id", zone_key(F.col("ZoneID"))).withColumn("row_ord", F.col("row_id")).where("zone_id is not null")
    first = keyed.groupBy("zone_id").agg(F.min_by(F.struct("row_ord", "XCoord", "YCoord", "POPU", "hosp"), "row_ord").alias("r")).select("zone_id", "r.*")
    flows = flow.select(zone_key(F.col("Origin")).alias("origin"), zone_key(F.col("Destin")).alias("destin"), F.col("Flow").alias("flow")).where("origin is not null and destin is not null and flow is not null and not isnan(flow)")
    pairs = adj.select(zone_key(F.col("focal")).alias("focal"), zone_key(F.col("neighbor")).alias("neighbor")).where("focal is not null and neighbor is not null")
    return World(materialize(first, "zones"), flows, materialize(pairs, "adj"))


def located(spark: SparkSession, folder: str) -> World:
    """The written tables, of the zones with coordinates; a null or NaN POPU or hosp counts as 0, flows that are not positive are left out."""
    w = written(spark, folder)
    zones = prepare.located_zones(w.zones).withColumns({c: F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in ("POPU", "hosp")})
    return World(materialize(zones, "located"), materialize(w.flows.where("flow > 0"), "positive"), w.adj)


_SQL_WRITTEN = f"""
keyed as (select *, {_SQL_KEY.format('ZoneID')} as zone_id from coords_df),
zones as (select zone_id, row_id as row_ord, XCoord as x, YCoord as y, POPU as popu, hosp from keyed where zone_id is not null qualify row_number() over (partition by zone_id order by row_id) = 1),
flows as (select {_SQL_KEY.format('Origin')} as origin, {_SQL_KEY.format('Destin')} as destin, Flow as flow from df_flow where Flow is not null and not isnan(Flow)),
adj as (select * from (select {_SQL_KEY.format('focal')} as focal, {_SQL_KEY.format('neighbor')} as neighbor from df_adj) where focal is not null and neighbor is not null)"""

_SQL_NODES = "nodes as (select * from zones where x is not null and not isnan(x) and y is not null and not isnan(y))"
_SQL_EDGES = """
fe as (select origin, destin, flow, greatest(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 0.001) as dist from flows join nodes a on origin = a.zone_id join nodes b on destin = b.zone_id where origin <> destin and flow > 0),
bydist as (select dist, sum(flow) as w from fe group by dist),
running as (select dist, sum(w) over (order by dist) as c, sum(w) over () as t from bydist),
med as (select min(dist) as median from running where c >= 0.5 * t),
fw as (select origin, destin, flow, dist, ln(1 + flow) * power(0.5, dist / median) as w from fe, med),
gl as (select quantile_cont(w, 0.75) as glue from fw)"""
_SQL_GRAPH = """
na as (select focal, neighbor from adj join nodes a on focal = a.zone_id join nodes b on neighbor = b.zone_id where focal <> neighbor),
oneway as (select origin as src, destin as dst, w from fw union all select focal, neighbor, glue from na, gl),
sym as (select src, dst, sum(w) as w from (select src, dst, w from oneway union all select dst, src, w from oneway) group by src, dst),
looped as (select src, dst, w from sym union all select zone_id, zone_id, glue from nodes, gl),
d1 as (select dst as node, sum(w) as deg from looped group by dst),
n1 as materialized (select src, dst, w / sqrt(a.deg * b.deg) as w from looped join d1 a on src = a.node join d1 b on dst = b.node),
d2 as (select dst as node, sum(w) as deg from n1 group by dst),
n2 as materialized (select src, dst, w / sqrt(a.deg * b.deg) as w from n1 join d2 a on src = a.node join d2 b on dst = b.node)"""
_SQL_H0 = "h0 as (select zone_id, (x - avg(x) over ()) / stddev_pop(x) over () as f0, (y - avg(y) over ()) / stddev_pop(y) over () as f1 from nodes)"


def _sql_hops(k: int) -> str:
    return ",\n".join(f"h{i} as materialized (select dst as zone_id, sum(w * f0) as f0, sum(w * f1) as f1 from n2 join h{i - 1} on src = zone_id group by dst)" for i in range(1, k + 1))


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# --- keys, preparation, validation


def norm_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Normal forms of keys written as numbers, padded, with zeros, and as text."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    written_ = F.array(key, F.concat(F.lit("00"), key), F.concat(F.lit("  "), key, F.lit(".0 ")), F.concat(key, F.lit("e2")), F.concat(key, F.lit("d")), F.concat(F.lit("-"), key, F.lit(".75")), F.concat(F.lit("Z "), key), F.concat(F.lit(" "), F.lit("")), F.lit("nan"), F.lit("inf"), F.concat(key, F.lit("_0")))
    return c.select(F.explode(written_).alias("written")).select("written", norm_zone_key(F.col("written")).alias("zone_id")).distinct()


NORM_KEYS_SQL = r"""
with c as (select cast(c_custkey as varchar) as k from customer),
w as (select distinct unnest([k, '00' || k, '  ' || k || '.0 ', k || 'e2', k || 'd', '-' || k || '.75', 'Z ' || k, ' ', 'nan', 'inf', k || '_0']) as written from c),
t as (select written, trim(written) as t from w)
select written, case when t = '' then null when regexp_full_match(t, '[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?')
  then cast(cast(trunc(cast(replace(t, '_', '') as double)) as bigint) as varchar) else t end as zone_id from t"""


def zones_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of each written zone id that has coordinates."""
    zones = table(spark, folder, "coords_df").withColumn("row_ord", F.col("row_id")).withColumn("zone_id", norm_zone_key(F.col("ZoneID")))
    return prepare.located_zones(zones).select("zone_id", "row_id", "XCoord", "YCoord")


ZONES_FIRST_SQL = r"""
with k as (select *, nullif(regexp_replace(ZoneID, '^[\s\x{A0}\x{2003}]+|[\s\x{A0}\x{2003}]+$', '', 'g'), '') as zone_id from coords_df)
select zone_id, row_id, XCoord, YCoord from k where zone_id is not null and XCoord is not null and not isnan(XCoord) and YCoord is not null and not isnan(YCoord)
qualify row_number() over (partition by zone_id order by row_id) = 1"""


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Area and centroid of every geometry on record."""
    g = F.col("geometry")
    return table(spark, folder, "coords_df").where(g.isNotNull()).select("row_id", F.round(polygon_area(g), 3).alias("area"), F.round(centroid(g)["x"], 4).alias("cx"), F.round(centroid(g)["y"], 4).alias("cy"))


CENTROIDS_SQL = """
with rings as (select row_id, unnest(geometry) as ring, generate_subscripts(geometry, 1) as ring_no from coords_df where geometry is not null),
edges as (select row_id, ring_no, ring[1].x as ox, ring[1].y as oy, ring[i].x - ring[1].x as x1, ring[i].y - ring[1].y as y1, ring[i + 1].x - ring[1].x as x2, ring[i + 1].y - ring[1].y as y2 from (select *, unnest(range(1, len(ring))) as i from rings)),
m as (select row_id, ring_no, any_value(ox) as ox, any_value(oy) as oy, sum(x1 * y2 - x2 * y1) as a2, sum((x1 + x2) * (x1 * y2 - x2 * y1)) as mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) as my from edges group by row_id, ring_no),
p as (select row_id, case when ring_no = 1 then 1.0 else -1.0 end as s, abs(a2) / 2 as a, sign(a2) * mx / 6 + ox * abs(a2) / 2 as mx, sign(a2) * my / 6 + oy * abs(a2) / 2 as my from m)
select row_id, round(sum(s * a), 3) as area, round(case when sum(s * a) > 0 then sum(s * mx) / sum(s * a) end, 4) as cx, round(case when sum(s * a) > 0 then sum(s * my) / sum(s * a) end, 4) as cy from p group by row_id"""


def bad_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of written flows that no zone has."""
    w = written(spark, folder)
    return validate.unknown_endpoints(w.flows, w.zones)


BAD_ENDPOINTS_SQL = _with(_SQL_WRITTEN) + "select distinct zone_id from (select origin as zone_id from flows where destin is not null union all select destin from flows where origin is not null) where zone_id is not null and zone_id not in (select zone_id from zones)"


# --- flows to graph


def _weights(w: World, glue: float | None = None) -> flow_graph.Weights:
    return flow_graph.weighted_flows(w.flows, prepare.located_zones(w.zones), glue)


def flow_edges(spark: SparkSession, folder: str) -> DataFrame:
    w = world(spark, folder, F2)
    return flow_graph.flow_edges(w.flows, w.zones).select("origin", "destin", "flow", r6("dist").alias("dist"))


def weighted_median(spark: SparkSession, folder: str) -> DataFrame:
    """Flow-weighted median distance of the written flows."""
    return spark.createDataFrame([(_weights(written(spark, folder), 1.0).median,)], "median double").select(r6("median").alias("median"))


def flow_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(world(spark, folder, F2)).edges.select("origin", "destin", r6("w").alias("w"))


def glue(spark: SparkSession, folder: str) -> DataFrame:
    """The 75th percentile of the written flows' weights."""
    return spark.createDataFrame([(_weights(written(spark, folder)).glue,)], "glue double").select(r6("glue").alias("glue"))


def _graph(spark: SparkSession, folder: str, grid: Grid = F2) -> tuple[World, flow_graph.Weights]:
    w = world(spark, folder, grid)
    return w, _weights(w)


def sym_edges(spark: SparkSession, folder: str) -> DataFrame:
    w, x = _graph(spark, folder)
    return flow_graph.symmetric_edges(x.edges, flow_graph.known_neighbours(w.adj, w.zones), x.glue).select("src", "dst", r6("w").alias("w"))


def self_loops(spark: SparkSession, folder: str) -> DataFrame:
    w, x = _graph(spark, folder)
    return flow_graph.self_loops(w.zones, x.glue).select("src", "dst", r6("w").alias("w"))


def norm_edges(spark: SparkSession, folder: str, times: int) -> DataFrame:
    w, x = _graph(spark, folder)
    return flow_graph.build_graph(x.edges, w.adj, w.zones, x.glue, times).select("src", "dst", r6("w").alias("w"))


def hosp_inflow(spark: SparkSession, folder: str) -> DataFrame:
    """Flow into each written zone that is flagged or whose flag is missing."""
    w = written(spark, folder)
    return features.hospital_inflow(w.flows, w.zones, "hosp").select("zone_id", F.round("inflow", 3).alias("inflow"))


def feature_matrix(spark: SparkSession, folder: str, mode: str, w: World | None = None) -> DataFrame:
    w = w or world(spark, folder, F2)
    values, names = features.features(w.zones, w.flows, mode, "hosp")
    return values.select("zone_id", *[r6(n).alias(n) for n in names])


_SQL_LOCATED = "located as (select zone_id, row_ord, x, y, case when popu is null or isnan(popu) then 0 else popu end as popu, case when hosp is null or isnan(hosp) then 0 else hosp end as hosp from nodes)"


def _sql_features_written(mode: str) -> str:
    return _sql_features(mode).replace(_with(_sql_world(F2)).rstrip(), _with(_SQL_WRITTEN, _SQL_NODES, _SQL_LOCATED).rstrip()).replace("from flows join zones on destin = zone_id where", "from flows join located on destin = zone_id where origin is not null and flow > 0 and").replace("from zones left join inflows", "from located left join inflows")


def _sql_features(mode: str) -> str:
    raw = ["x", "y"] + ["ln(1 + greatest(popu, 0))"] * ("pop" in mode) + ["ln(1 + greatest(coalesce(inflow, 0), 0))"] * ("hosp" in mode)
    made = ", ".join(f"round((v{i} - avg(v{i}) over ()) / stddev_pop(v{i}) over (), 6) as f{i}" for i in range(len(raw)))
    return _with(_sql_world(F2), "inflows as (select destin, sum(flow) as inflow from flows join zones on destin = zone_id where hosp >= 0.5 group by destin)", f"raw as (select zone_id, {', '.join(f'{e} as v{i}' for i, e in enumerate(raw))} from zones left join inflows on destin = zone_id)") + f"select zone_id, {made} from raw"


# --- embedding


def diffuse_k(spark: SparkSession, folder: str, hops: int, w: World | None = None) -> DataFrame:
    w, x = (w, _weights(w)) if w else _graph(spark, folder)
    operator = flow_graph.build_graph(x.edges, w.adj, w.zones, x.glue)
    values, names = features.features(w.zones, w.flows)
    return diffuse.diffuse(operator, values, names, hops).select("zone_id", r6("f0").alias("f0"), r6("f1").alias("f1"))


def embedding(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding of the grid world with default settings."""
    w = world(spark, folder, F2)
    return embed_zones(w.zones, w.flows, w.adj).select("ZoneID", r6("Emb_X").alias("Emb_X"), r6("Emb_Y").alias("Emb_Y"))


def embedding_written(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding of the written tables with default settings."""
    w = written(spark, folder)
    return embed_zones(w.zones, w.flows, w.adj).select("ZoneID", r6("Emb_X").alias("Emb_X"), r6("Emb_Y").alias("Emb_Y"))


def embedding_features(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding with all features, whose extra columns enter both outputs."""
    w = world(spark, folder, F2)
    made = embed_zones(w.zones, w.flows, w.adj, EmbeddingConfig(feature_mode="coords_pop_hosp_inflow", k_hops=2))
    return made.select("ZoneID", r6("Emb_X").alias("Emb_X"), r6("Emb_Y").alias("Emb_Y"))


_SQL_EMB_F = _with(
    _sql_world(F2), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH,
    "inflows as (select destin, sum(flow) as inflow from flows join zones on destin = zone_id where hosp >= 0.5 group by destin)",
    "raw as (select zone_id, x as v0, y as v1, ln(1 + popu) as v2, ln(1 + coalesce(inflow, 0)) as v3 from zones left join inflows on destin = zone_id)",
    "h0 as (select zone_id, " + ", ".join(f"(v{i} - avg(v{i}) over ()) / stddev_pop(v{i}) over () as f{i}" for i in range(4)) + " from raw)",
    *[f"h{k} as materialized (select dst as zone_id, {', '.join(f'sum(w * f{i}) as f{i}' for i in range(4))} from n2 join h{k - 1} on src = zone_id group by dst)" for k in (1, 2)],
) + "select zone_id as ZoneID, round(f0 + (f2 + f3) / sqrt(2), 6) as Emb_X, round(f1 + (f2 + f3) / sqrt(2), 6) as Emb_Y from h2"


def gcn_embedding(spark: SparkSession, folder: str, w: World | None = None) -> DataFrame:
    """Two convolutions with given weights."""
    w, x = (w, _weights(w)) if w else _graph(spark, folder)
    operator = flow_graph.build_graph(x.edges, w.adj, w.zones, x.glue)
    values, names = features.features(w.zones, w.flows)
    made = diffuse.gcn(operator, values, names, GCN_LAYERS)
    return made.select("ZoneID", r6("Emb_X").alias("Emb_X"), r6("Emb_Y").alias("Emb_Y"))


GCN_LAYERS = [([[0.5, -0.25], [0.75, 1.0], [-1.0, 0.5]], [0.1, -0.2, 0.05]), ([[1.0, -0.5, 0.25], [0.3, 0.6, -0.9]], [0.0, 0.5])]


def _sql_gcn(world_: str | None = None) -> str:
    steps, source, width = [], "h0", 2
    for k, (weight, bias) in enumerate(GCN_LAYERS):
        mixed = ", ".join(f"{' + '.join(f'({v}) * f{i}' for i, v in enumerate(row))} as f{j}" for j, row in enumerate(weight))
        width = len(weight)
        cut = "greatest({0}, 0)" if k < len(GCN_LAYERS) - 1 else "{0}"
        outs = ", ".join(cut.format(f"sum(w * f{j}) + ({bias[j]})") + f" as f{j}" for j in range(width))
        steps += [f"m{k} as materialized (select zone_id, {mixed} from {source})", f"g{k} as materialized (select dst as zone_id, {outs} from n2 join m{k} on src = zone_id group by dst)"]
        source = f"g{k}"
    return _with(world_ or _sql_world(F2), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, *steps) + f"select zone_id as ZoneID, round(f0, 6) as Emb_X, round(f1, 6) as Emb_Y from {source}"


# --- cluster metrics of a given assignment: blocks of the grid


BLOCK = 5


def _blocks(zones: DataFrame, grid: Grid = F2) -> DataFrame:
    z = F.col("zone_id").cast("long")
    return zones.select("zone_id", (F.floor(z / (grid.side * BLOCK)) * (grid.side // BLOCK) + F.floor(z % grid.side / BLOCK)).cast("long").alias("cluster"))


_SQL_PART = f"part as (select zone_id, cast(floor(row_ord / {F2.side * BLOCK}.0) * {F2.side // BLOCK} + floor((row_ord % {F2.side}) / {BLOCK}.0) as bigint) as cluster from zones)"
_SQL_TERMS = """
placed as (select flow, a.cluster as co, b.cluster as cd from flows join part a on origin = a.zone_id join part b on destin = b.zone_id),
tot as (select sum(flow) as m from placed),
ints as (select co as cluster, sum(case when co = cd then flow else 0 end) as internal, sum(flow) as outf from placed group by co),
ins as (select cd as cluster, sum(flow) as inf from placed group by cd),
terms as (select cluster, coalesce(internal, 0) as internal, coalesce(outf, 0) as outf, coalesce(outf, 0) + coalesce(inf, 0) as deg from (select distinct cluster from part) left join ints using (cluster) left join ins using (cluster))"""


def _pairs(w: World) -> DataFrame:
    return metrics.known_flows(w.flows, w.zones)


def out_in_degree(spark: SparkSession, folder: str) -> DataFrame:
    """Outgoing, incoming and all flow of the written zones."""
    w = written(spark, folder)
    flows = metrics.node_flows(_pairs(w))
    return flows.select("zone_id", *[F.round(c, 3).alias(c) for c in ("out", "inn", "deg")])


def modularity_terms(spark: SparkSession, folder: str) -> DataFrame:
    w = world(spark, folder, F2)
    return metrics.modularity_terms(_pairs(w), _blocks(w.zones)).select("cluster", r6("internal").alias("internal"), r6("out").alias("out"), r6("deg").alias("deg"), r6("term").alias("term"))


def li_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    w = world(spark, folder, F2)
    return metrics.modularity_terms(_pairs(w), _blocks(w.zones)).select("cluster", r6("li").alias("li"))


def total_modularity(spark: SparkSession, folder: str) -> DataFrame:
    w = world(spark, folder, F2)
    return spark.createDataFrame([(metrics.total_modularity(_pairs(w), _blocks(w.zones)),)], "q double").select(r6("q").alias("q"))


def cluster_attrs(spark: SparkSession, folder: str) -> DataFrame:
    w = world(spark, folder, F2)
    columns = ["POPU", "acctbal", "hosp"]
    made = metrics.cluster_attributes(w.zones, _blocks(w.zones), columns)
    return made.select("cluster", "n_zones", *[F.round(c, 4).alias(c) for c in made.columns if c not in ("cluster", "n_zones")])


def cluster_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks above a cap on residents or accounts."""
    w = world(spark, folder, F2)
    return metrics.over_caps(w.zones, _blocks(w.zones), CAPS).select("cluster", F.round("POPU", 4).alias("POPU"), F.round("acctbal", 4).alias("acctbal"))


CAPS = {"POPU": 95.0, "acctbal": 430_000.0}


def attach_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with the block of their zone."""
    w = world(spark, folder, F2)
    c = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % F2.side**2).alias("zone"))
    return attach(c, "zone", _blocks(w.zones).withColumnRenamed("zone_id", "_zone")).select("c_custkey", "cluster")


# --- forest and cuts


def edge_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacency with the distance of the places of its ends."""
    w = world(spark, folder, F2)
    return partition.costed_edges(w.adj, w.zones, _places(w)).select("u", "v", r6("w").alias("w"))


def _places(w: World) -> DataFrame:
    return w.zones.select("zone_id", "row_ord", F.col("XCoord").alias("emb_x"), F.col("YCoord").alias("emb_y"))


_SQL_COSTS = "costs as (select focal as u, neighbor as v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as w from adj join zones a on focal = a.zone_id join zones b on neighbor = b.zone_id)"


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the written adjacency with their number of zones."""
    w = written(spark, folder)
    made = forest.components(w.adj.select(F.col("focal").alias("u"), F.col("neighbor").alias("v")), w.zones.select(F.col("zone_id").alias("node")))
    return made.groupBy("component").agg(F.count(F.lit(1)).alias("n_zones"))


COMPONENTS_SQL = (
    _with(
        _SQL_WRITTEN,
        "links as (select distinct focal as u, neighbor as v from adj where focal in (select zone_id from zones) and neighbor in (select zone_id from zones) and focal <> neighbor)",
        "reach(node, seen) as (select zone_id, zone_id from zones union select l.v, r.seen from reach r join (select u, v from links union select v, u from links) l on l.u = r.node)",
        recursive=True,
    )
    + "select component, count(*) as n_zones from (select node, min(seen) as component from reach group by node) group by component"
)


def mst_edges(spark: SparkSession, folder: str) -> DataFrame:
    w = world(spark, folder, F2)
    return forest.spanning_forest(partition.costed_edges(w.adj, w.zones, _places(w))).select("u", "v", r6("w").alias("w"))


_SQL_MST = [
    "ranked as materialized (select least(u, v) as u, greatest(u, v) as v, w, row_number() over (order by w, least(u, v), greatest(u, v)) as k from costs)",
    "walk(k, node) as (select k, u from ranked union select x.k, case when e.u = x.node then e.v else e.u end from walk x join ranked e on e.k < x.k and (e.u = x.node or e.v = x.node))",
    "mst as materialized (select u, v, w, k from ranked r where not exists (select 1 from walk x where x.k = r.k and x.node = r.v))",
]


def written_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The minimum spanning forest of the written adjacency by distance of the zones' coordinates (0, 0 where there are none)."""
    w = written(spark, folder)
    nan_free = [F.when(is_number(F.col(a)) & is_number(F.col(b)), F.col(a)).alias(n) for a, b, n in (("XCoord", "YCoord", "emb_x"), ("YCoord", "XCoord", "emb_y"))]
    edges = partition.costed_edges(w.adj, w.zones, w.zones.select("zone_id", "row_ord", *nan_free))
    return forest.spanning_forest(edges).select("u", "v", r6("w").alias("w"))


_SQL_WRITTEN_COSTS = """
spots as (select zone_id, case when x is null or isnan(x) or y is null or isnan(y) then 0.0::double else x end as x, case when x is null or isnan(x) or y is null or isnan(y) then 0.0::double else y end as y from zones),
costs as (select distinct least(focal, neighbor) as u, greatest(focal, neighbor) as v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as w from adj join spots a on focal = a.zone_id join spots b on neighbor = b.zone_id where focal <> neighbor)"""


def subtree_stats(spark: SparkSession, folder: str) -> DataFrame:
    """For each edge of the grid's spanning tree: residents, hospitals and zones on the side away from the first zone."""
    return _first_cuts(spark, folder, F1).select("u", "v", "n", r6("popu").alias("popu"), r6("hosp").alias("hosp"))


def first_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """All candidate cuts of the whole grid with their gains."""
    return _first_cuts(spark, folder, F2).select("u", "v", (r6("gain") + 0.0).alias("gain"))


def _posed(w: World, **limits) -> partition.Problem:
    """A world as a problem of the solver, its zones embedded where they lie."""
    return partition.pose(w.zones, w.flows, w.adj, _places(w), PartitionConfig(population_column="POPU", hospital_column="hosp", **limits))


def _first_cuts(spark: SparkSession, folder: str, grid: Grid) -> DataFrame:
    """The solver's candidates of its first level, by the names of the edges cut."""
    problem = _posed(world(spark, folder, grid))
    nodes, flows = partition.set_up(problem)
    start = spark.createDataFrame([("all", 0)], "cluster string, root long")
    cuts = partition.candidates(nodes.withColumn("cluster", F.lit("all")), flows, start, problem.m, problem.limits, [])
    names = [problem.nodes.select(F.col("ord").alias(e), F.col("zone_id").alias(f"{e}_zone")) for e in ("node", "parent")]
    named = cuts.join(names[0], "node").join(names[1], "parent")
    return named.select(F.least("node_zone", "parent_zone").alias("u"), F.greatest("node_zone", "parent_zone").alias("v"), "n", "popu", "hosp", "gain")


_SQL_SIDES = [
    "root as (select arg_min(zone_id, row_ord) as z from zones)",
    "near(k, node) as (select m.k, r.z from mst m, root r union select s.k, case when e.u = s.node then e.v else e.u end from near s join mst e on e.k <> s.k and (e.u = s.node or e.v = s.node))",
    "side as materialized (select m.k, z.zone_id from mst m, zones z where not exists (select 1 from near s where s.k = m.k and s.node = z.zone_id))",
    "sums as (select k, count(*) as n, sum(popu) as popu, sum(hosp) as hosp from side join zones using (zone_id) group by k)",
    "tot as (select sum(flow) as m from flows join zones a on origin = a.zone_id join zones b on destin = b.zone_id)",
    "moves as (select origin, destin, flow from flows join zones a on origin = a.zone_id join zones b on destin = b.zone_id)",
    "ends as (select m.k, flow, so.zone_id is not null as o, sd.zone_id is not null as d from mst m cross join moves left join side so on so.k = m.k and so.zone_id = origin left join side sd on sd.k = m.k and sd.zone_id = destin)",
    "gains as (select k, -sum(case when o <> d then flow else 0 end) / any_value(m) + (sum(case when o then flow else 0 end) + sum(case when d then flow else 0 end)) * (2 * any_value(m) - sum(case when o then flow else 0 end) - sum(case when d then flow else 0 end)) / (2 * any_value(m) * any_value(m)) as gain from ends, tot group by k)",
]


def best_cut_level1(spark: SparkSession, folder: str) -> DataFrame:
    """The cut that the solver takes first, by the sides' numbers of zones and residents; the part with the first zone is the upper one."""
    problem = _posed(world(spark, folder, F1), min_population=FIRST_MIN, max_population=1e12, min_hospitals=1, min_local_index=FIRST_LI)
    nodes, flows = partition.set_up(problem)
    start = spark.createDataFrame([("all", 0)], "cluster string, root long")
    cuts = partition.candidates(nodes.withColumn("cluster", F.lit("all")), flows, start, problem.m, problem.limits, [])
    top = cuts.where("good and gain > 0").agg(F.max_by(F.struct("n", "popu"), F.struct("gain", -F.col("node"))).alias("c")).select("c.*")
    whole = nodes.agg(F.count(F.lit(1)).alias("all_n"), F.sum("popu").alias("all_popu"))
    sides = F.array(F.struct(F.lit("lower").alias("part"), F.col("n"), F.col("popu")), F.struct(F.lit("upper").alias("part"), (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_popu") - F.col("popu")).alias("popu")))
    # one row each
    return top.where("n is not null").join(F.broadcast(whole), F.lit(True)).select(F.explode(sides).alias("s")).select("s.part", "s.n", r6("s.popu").alias("popu"))


FIRST_MIN, FIRST_LI = 5.0, 0.1
_SQL_FIRST = f"""
li as (select k, coalesce(sum(case when o and d then flow end), 0) / nullif(sum(case when o then flow end), 0) as li_s, coalesce(sum(case when not o and not d then flow end), 0) / nullif(sum(case when not o then flow end), 0) as li_t from ends group by k),
whole as (select count(*) as n, sum(popu) as popu, sum(hosp) as hosp from zones),
good as (select s.k, s.n, s.popu, w.n - s.n as n_t, w.popu - s.popu as popu_t, gain from sums s join gains using (k) join li using (k), whole w
  where s.popu >= {FIRST_MIN} and w.popu - s.popu >= {FIRST_MIN} and s.hosp >= 1 and w.hosp - s.hosp >= 1 and coalesce(li_s, 0) >= {FIRST_LI} and coalesce(li_t, 0) >= {FIRST_LI}),
top as (select * from good where gain > 0 order by gain desc limit 1)"""


#: Limits of the partitions over the grid worlds: (least, most residents, least hospitals, least local index). Without a cut
#: forced by the cap, and with some; the last also where the cap can't be met.
FREE, FORCED, WHOLE = (240.0, 900.0, 1, 0.3), (60.0, 300.0, 1, 0.1), (60.0, 400.0, 1, 0.3)


def _config(limits: tuple) -> PartitionConfig:
    return PartitionConfig(**dict(zip(("min_population", "max_population", "min_hospitals", "min_local_index"), limits, strict=True)), population_column="POPU", hospital_column="hosp")


def _told(part: DataFrame) -> DataFrame:
    return part.select("ZoneID", "Community_ID", *[r6(c).alias(c) for c in ("Comm_Pop", "Comm_Hosp", "Comm_LI")])


def apart(adj: DataFrame) -> DataFrame:
    """The adjacency of the small grid without the steps from its third column to its fourth, and without its last zone: three pieces."""
    f, n = F.col("focal").cast("int"), F.col("neighbor").cast("int")
    return adj.where(~((f % 5 == 2) & (n == f + 1)) & (n != 24))


def partition_grid(spark: SparkSession, folder: str, grid: Grid, limits: tuple, local: bool, pieces: bool = False) -> DataFrame:
    """Clusters of a grid world whose zones are embedded where they lie, by one of the two solvers."""
    w = world(spark, folder, grid)
    return _told(partition_zones_table(w.zones, w.flows, apart(w.adj) if pieces else w.adj, _places(w), _config(limits), local)[0])


def partition_full(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the grid world under constraints: embedding, forest, cuts."""
    w = world(spark, folder, F2)
    emb = embed_zones(w.zones, w.flows, w.adj).select(F.col("ZoneID").alias("zone_id"), F.col("Emb_X").alias("emb_x"), F.col("Emb_Y").alias("emb_y"))
    return _told(partition_zones_table(w.zones, w.flows, w.adj, emb, _config(WHOLE))[0])


def partition_result(spark: SparkSession, folder: str) -> DataFrame:
    """One row per cluster of the grid world, its zones drawn as unit squares: metrics and compactness."""
    w = world(spark, folder, F2)
    emb = embed_zones(w.zones, w.flows, w.adj)
    zones = _squares(w.zones, F2).join(emb.withColumnRenamed("ZoneID", "zone_id"), "zone_id")
    made = Partitioner(zones, w.flows.toDF("Origin", "Destin", "Flow"), "zone_id", w="rook", constraints=[("POPU", "min", 60), ("POPU", "max", 400), ("hosp", "min", 1)])
    result = made.partition().result
    return result.select(*[c if c in ("cluster", "n_zones") else r6(c).alias(c) for c in result.columns if c != "geometry"])


def _sql_worklist(n: int, least: float, most: float, hospitals: float, index: float, zones: str = "zones", flows: str = "flows") -> str:
    """The worklist over zones (at most ``n``), flows and the tree ``mst``: clusters are strings of bits, one for each zone in row order, and
    each round of the recursion looks at all open clusters of a level. ``placed`` has the clusters' numbers."""
    has = lambda bits, at="i": f"get_bit({bits}, cast({at} as integer)) = 1"
    return f"""
zz as materialized (select zone_id, popu, hosp, cast(row_number() over (order by row_ord) - 1 as integer) as i from {zones}),
mv as materialized (select a.i as o, b.i as d, flow from {flows} join zz a on origin = a.zone_id join zz b on destin = b.zone_id),
mm as (select sum(flow) as m from mv),
tree as materialized (select k, a.i as u, b.i as v from mst join zz a on mst.u = a.zone_id join zz b on mst.v = b.zone_id),
adjacent as (select u as a, v as b, k from tree union all select v, u, k from tree),
far(k, node) as (select k, v from tree union select f.k, a.b from far f join adjacent a on a.a = f.node and a.k <> f.k),
halves as materialized (select k, bitstring_agg(node, 0, {n - 1}) as s from far group by k),
joined(first, node) as (select i, i from zz union select j.first, a.b from joined j join adjacent a on a.a = j.node),
parts as materialized (select first, bitstring_agg(node, 0, {n - 1}) as c, count(*) as size from joined where first in (select min(first) from joined group by node) group by first),
work(c, root, level, path, at_level, at_path, at_side, final) as (
  select (select bitstring_agg(i, 0, {n - 1}) from zz), 0, 0, '', 0, '', 0, false
  union all
  select * from (
    with here as materialized (select c, root, level, path from work where not final),
    sums as (select path, sum(popu) as popu, count(*) as n from here join zz on {has('c')} group by path),
    state as (select here.*, popu > {most} as force, popu <= {most} and popu < 2 * {least} or n = 1 as done from here join sums using (path)),
    pieces as (select path, count(*) as n from state join parts p on bit_count(p.c & state.c) > 0 where not done group by path),
    biggest as (select path, first, p.c as a from state join pieces using (path) join parts p on bit_count(p.c & state.c) > 0 where pieces.n > 1 qualify row_number() over (partition by path order by size desc, first) = 1),
    cuts as (select path, k, u, v, state.c & s as x, state.c & ~s as y, {has('s', 'root')} as root_in_x from state join pieces using (path) join tree on {has('state.c', 'u')} and {has('state.c', 'v')} join halves using (k) where pieces.n = 1),
    sided as (select path, k, case when root_in_x then y else x end as a, case when root_in_x then x else y end as b, case when root_in_x then u else v end as lower from cuts),
    people as (select path, k, sum(case when {has('a')} then popu else 0 end) as pa, sum(case when {has('b')} then popu else 0 end) as pb, sum(case when {has('a')} then hosp else 0 end) as ha, sum(case when {has('b')} then hosp else 0 end) as hb from sided, zz group by path, k),
    moved as (select path, k, flow, {has('a', 'o')} as ao, {has('a', 'd')} as ad, {has('b', 'o')} as bo, {has('b', 'd')} as bd from sided, mv),
    flowed as (select path, k, sum(case when ao and ad then flow else 0 end) as ia, sum(case when bo and bd then flow else 0 end) as ib, sum(case when ao then flow else 0 end) as oa, sum(case when bo then flow else 0 end) as ob,
      sum((ao::int + ad::int) * flow) as da, sum((bo::int + bd::int) * flow) as db, sum(case when (ao or bo) and (ad or bd) then flow else 0 end) as ic from moved group by path, k),
    scored as (select path, k, a, b, lower, ia / m - power(da / (2 * m), 2) + ib / m - power(db / (2 * m), 2) - (ic / m - power((da + db) / (2 * m), 2)) as gain from sided join people using (path, k) join flowed using (path, k), mm
      where pa >= {least} and pb >= {least} and ha >= {hospitals} and hb >= {hospitals} and case when oa > 0 then ia / oa else 0 end >= {index} and case when ob > 0 then ib / ob else 0 end >= {index}),
    best as (select scored.* from scored join state using (path) where gain > 0 or force qualify row_number() over (partition by path order by round(gain, 12) desc, lower) = 1),
    made as (select path, a, state.c & ~a as b, first as lower from biggest join state using (path) union all select path, a, b, lower from best),
    child as (select path, 0 as side, a as c, lower as root from made union all select path, 1, b, bit_position(bitstring('1', 1)::bit, b) - 1 from made),
    grown as (select child.*, sum(popu) as popu from child join zz on {has('c')} group by all)
    select c, root, level, path, level, path, 0, true from state where path not in (select path from made)
    union all select g.c, g.root, state.level + 1, path || g.side, state.level, path, g.side, not (g.popu > {most} or g.popu >= 2 * {least}) from grown g join state using (path))
),
numbered as materialized (select c, cast(row_number() over (order by at_level, at_path, at_side) - 1 as integer) as cluster from work where final),
placed as materialized (select zone_id, cluster, popu, hosp, i from numbered join zz on {has('c')}),
inside as (select a.cluster, sum(case when a.cluster = b.cluster then flow else 0 end) as internal, sum(flow) as outf from mv join placed a on mv.o = a.i join placed b on mv.d = b.i group by a.cluster),
told as (select cluster, count(*) as n_zones, round(sum(popu), 6) as Comm_Pop, round(sum(hosp), 6) as Comm_Hosp, round(case when any_value(outf) > 0 then any_value(internal) / any_value(outf) else 0 end, 6) as Comm_LI,
  round(sum(popu), 6) as POPU_sum, round(min(popu), 6) as POPU_min, round(max(popu), 6) as POPU_max, round(sum(hosp), 6) as hosp_sum, round(min(hosp), 6) as hosp_min, round(max(hosp), 6) as hosp_max from placed left join inside using (cluster) group by cluster)"""


_SQL_TOLD = "select zone_id as ZoneID, cluster as Community_ID, Comm_Pop, Comm_Hosp, Comm_LI from placed join told using (cluster)"
_SQL_APART = "select focal, neighbor from adj where not (cast(focal as int) % 5 = 2 and cast(neighbor as int) = cast(focal as int) + 1) and neighbor <> '24'"
_SQL_EMB_COSTS = "costs as (select focal as u, neighbor as v, sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) as w from adj join h5 a on focal = a.zone_id join h5 b on neighbor = b.zone_id)"


def _sql_partition(grid: Grid, limits: tuple, pieces: bool = False) -> str:
    costs = _SQL_COSTS.replace("from adj", f"from ({_SQL_APART}) adj") if pieces else _SQL_COSTS
    return _with(_sql_world(grid), costs, *_SQL_MST, _sql_worklist(grid.side**2, *limits), recursive=True) + _SQL_TOLD


def _sql_embedded(grid: Grid, limits: tuple) -> str:
    """The worklist over the tree of the embedding."""
    return _with(_sql_world(grid), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, _sql_hops(5), _SQL_EMB_COSTS, *_SQL_MST, _sql_worklist(grid.side**2, *limits), recursive=True)


#: Zones of the written tables at the scale at which queries are compared, at most.
MOST_BITS = 4096
_SQL_PARTITION_WRITTEN = _with(
    _SQL_WRITTEN, _SQL_NODES, _SQL_LOCATED, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, _sql_hops(5),
    "moves as (select * from flows where origin is not null and destin is not null and flow > 0)",
    "costs as (select distinct least(focal, neighbor) as u, greatest(focal, neighbor) as v, sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) as w from adj join h5 a on focal = a.zone_id join h5 b on neighbor = b.zone_id where focal <> neighbor)",
    *_SQL_MST, _sql_worklist(MOST_BITS, 10_000.0, 500_000.0, 1, 0.3, "located", "moves"), recursive=True,
)


def _sql_shapes(of: str, side: int) -> str:
    """``shapes`` (area, perimeter, reock, polsby_popper) of the clusters of unit squares ``of`` (cluster, x, y). The hull of
    points of a grid lies between the least concave line above the highest point of each column and the greatest
    convex one below the lowest."""
    return f"""
sq as materialized (select cluster, cast(x as integer) as x, cast(y as integer) as y from {of}),
seg as (select cluster, x as ax, y as ay, x + 1 as bx, y as by_ from sq union all select cluster, x, y + 1, x + 1, y + 1 from sq union all select cluster, x, y, x, y + 1 from sq union all select cluster, x + 1, y, x + 1, y + 1 from sq),
border as (select cluster, count(*) as perimeter from (select cluster, ax, ay, bx, by_ from seg group by all having count(*) = 1) group by cluster),
columns as materialized (select cluster, x, max(y) as high, min(y) as low from (select cluster, x + i as x, y + j as y from sq, (values (0), (1)) t(i), (values (0), (1)) u(j)) group by cluster, x),
grid_x as (select distinct cluster, range as x from columns, range({side} + 1)),
lines as (select a.cluster, a.x as xa, b.x as xb, a.high as ha, b.high as hb, a.low as la, b.low as lb from columns a join columns b on a.cluster = b.cluster and a.x <= b.x),
hulled as (select g.cluster, g.x, max(case when xa = xb then ha else ha + (hb - ha) * (g.x - xa) * 1.0::double / (xb - xa) end) as high, min(case when xa = xb then la else la + (lb - la) * (g.x - xa) * 1.0::double / (xb - xa) end) as low from grid_x g join lines l on l.cluster = g.cluster and g.x between xa and xb group by g.cluster, g.x),
hull as (select a.cluster, sum((a.high - a.low + b.high - b.low) / 2.0::double) as hull_area from hulled a join hulled b on a.cluster = b.cluster and b.x = a.x + 1 group by a.cluster),
areas as (select cluster, count(*) as area from sq group by cluster),
shapes as (select cluster, cast(area as double) as area, cast(perimeter as double) as perimeter, round(area / hull_area, 6) as reock, round(4 * pi() * area / (perimeter * perimeter), 6) as polsby_popper from areas join border using (cluster) join hull using (cluster))"""


def partition_written(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the written tables: embedding, forest and cuts of all zones on record with coordinates, under the default limits."""
    w = located(spark, folder)
    zones, flows = w.zones, w.flows
    emb = embed_zones(zones, flows, w.adj).select(F.col("ZoneID").alias("zone_id"), F.col("Emb_X").alias("emb_x"), F.col("Emb_Y").alias("emb_y"))
    cfg = PartitionConfig(min_population=10_000, max_population=500_000, population_column="POPU", hospital_column="hosp")
    return _told(partition_zones_table(zones, flows, w.adj, emb, cfg)[0])


# --- polygons


def _squares(zones: DataFrame, grid: Grid) -> DataFrame:
    """The zones as squares of a grid of side 1."""
    z = F.col("zone_id").cast("long")
    x, y = (z % grid.side).cast("double"), F.floor(z / grid.side).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return zones.withColumn("geometry", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))))


def touching(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """Squares of the grid that touch."""
    return contiguity.polygon_neighbours(_squares(world(spark, folder, F2).zones, F2), mode)


def touching_written(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the zone table whose outlines share a vertex."""
    zones = table(spark, folder, "coords_df").select(F.lpad(F.col("row_id").cast("string"), 12, "0").alias("zone_id"), "geometry")
    return contiguity.polygon_neighbours(zones, "queen")


TOUCHING_WRITTEN_SQL = """
with v as (select distinct lpad(cast(row_id as varchar), 12, '0') as z, p.x as x, p.y as y from (select row_id, unnest(flatten(geometry)) as p from coords_df where geometry is not null))
select distinct a.z as focal, b.z as neighbor from v a join v b on a.x = b.x and a.y = b.y and a.z < b.z"""


def _sql_touching(mode: str) -> str:
    g = F2.side
    apart = "abs(a.row_ord % {0} - b.row_ord % {0})".format(g), f"abs(floor(a.row_ord / {g}.0) - floor(b.row_ord / {g}.0))"
    test = f"{apart[0]} + {apart[1]} = 1" if mode == "rook" else f"greatest({apart[0]}, {apart[1]}) = 1"
    return _with(_sql_world(F2)) + f"select a.zone_id as focal, b.zone_id as neighbor from zones a join zones b on a.zone_id < b.zone_id and {test}"


def ragged(zones: DataFrame) -> DataFrame:
    """``zone_id, cluster`` of clusters with bays and holes: blocks of the grid, of whose zones every third goes to the block above."""
    z = F.col("zone_id").cast("int")
    x, y = z % F2.side, F.floor(z / F2.side).cast("int")
    rows = F.when((3 * x + 7 * y) % 5 == 0, y + BLOCK).otherwise(y)
    return zones.select("zone_id", (F.floor(rows / BLOCK) * (F2.side // BLOCK) + F.floor(x / BLOCK)).cast("long").alias("cluster"))


_SQL_RAGGED = f"select cast(floor((case when (3 * x + 7 * y) % 5 = 0 then y + {BLOCK} else y end) / {BLOCK}.0) * {F2.side // BLOCK} + floor(x / {BLOCK}.0) as bigint) as cluster, x, y from (select cast(row_ord % {F2.side} as integer) as x, cast(floor(row_ord / {F2.side}.0) as integer) as y from zones)"


def compactness(spark: SparkSession, folder: str) -> DataFrame:
    """Area, border and compactness of the dissolved squares of clusters with bays and holes."""
    w = world(spark, folder, F2)
    made = compact.compactness(_squares(w.zones, F2).join(ragged(w.zones), "zone_id"))
    return made.select("cluster", *[r6(c).alias(c) for c in ("area", "perimeter", "reock", "polsby_popper")])


def compact_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Area, border and roundness of the blocks of the grid."""
    w = world(spark, folder, F2)
    made = compact.compactness(_squares(w.zones, F2).join(_blocks(w.zones), "zone_id"))
    return made.select("cluster", *[r6(c).alias(c) for c in ("area", "perimeter", "polsby_popper")])


_BLOCK_SQUARES = f"(select cluster, row_ord % {F2.side} as x, floor(row_ord / {F2.side}.0) as y from zones join part using (zone_id))"


def of_written(spark: SparkSession, folder: str, query, **given) -> DataFrame:
    """A query of the grid world over the written tables."""
    return query(spark, folder, w=located(spark, folder), **given)


_GRAPH = _with(_sql_world(F2), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH)
_TERMS = _with(_sql_world(F2), _SQL_PART, _SQL_TERMS)

PARTITIONS = [("free", F1, FREE, False), ("forced", F1, FORCED, False), ("pieces", F1, FORCED, True), ("large", F2, WHOLE, False)]

QUERIES = {
    "norm_keys": norm_keys,
    "zones_first": zones_first,
    "centroids": centroids,
    "bad_endpoints": bad_endpoints,
    "flow_edges": flow_edges,
    "weighted_median": weighted_median,
    "flow_weights": flow_weights,
    "glue": glue,
    "sym_edges": sym_edges,
    "self_loops": self_loops,
    "norm_once": partial(norm_edges, times=1),
    "norm_twice": partial(norm_edges, times=2),
    "hosp_inflow": hosp_inflow,
    **{f"features_{m}": partial(feature_matrix, mode=m) for m in ("coords", "coords_pop", "coords_hosp_inflow", "coords_pop_hosp_inflow")},
    **{f"diffuse_k{k}": partial(diffuse_k, hops=k) for k in range(1, 6)},
    "embedding": embedding,
    "embedding_features": embedding_features,
    "embedding_written": embedding_written,
    "gcn_embedding": gcn_embedding,
    "out_in_degree": out_in_degree,
    "modularity_terms": modularity_terms,
    "li_by_cluster": li_by_cluster,
    "total_modularity": total_modularity,
    "cluster_attrs": cluster_attrs,
    "cluster_caps": cluster_caps,
    "attach_cluster": attach_cluster,
    "edge_costs": edge_costs,
    "components": components,
    "mst_edges": mst_edges,
    "written_forest": written_forest,
    "subtree_stats": subtree_stats,
    "first_cuts": first_cuts,
    "best_cut_level1": best_cut_level1,
    **{f"partition_{name}_{'local' if local else 'level'}": partial(partition_grid, grid=grid, limits=limits, local=local, pieces=pieces) for name, grid, limits, pieces in PARTITIONS for local in (True, False)},
    "partition_full": partition_full,
    "partition_result": partition_result,
    "partition_written": partition_written,
    "rook_edges": partial(touching, mode="rook"),
    "queen_edges": partial(touching, mode="queen"),
    "touching_written": touching_written,
    **{f"features_{m}_written": partial(of_written, query=feature_matrix, mode=m) for m in ("coords", "coords_pop", "coords_hosp_inflow", "coords_pop_hosp_inflow")},
    **{f"diffuse_k{k}_written": partial(of_written, query=diffuse_k, hops=k) for k in range(1, 6)},
    "gcn_embedding_written": partial(of_written, query=gcn_embedding),
    "area_perimeter": compact_blocks,
    "compactness": compactness,
}

_HOP = _with(_sql_world(F2), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0)
SQL = {
    "norm_keys": NORM_KEYS_SQL,
    "zones_first": ZONES_FIRST_SQL,
    "centroids": CENTROIDS_SQL,
    "bad_endpoints": BAD_ENDPOINTS_SQL,
    "flow_edges": _with(_sql_world(F2), _SQL_NODES, _SQL_EDGES) + "select origin, destin, flow, round(dist, 6) as dist from fe",
    "weighted_median": _with(_SQL_WRITTEN, _SQL_NODES, _SQL_EDGES) + "select round(median, 6) as median from med",
    "flow_weights": _with(_sql_world(F2), _SQL_NODES, _SQL_EDGES) + "select origin, destin, round(w, 6) as w from fw",
    "glue": _with(_SQL_WRITTEN, _SQL_NODES, _SQL_EDGES) + "select round(glue, 6) as glue from gl",
    "sym_edges": _GRAPH + "select src, dst, round(w, 6) as w from sym",
    "self_loops": _GRAPH + "select zone_id as src, zone_id as dst, round(glue, 6) as w from nodes, gl",
    "norm_once": _GRAPH + "select src, dst, round(w, 6) as w from n1",
    "norm_twice": _GRAPH + "select src, dst, round(w, 6) as w from n2",
    "hosp_inflow": _with(_SQL_WRITTEN) + "select destin as zone_id, round(sum(flow), 3) as inflow from flows join zones on destin = zone_id where origin is not null and (hosp is null or isnan(hosp) or hosp >= 0.5) group by destin",
    **{f"features_{m}": _sql_features(m) for m in ("coords", "coords_pop", "coords_hosp_inflow", "coords_pop_hosp_inflow")},
    **{f"diffuse_k{k}": _with(_sql_world(F2), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, _sql_hops(k)) + f"select zone_id, round(f0, 6) as f0, round(f1, 6) as f1 from h{k}" for k in range(1, 6)},
    "embedding": _with(_sql_world(F2), _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, _sql_hops(5)) + "select zone_id as ZoneID, round(f0, 6) as Emb_X, round(f1, 6) as Emb_Y from h5",
    "embedding_features": _SQL_EMB_F,
    "embedding_written": _with(_SQL_WRITTEN, _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, _sql_hops(5)) + "select zone_id as ZoneID, round(f0, 6) as Emb_X, round(f1, 6) as Emb_Y from h5",
    "gcn_embedding": _sql_gcn(),
    **{f"features_{m}_written": _sql_features_written(m) for m in ("coords", "coords_pop", "coords_hosp_inflow", "coords_pop_hosp_inflow")},
    **{f"diffuse_k{k}_written": _with(_SQL_WRITTEN, _SQL_NODES, _SQL_EDGES, _SQL_GRAPH, _SQL_H0, _sql_hops(k)) + f"select zone_id, round(f0, 6) as f0, round(f1, 6) as f1 from h{k}" for k in range(1, 6)},
    "gcn_embedding_written": _sql_gcn(_SQL_WRITTEN),
    "written_forest": _with(_SQL_WRITTEN, _SQL_WRITTEN_COSTS, *_SQL_MST, recursive=True) + "select u, v, round(w, 6) as w from mst",
    "out_in_degree": _with(_SQL_WRITTEN, "moves as (select origin, destin, flow from flows join zones a on origin = a.zone_id join zones b on destin = b.zone_id)") + "select zone_id, round(sum(o), 3) as out, round(sum(i), 3) as inn, round(sum(o + i), 3) as deg from (select origin as zone_id, flow as o, 0.0::double as i from moves union all select destin, 0.0::double, flow from moves) group by zone_id",
    "modularity_terms": _TERMS + "select cluster, round(internal, 6) as internal, round(outf, 6) as out, round(deg, 6) as deg, round(internal / m - power(deg / (2 * m), 2), 6) as term from terms, tot",
    "li_by_cluster": _TERMS + "select cluster, round(case when outf > 0 then internal / outf else 0 end, 6) as li from terms",
    "total_modularity": _TERMS + "select round(sum(internal / m - power(deg / (2 * m), 2)), 6) as q from terms, tot",
    "cluster_attrs": _with(_sql_world(F2), _SQL_PART) + "select cluster, count(*) as n_zones, " + ", ".join(f"round({a}({c}), 4) as {n}_{a}" for c, n in (("popu", "POPU"), ("acctbal", "acctbal"), ("hosp", "hosp")) for a in ("sum", "min", "max")) + " from zones join part using (zone_id) group by cluster",
    "cluster_caps": _with(_sql_world(F2), _SQL_PART) + f"select cluster, round(sum(popu), 4) as POPU, round(sum(acctbal), 4) as acctbal from zones join part using (zone_id) group by cluster having sum(popu) > {CAPS['POPU']} or sum(acctbal) > {CAPS['acctbal']}",
    "attach_cluster": _with(_sql_world(F2), _SQL_PART) + f"select c_custkey, cluster from customer left join part on zone_id = cast(c_custkey % {F2.side**2} as varchar)",
    "edge_costs": _with(_sql_world(F2), _SQL_COSTS) + "select u, v, round(w, 6) as w from costs",
    "components": COMPONENTS_SQL,
    "mst_edges": _with(_sql_world(F2), _SQL_COSTS, *_SQL_MST, recursive=True) + "select u, v, round(w, 6) as w from mst",
    "subtree_stats": _with(_sql_world(F1), _SQL_COSTS, *_SQL_MST, *_SQL_SIDES, recursive=True) + "select u, v, n, round(popu, 6) as popu, round(hosp, 6) as hosp from mst join sums using (k)",
    "first_cuts": _with(_sql_world(F2), _SQL_COSTS, *_SQL_MST, *_SQL_SIDES, recursive=True) + "select u, v, round(gain, 6) + 0.0::double as gain from mst join gains using (k)",
    "best_cut_level1": _with(_sql_world(F1), _SQL_COSTS, *_SQL_MST, *_SQL_SIDES, _SQL_FIRST, recursive=True) + "select 'lower' as part, n, round(popu, 6) as popu from top union all select 'upper', n_t, round(popu_t, 6) from top",
    **{f"partition_{name}_{way}": _sql_partition(grid, limits, pieces) for name, grid, limits, pieces in PARTITIONS for way in ("local", "level")},
    "partition_written": _SQL_PARTITION_WRITTEN + _SQL_TOLD,
    "partition_full": _sql_embedded(F2, WHOLE) + _SQL_TOLD,
    "partition_result": _sql_embedded(F2, WHOLE) + "," + _sql_shapes(f"(select cluster, i % {F2.side} as x, floor(i / {F2.side}.0) as y from (select cluster, cast(zone_id as integer) as i from placed))", F2.side)
    + "\nselect told.* exclude (Comm_LI, Comm_Pop, Comm_Hosp), Comm_LI, Comm_Pop, Comm_Hosp, reock, polsby_popper from told join shapes using (cluster)",
    "rook_edges": _sql_touching("rook"),
    "queen_edges": _sql_touching("queen"),
    "touching_written": TOUCHING_WRITTEN_SQL,
    "area_perimeter": _with(_sql_world(F2), _SQL_PART, _sql_shapes(_BLOCK_SQUARES, F2.side)) + "select cluster, area, perimeter, polsby_popper from shapes",
    "compactness": _with(_sql_world(F2), _sql_shapes(f"({_SQL_RAGGED})", F2.side)) + "select cluster, area, perimeter, reock, polsby_popper from shapes",
}
