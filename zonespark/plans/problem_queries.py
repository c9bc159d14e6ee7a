"""Queries p2, p4, p5 and p6 over the data tables, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import centroid
from ..functions.keys import is_full_zone_key, is_number, zone_key
from ..operators import nearby, orphans, parse_errors, skew
from ..sources.tables import table
from .runtime import materialize

NEAR_METRES = 400.0
DOMINANT_SHARE = 0.02


# --- p2: points near other points or regions


def zone_locations(spark: SparkSession, folder: str) -> DataFrame:
    """``id, x, y`` of each zone key's record with the lowest row_id; zones without a location left out."""
    coords = table(spark, folder, "coords_df")
    x, y = F.col("XCoord"), F.col("YCoord")
    both = is_number(x) & is_number(y)
    place = F.when(both, F.struct(x.alias("x"), y.alias("y"))).otherwise(centroid(F.col("geometry")))
    first = (
        coords.select(zone_key(F.col("ZoneID")).alias("key"), F.struct(F.col("row_id").alias("id"), place.alias("place")).alias("record"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("record").alias("record"))
    )
    return nearby.located(first.select("record.id", "record.place.x", "record.place.y"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Zones within 400 m of each other, and the service area that holds each zone."""
    zones = materialize(zone_locations(spark, folder), "zones")
    tree = nearby.sampled_tree(zones, NEAR_METRES)
    near = nearby.near_pairs(zones, NEAR_METRES, tree)
    inside = nearby.containing(zones, table(spark, folder, "service_areas"), tree, "area_id")
    return near.select(F.lit("near").alias("relation"), "id_a", "id_b").unionByName(inside.select(F.lit("inside").alias("relation"), F.col("region").alias("id_a"), F.col("id").alias("id_b")))


_SQL_KEY = r"nullif(upper(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]+', '', 'g')), '')"

P2_SQL = (
    r"""
with keyed as (select *, """
    + _SQL_KEY.format("ZoneID")
    + r""" as zkey from coords_df),
firsts as (select * from keyed where zkey is not null qualify row_number() over (partition by zkey order by row_id) = 1),
rings as (select row_id, unnest(geometry) as ring, generate_subscripts(geometry, 1) as ring_no from firsts where geometry is not null),
edges as (select row_id, ring_no, ring[i].x - ring[1].x as x1, ring[i].y - ring[1].y as y1, ring[i + 1].x - ring[1].x as x2, ring[i + 1].y - ring[1].y as y2, ring[1].x as ox, ring[1].y as oy
  from (select *, unnest(range(1, len(ring))) as i from rings)),
moments as (select row_id, ring_no, any_value(ox) as ox, any_value(oy) as oy, sum(x1 * y2 - x2 * y1) as a2, sum((x1 + x2) * (x1 * y2 - x2 * y1)) as mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) as my
  from edges group by row_id, ring_no),
parts as (select row_id, case when ring_no = 1 then 1.0 else -1.0 end as s, abs(a2) / 2 as a, sign(a2) * mx / 6 + ox * abs(a2) / 2 as mx, sign(a2) * my / 6 + oy * abs(a2) / 2 as my from moments),
centres as (select row_id, sum(s * mx) / sum(s * a) as cx, sum(s * my) / sum(s * a) as cy from parts group by row_id having sum(s * a) > 0),
zones as (select * from (select f.row_id as id,
    case when XCoord is null or isnan(XCoord) or YCoord is null or isnan(YCoord) then cx else XCoord end as x,
    case when XCoord is null or isnan(XCoord) or YCoord is null or isnan(YCoord) then cy else YCoord end as y
  from firsts f left join centres c on f.row_id = c.row_id) where x is not null and y is not null),
cells as (select *, cast(floor(x / 400) as bigint) as cx, cast(floor(y / 400) as bigint) as cy from zones),
spread as (select id, x, y, cx + i as cx, cy + j as cy from cells, (values (-1), (0), (1)) t(i), (values (-1), (0), (1)) u(j)),
near as (select a.id as id_a, b.id as id_b from cells a join spread b on a.cx = b.cx and a.cy = b.cy and a.id < b.id where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 400),
borders as (select area_id, ring[i].x as x1, ring[i].y as y1, ring[i + 1].x as x2, ring[i + 1].y as y2
  from (select area_id, ring, unnest(range(1, len(ring))) as i from (select area_id, unnest(geometry) as ring from service_areas))),
inside as (select area_id as id_a, id as id_b from zones join borders on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by area_id, id having count(*) % 2 = 1)
select 'near' as relation, id_a, id_b from near union all select 'inside', id_a, id_b from inside
"""
)


# --- p4: rows that fail to parse


def flow_fields() -> list[parse_errors.Field]:
    """The five fields of a flow record; Month and Remark are not judged."""

    def zone(text):
        key = zone_key(text)
        return F.when(is_full_zone_key(key), key)

    return [
        parse_errors.Field("origin", zone),
        parse_errors.Field("destin", zone),
        parse_errors.Field("flow", parse_errors.read_decimal),
        parse_errors.Field("month"),
        parse_errors.Field("remark"),
    ]


def parsed_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The raw lines of the flow files with their parse."""
    return parse_errors.parse(table(spark, folder, "flow_raw").select("line_id", "raw"), "raw", flow_fields())


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that can't be read, with the reason."""
    return parsed_flows(spark, folder).where("parsed.reason is not null").select("line_id", "parsed.reason")


def p4_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that can't be read, with the least number of quotes and delimiters to insert or delete that gives them the form."""
    return parsed_flows(spark, folder).where("parsed.reason is not null").select("line_id", "parsed.reason", F.col("parsed.cost").alias("n_edits"))


def p4_valid(spark: SparkSession, folder: str) -> DataFrame:
    """All other lines as typed flows."""
    return parsed_flows(spark, folder).where("parsed.reason is null").select("line_id", "parsed.value.*")


_FIELD = r"""("([^"]|"")*"|[^",]*)"""
_P4_BASE = rf"""
with lines as (select line_id, raw, regexp_replace(raw, '\r$', '') as r from flow_raw),
formed as (select *, regexp_full_match(r, '{_FIELD}(,{_FIELD})*', 's') as quoted_well, regexp_full_match(r, '{_FIELD}(,{_FIELD}){{4}}', 's') as five,
  regexp_extract(r, '^(?s:{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD})$', ['f1','q1','f2','q2','f3','q3','f4','q4','f5','q5']) as f from lines),
bare as (select line_id, quoted_well, five, {", ".join(f"case when f.f{i} like '\"%' then replace(f.f{i}[2:-2], '\"\"', '\"') else f.f{i} end as f{i}" for i in range(1, 6))} from formed),
typed as (select *, {_SQL_KEY.format("f1")} as k1, {_SQL_KEY.format("f2")} as k2, regexp_replace(f3, '^[ \t]+|[ \t]+$', '', 'g') as n from bare),
judged as (select *, case when not quoted_well then 'quoting' when not five then 'columns'
  when not coalesce(regexp_full_match(k1, '[A-Z]{{2}}[0-9]{{7}}[A-Z]?'), false) or not coalesce(regexp_full_match(k2, '[A-Z]{{2}}[0-9]{{7}}[A-Z]?'), false)
    or not regexp_full_match(n, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') or not coalesce(isfinite(try_cast(n as double)), false) then 'value' end as reason from typed)
"""
# the same program character by character; states: 0 at a field's start, 1 in a bare field, 2 inside quotes, 3 after a quote inside
P4_REPAIRS_SQL = (
    _P4_BASE.replace("with lines", "with recursive lines")
    + """,
bad as materialized (select line_id, reason, r from judged join lines using (line_id) where reason is not null),
put(s, t, dk, c) as (values (0,0,0,0), (1,1,0,0), (2,2,0,0), (3,3,0,0), (2,3,0,1), (3,2,0,1), (0,2,0,1), (0,0,1,1), (1,0,1,1), (3,0,1,1), (2,0,1,2), (0,2,1,2), (1,2,1,2), (3,2,1,2), (2,2,1,3)),
take(s, kind, t, dk, c) as (values (0,'o',1,0,0), (1,'o',1,0,0), (2,'o',2,0,0), (0,'q',2,0,0), (2,'q',3,0,0), (3,'q',2,0,0), (0,'d',0,1,0), (1,'d',0,1,0), (3,'d',0,1,0), (2,'d',2,0,0),
  (0,'q',0,0,1), (1,'q',1,0,1), (2,'q',2,0,1), (3,'q',3,0,1), (0,'d',0,0,1), (1,'d',1,0,1), (2,'d',2,0,1), (3,'d',3,0,1)),
step(s, kind, t, dk, c) as materialized (select p.s, kind, m.t, p.dk + m.dk, min(p.c + m.c) from put p join take m on m.s = p.t group by all),
dp(line_id, i, s, k, c) as (
  select line_id, 0, 0, 1, 0 from bad
  union all
  select line_id, i + 1, t, k, min(c) from (
    select d.line_id, d.i, m.t, d.k + m.dk as k, d.c + m.c as c from dp d join bad b using (line_id)
    join step m on m.s = d.s and m.kind = case b.r[d.i + 1] when '"' then 'q' when ',' then 'd' else 'o' end where d.i < length(b.r) and d.k + m.dk <= 5)
  group by line_id, i, t, k)
select line_id, any_value(reason) as reason, cast(min(c + 5 - k + case when s = 2 then 1 else 0 end) as integer) as n_edits from dp join bad using (line_id) where i = length(r) group by line_id"""
)
P4_SQL = _P4_BASE + "select line_id, reason from judged where reason is not null"
P4_VALID_SQL = _P4_BASE + "select line_id, k1 as origin, k2 as destin, cast(n as double) as flow, f4 as month, f5 as remark from judged where reason is null"


# --- p5: a few keys holding most records


def _flows_by_destin(spark: SparkSession, folder: str) -> tuple[DataFrame, skew.Plan]:
    flows = table(spark, folder, "df_flow").select(zone_key(F.col("Destin")).alias("destin"), F.col("Flow").alias("flow"), zone_key(F.col("Origin")).alias("origin"))
    return flows, skew.plan(flows, "destin")


def p5_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Row count, total Flow and distinct origin zones of every Destin zone; blank references left out."""
    flows, where = _flows_by_destin(spark, folder)
    totals = skew.key_totals(flows, "destin", "flow", "origin", where)
    return totals.select("destin", "n_rows", F.round("total", 3).alias("total_flow"), F.col("n_distinct").alias("n_origins"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Zone keys that hold at least 2 percent of the rows whose Destin is not blank."""
    flows, where = _flows_by_destin(spark, folder)
    return skew.dominant(skew.key_totals(flows, "destin", "flow", "origin", where), where.rows, DOMINANT_SHARE).select("destin")


def p5_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Flows joined with the zone records of their Destin by fragment and replicate: per zone the
    number of flows and of the zone's records, and the flow per head of the largest population on record."""
    flows, where = _flows_by_destin(spark, folder)
    zones = (
        table(spark, folder, "coords_df")
        .select(zone_key(F.col("ZoneID")).alias("destin"), F.when(~F.isnan("POPU"), F.col("POPU")).alias("popu"))
        .where("destin is not null")
        .groupBy("destin")
        .agg(F.count(F.lit(1)).alias("n_records"), F.max("popu").alias("popu"))
    )
    number = F.when(~F.isnan("flow"), F.col("flow"))
    return (
        skew.balanced_join(flows.select("destin", "flow"), zones, "destin", "inner", where)
        .groupBy("destin")
        .agg(F.count(F.lit(1)).alias("n_flows"), F.max("n_records").alias("n_records"), F.max("popu").alias("popu"), F.round(F.sum(number), 3).alias("total_flow"))
    )


_P5_BASE = f"with f as (select {_SQL_KEY.format('Destin')} as destin, {_SQL_KEY.format('Origin')} as origin, case when isnan(Flow) then null else Flow end as flow from df_flow) "
P5_KEYS_SQL = _P5_BASE + "select destin, count(*) as n_rows, round(sum(flow), 3) as total_flow, count(distinct origin) as n_origins from f where destin is not null group by destin"
P5_SQL = _P5_BASE + "select destin from f where destin is not null group by destin having count(*) >= 0.02 * (select count(*) from f where destin is not null)"
P5_MATCHED_SQL = (
    _P5_BASE
    + f""", z as (select {_SQL_KEY.format('ZoneID')} as destin, count(*) as n_records, max(case when isnan(POPU) then null else POPU end) as popu from coords_df group by 1)
select f.destin, count(*) as n_flows, max(n_records) as n_records, max(popu) as popu, round(sum(flow), 3) as total_flow from f join z on f.destin = z.destin group by f.destin"""
)


# --- p6: references to records that do not exist


def _zone_graph(spark: SparkSession, folder: str) -> tuple[dict[str, orphans.Node], list[orphans.Reference]]:
    """The zones, and the flows and neighbours that refer to them."""
    coords, flows, adj = (table(spark, folder, t) for t in ("coords_df", "df_flow", "df_adj"))
    nodes = {
        "coords_df": orphans.Node(coords, "row_id", zone_key(F.col("ZoneID")), F.col("AddedOn"), F.col("RemovedOn")),
        "df_flow": orphans.Node(flows, "row_id"),
        "df_adj": orphans.Node(adj, "row_id"),
    }
    edges = [orphans.Reference("df_flow", f, zone_key(F.col(f)), "coords_df", F.col("FlowDate")) for f in ("Origin", "Destin")]
    edges += [orphans.Reference("df_adj", f, zone_key(F.col(f)), "coords_df", F.col("SnapshotOn")) for f in ("focal", "neighbor")]
    return nodes, edges


def zone_references(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans of flows and adjacency towards the zones."""
    return orphans.cascade(*_zone_graph(spark, folder), every_field=True)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to zones that are missing, deleted or come later, one by one."""
    return zone_references(spark, folder).where("round = 0").select("tbl", "row_id", "field", "state")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same references as counts per table, field and month."""
    return orphans.per_period(zone_references(spark, folder))


def p6_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans, round by round, of the whole graph: flows and adjacency towards the zones, and posts
    towards the question of their thread and the older question they repeat, which may be loaded after them.
    What refers to a post that is orphaned is orphaned by inheritance."""
    docs = table(spark, folder, "documents").select("doc_id", "dup_of", F.when(F.col("thread_id") != F.col("doc_id"), F.col("thread_id")).alias("thread_id"), F.to_date("loaded_at").alias("loaded"))
    nodes, edges = _zone_graph(spark, folder)
    nodes["documents"] = orphans.Node(docs, "doc_id", F.col("doc_id"), F.col("loaded"))
    edges += [orphans.Reference("documents", f, F.col(f), "documents", F.col("loaded")) for f in ("thread_id", "dup_of")]
    return orphans.cascade(nodes, edges).select("tbl", "row_id", "field", "state", "round")


_P6_BASE = f"""
with z as (select {_SQL_KEY.format('ZoneID')} as k, min(AddedOn) as b, case when count(RemovedOn) = count(*) then max(RemovedOn) end as e from coords_df group by 1),
refs as (
  select 'df_flow' as tbl, row_id, 'Origin' as field, {_SQL_KEY.format('Origin')} as k, FlowDate as d from df_flow
  union all select 'df_flow', row_id, 'Destin', {_SQL_KEY.format('Destin')}, FlowDate from df_flow
  union all select 'df_adj', row_id, 'focal', {_SQL_KEY.format('focal')}, SnapshotOn from df_adj
  union all select 'df_adj', row_id, 'neighbor', {_SQL_KEY.format('neighbor')}, SnapshotOn from df_adj),
found as (select tbl, row_id, field, refs.k, d, case when z.k is null then 'missing' when d < b then 'late' when d >= e then 'deleted' end as state
  from refs left join z on refs.k = z.k where refs.k is not null)
"""
P6_CASCADE_SQL = (
    _P6_BASE.replace("with z as", "with recursive z as").rstrip()
    + """,
posts as (select doc_id, field, named, cast(loaded_at as date) as d from (
  select doc_id, 'thread_id' as field, thread_id as named, loaded_at from documents where thread_id <> doc_id
  union all select doc_id, 'dup_of', dup_of, loaded_at from documents where dup_of is not null)),
late as (select p.doc_id, field, named, case when q.doc_id is null then 'missing' when d < cast(q.loaded_at as date) then 'late' end as state from posts p left join documents q on q.doc_id = p.named),
reach(doc_id, round) as (select distinct doc_id, 0 from late where state is not null union select p.doc_id, r.round + 1 from reach r join posts p on p.named = r.doc_id),
level as (select doc_id, min(round) as round from reach group by doc_id)
select tbl, row_id, field, state, 0 as round from found where state is not null
union all select 'documents', doc_id, field, state, 0 from late where state is not null
union all select 'documents', p.doc_id, p.field, 'inherited', own.round from posts p join level own on own.doc_id = p.doc_id join level above on above.doc_id = p.named and above.round = own.round - 1"""
)
P6_SQL = _P6_BASE + "select tbl, row_id, field, state from found where state is not null"
P6_COUNTS_SQL = _P6_BASE + "select tbl, field, strftime(d, '%Y-%m') as month, state, count(*) as n_refs, count(distinct k) as n_keys from found where state is not null group by all"

QUERIES = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_repairs": p4_repairs,
    "p4_valid": p4_valid,
    "p5_found": p5_found,
    "p5_keys": p5_keys,
    "p5_matched": p5_matched,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p6_cascade": p6_cascade,
}
SQL = {
    "p2_found": P2_SQL,
    "p4_found": P4_SQL,
    "p4_valid": P4_VALID_SQL,
    "p4_repairs": P4_REPAIRS_SQL,
    "p5_found": P5_SQL,
    "p5_keys": P5_KEYS_SQL,
    "p5_matched": P5_MATCHED_SQL,
    "p6_found": P6_SQL,
    "p6_counts": P6_COUNTS_SQL,
    "p6_cascade": P6_CASCADE_SQL,
}
