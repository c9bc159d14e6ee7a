"""Queries of readers, preparation, settings, checks and the public classes, with the SQL that states the same results.

They run over the written tables, whole, or over the grid worlds of ``region_queries``."""

from __future__ import annotations

import math
import uuid
from functools import partial
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import albers, polygon_area
from ..functions.keys import is_number
from ..operators import contiguity, diffuse, features, flow_graph, metrics, partition, prepare, validate
from ..sources import regions
from ..sources.tables import table
from . import config
from . import region_queries as R
from .config import PartitionConfig, PipelineConfig
from .regionalize import Embedder, Partitioner, attach, embed_zones, partition_table, per_cluster, run_pipeline
from .runtime import scratch_path, write_bytes

r6 = R.r6
_with = R._with

# --- readers: the tables written in a format and read again


#: What stands for null is new in every process, since any fixed text can be a value itself.
CSV = {"header": True, "quoteAll": True, "escape": '"', "nullValue": uuid.uuid4().hex, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}
#: Written values hold line breaks.
READ = {**{k: v for k, v in CSV.items() if k not in ("header", "quoteAll")}, "multiLine": True}


def csv_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The flow table through delimited files."""
    path = scratch_path(spark, "flows-csv")
    table(spark, folder, "df_flow").select("Origin", "Destin", "Flow").write.options(**CSV).csv(path)
    return regions.read_flows(spark, path, **READ)


def csv_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """The adjacency table through delimited files whose header is written in another case, in its normal form."""
    path = scratch_path(spark, "adjacency-csv")
    table(spark, folder, "df_adj").select(F.col("focal").alias("FOCAL"), F.col("neighbor").alias("Neighbor"), "BorderKm").write.options(**CSV).csv(path)
    return prepare.adjacency_of(regions.read_adjacency(spark, path, **READ))


def geojson_zones(spark: SparkSession, folder: str) -> DataFrame:
    """The zone shapes through GeoJSON: rings, vertices and area of each record."""
    path = scratch_path(spark, "zones-geojson")
    rings = F.transform("geometry", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    shape = F.when(F.col("geometry").isNotNull(), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("row_id").alias("properties"), shape.alias("geometry"))
    table(spark, folder, "coords_df").select(F.to_json(feature).alias("value")).write.text(path)
    return _drawn(regions.read_geojson(spark, path), "row_id")


def _drawn(df: DataFrame, *keys: str) -> DataFrame:
    corners = F.aggregate("geometry", F.lit(0), lambda n, r: n + F.size(r))
    return df.select(*keys, F.when(F.col("geometry").isNotNull(), F.size("geometry")).alias("n_rings"), corners.alias("n_points"), F.round(polygon_area(F.col("geometry")), 3).alias("area"))


_AREAS = """
rings as (select {0} as id, unnest(geometry) as ring, generate_subscripts(geometry, 1) as no from {1} where geometry is not null),
sides as (select id, no, ring[i].x - ring[1].x as x1, ring[i].y - ring[1].y as y1, ring[i + 1].x - ring[1].x as x2, ring[i + 1].y - ring[1].y as y2 from (select *, unnest(range(1, len(ring))) as i from rings)),
sized as (select id, no, abs(sum(x1 * y2 - x2 * y1)) / 2 as a from sides group by id, no),
drawn as (select id, round(sum(case when no = 1 then a else -a end), 3) as area from sized group by id),
counted as (select id, count(*) as n_rings, sum(len(ring)) as n_points from rings group by id)"""


def shapefile_areas(spark: SparkSession, folder: str) -> DataFrame:
    """The service areas, a fixed few, through a shapefile."""
    rows = table(spark, folder, "service_areas").orderBy("area_id").collect()
    fields = [("area_id", "N", 12), ("area_name", "C", 60)]
    shp, dbf = regions.shapefile_bytes([(r["area_id"], r["area_name"]) for r in rows], fields, [[[(p["x"], p["y"]) for p in ring] for ring in r["geometry"]] for r in rows])
    path = scratch_path(spark, "areas-shp")
    write_bytes(spark, f"{path}/areas.shp", shp)
    write_bytes(spark, f"{path}/areas.dbf", dbf)
    return _drawn(regions.read_shapefile(spark, f"{path}/areas.shp").withColumn("area_id", F.col("area_id").cast("bigint")), "area_id", "area_name")


# --- keys and preparation

_STRIP = r"nullif(regexp_replace({0}, '^[\s\x{{A0}}\x{{2003}}]+|[\s\x{{A0}}\x{{2003}}]+$', '', 'g'), '')"
_NORM = (
    "case when regexp_full_match("
    + _STRIP
    + r", '[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?') then cast(cast(trunc(try_cast(replace("
    + _STRIP
    + ", '_', '') as double)) as bigint) as varchar) else "
    + _STRIP
    + " end"
)


def _ordered(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "coords_df").withColumn("row_ord", F.col("row_id"))


def external_places(spark: SparkSession, folder: str) -> DataFrame:
    """The zones' coordinates taken as an embedding made elsewhere; repeated ids stay."""
    made = prepare.external_embedding(table(spark, folder, "coords_df"), "ZoneID", "XCoord", "YCoord")
    return made.select("ZoneID", "Emb_X", "Emb_Y")


def zones_with_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the normal form of its id."""
    return prepare.with_zone_id(_ordered(spark, folder), "ZoneID").select("row_id", "zone_id")


def zones_by_place(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its place as its id."""
    return prepare.with_zone_id(_ordered(spark, folder), None).select("row_id", "zone_id")


def zones_unique(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of each written id, with coordinates or without."""
    return prepare.unique_zones(_ordered(spark, folder)).select("zone_id", "row_id")


def zones_partition(spark: SparkSession, folder: str) -> DataFrame:
    """The zone table of the partition stage, by the ids as written."""
    return prepare.partition_zones(_ordered(spark, folder), "ZoneID").select("zone_id", "row_id", "ZoneName")


def zones_named_xy(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates from two named columns of text, of which every fifth can't be read."""
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.when(F.col("row_id") % 5 == 0, " m").otherwise(""))
    df = _ordered(spark, folder).select("row_ord", "row_id", "ZoneID", text("XCoord").alias("east"), text("YCoord").alias("north"))
    return prepare.embedding_zones(df, "ZoneID", "east, north").select("zone_id", "row_id", r6("XCoord").alias("XCoord"), r6("YCoord").alias("YCoord"))


def zones_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinates from the shapes, for want of columns."""
    df = _ordered(spark, folder).select("row_ord", "row_id", "ZoneID", "geometry")
    return prepare.embedding_zones(df, "ZoneID").select("zone_id", "row_id", F.round("XCoord", 4).alias("cx"), F.round("YCoord", 4).alias("cy"))


_FIRST = f"firsts as (select *, {_NORM.format('ZoneID')} as zone_id from coords_df), kept as (select * from firsts where zone_id is not null qualify row_number() over (partition by zone_id order by row_id) = 1)"


# --- settings

#: Bounds a set of constraints is made of, each there or not; the last repeats the first with another value.
BOUNDS = [("POPU", "min", 10.0), ("POPU", "max", 20.0), ("beds", "min", 30.0), ("beds", "max", 40.0), ("hosp", "min", 50.0), ("hosp", "max", 60.0), ("POPU", "min", 70.0)]


def _sets() -> list[tuple[int, list[tuple[str, str, float]]]]:
    return [(k, [b for i, b in enumerate(BOUNDS) if k >> i & 1]) for k in range(1 << len(BOUNDS))]


def inferred_population(spark: SparkSession, folder: str) -> DataFrame:
    """The population column that each set of constraints implies."""
    return spark.createDataFrame([(k, config.population_column_of(own)) for k, own in _sets()], "k int, population string")


def routed_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """The settings that each set of constraints leads to, for either population column and with or without a named hospital column."""
    rows = []
    for (k, own), population, hospital in product(_sets(), ("POPU", "beds"), (None, "beds")):
        c = config.partition_config(own, population, hospital)
        rows.append((k, population, hospital or "", float(c.min_population), float(c.max_population), float(c.min_hospitals), c.hospital_column, *[c.min_per_child_attributes.get(n) for n in ("POPU", "beds", "hosp")], *[c.max_cluster_attributes.get(n) for n in ("POPU", "beds", "hosp")]))
    names = "min_popu double, min_beds double, min_hosp double, max_popu double, max_beds double, max_hosp double"
    return spark.createDataFrame(rows, f"k int, population string, named string, min_population double, max_population double, min_hospitals double, hospital_column string, {names}")


_SQL_SETS = "b(i, col, mode, v) as (values " + ", ".join(f"({i}, '{c}', '{m}', {v}::double)" for i, (c, m, v) in enumerate(BOUNDS)) + f"), sets as (select cast(range as integer) as k from range({1 << len(BOUNDS)})), own as (select k, b.* from sets join b on (k >> i) & 1 = 1)"
INFERRED_SQL = f"""with {_SQL_SETS},
kinds as (select k, col, bool_or(mode = 'min') as low, bool_or(mode = 'max') as high from own group by k, col)
select k, coalesce(max(case when low and high and col = 'POPU' then col end), min(case when low and high then col end), min(case when high and not low then col end), min(case when low and not high then col end), 'POPU') as population from sets left join kinds using (k) group by k"""
ROUTED_SQL = f"""with {_SQL_SETS},
cases as (select k, p.population, n.named from sets, (values ('POPU'), ('beds')) p(population), (values (''), ('beds')) n(named)),
flags as (select k, population, named, case when named <> '' then named else (select arg_min(col, i) from own where own.k = c.k and mode = 'min' and col = 'hosp') end as flag from cases c),
each as (select f.k, f.population, f.named, f.flag, o.col, o.mode, o.v, o.i, case when o.col = f.population then 'population' when o.col = f.flag and o.mode = 'min' then 'flag' else 'other' end as kind from flags f left join own o on o.k = f.k)
select k, population, named, coalesce(arg_max(v, i) filter (kind = 'population' and mode = 'min'), 10000) as min_population, coalesce(arg_max(v, i) filter (kind = 'population' and mode = 'max'), 500000) as max_population,
  coalesce(arg_max(v, i) filter (kind = 'flag'), 0) as min_hospitals, flag as hospital_column, """ + ", ".join(f"arg_max(v, i) filter (kind = 'other' and mode = '{m}' and col = '{c}') as {m}_{c.lower()}" for m in ("min", "max") for c in ("POPU", "beds", "hosp")) + " from each group by k, population, named, flag"  # fmt: skip

#: Columns of tables, names given, and the three that count.
FLOW_ROUTES = [("Flow,Origin,Destin,x", "", "Origin,Destin,Flow"), ("a,b,c,d", "", "a,b,c"), ("a,b,c,d", "d,c,b", "d,c,b"), ("a,b,c,d", "d,,b", "a,b,c"), ("x,Origin,Destin,Flow", "x,Destin,Flow", "x,Destin,Flow"), ("origin,Destin,Flow", "", "origin,Destin,Flow"), ("a,b", "", "ValueError")]
HOSPITAL_ROUTES = [("POPU,HOSP,hosp", "hosp"), ("HOSP,has_hosp,Hosp_ZoneI", "Hosp_ZoneI"), ("has_hosp,HOSP", "HOSP"), ("has_hosp", "has_hosp"), ("Hosp,hOSP", "KeyError")]
COORDINATE_ROUTES = [("x,y", "x|y"), (" lon , lat ", "lon|lat"), ("  ", "None"), ("x", "ValueError"), ("x,y,z", "ValueError"), ("x,", "ValueError"), ("my x,my y", "my x|my y")]


def _outcome(call) -> str:
    """What a call gives, or the kind of its error."""
    try:
        return str(call())
    except (ValueError, KeyError, TypeError, RuntimeError) as e:
        return type(e).__name__


def named_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns that the rules of names pick."""
    frame = lambda names: spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names.split(",")))
    kept = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = [("flow", f"{names};{given}", _outcome(lambda n=names, g=given: ",".join(config.flow_columns(frame(n), *(g.split(",") if g else ()))))) for names, given, _ in FLOW_ROUTES]
        rows += [("hospital", names, _outcome(lambda n=names: config.hospital_column(frame(n)))) for names, _ in HOSPITAL_ROUTES]
    finally:
        spark.conf.set("spark.sql.caseSensitive", kept)
    rows += [("coordinates", text, _outcome(lambda t=text: "|".join(found) if (found := config.coordinate_names(t)) else None)) for text, _ in COORDINATE_ROUTES]
    return spark.createDataFrame(rows, "rule string, given string, found string")


def _quoted(*values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


NAMED_SQL = "select * from (values " + ", ".join([*[_quoted("flow", f"{a};{b}", c) for a, b, c in FLOW_ROUTES], *[_quoted("hospital", *x) for x in HOSPITAL_ROUTES], *[_quoted("coordinates", *x) for x in COORDINATE_ROUTES]]) + ") t(rule, given, found)"


# --- checks


def checks(spark: SparkSession, folder: str) -> DataFrame:
    """What the classes and functions say to inputs they must refuse, and to one they must take."""
    w = R.world(spark, folder, R.F1)
    zones = w.zones.withColumnRenamed("zone_id", "ZoneID")
    flows = w.flows.toDF("Origin", "Destin", "Flow")
    ready = zones.withColumns({"Emb_X": F.col("XCoord"), "Emb_Y": F.col("YCoord")})
    stray = flows.unionAll(spark.createDataFrame([("0", "nowhere", 1.0)], flows.schema))
    astray = w.adj.unionAll(spark.createDataFrame([("0", "nowhere")], w.adj.schema))
    cut = lambda df=ready, f=flows, adj=w.adj, **given: Partitioner(df, f, "ZoneID", w=adj, **given) and "taken"
    grown = lambda df=zones, f=flows, adj=w.adj, **given: Embedder(df, f, "ZoneID", adj, **given) and "taken"
    pose = lambda **given: partition.pose(w.zones, w.flows, w.adj, R._places(w), PartitionConfig(**given)) and "taken"
    calls = {
        "taken": cut,
        "V1 flow to an unknown zone": lambda: cut(f=stray),
        "V1 in the embedding": lambda: grown(f=stray),
        "V2 neighbour of an unknown zone": lambda: cut(adj=astray),
        "V3 no embedding": lambda: cut(zones),
        "V3 no named embedding": lambda: cut(emb=("east", "Emb_Y")),
        "V3 none in a table": lambda: partition_table(zones, flows, w.adj, zones),
        "V4 two parts": lambda: cut(constraints=[("POPU", "min")]),
        "V4 unknown mode": lambda: cut(constraints=[("POPU", "mean", 1)]),
        "V4 mode in capitals": lambda: cut(constraints=[("POPU", "MIN", 1)]),
        "V4 unknown column": lambda: cut(constraints=[("beds", "min", 1)]),
        "V5 no population": lambda: pose(population_column="residents"),
        "V5 no hospital column": lambda: pose(hospital_column="clinic"),
        "V5 no extra column": lambda: pose(max_cluster_attributes={"beds": 1.0}),
        "V6 no flow above 0": lambda: embed_zones(w.zones, w.flows.withColumn("flow", -F.col("flow")), w.adj),
        "V6 self flows alone": lambda: embed_zones(w.zones, w.flows.withColumn("destin", F.col("origin")), w.adj),
        "V7 unknown backbone": lambda: embed_zones(w.zones, w.flows, w.adj, config.EmbeddingConfig(backbone="sage")),
        "V7 unknown features": lambda: features.raw_features(w.zones, w.flows, "colour"),
        "V7 unknown contiguity": lambda: cut(adj="bishop"),
        "V8 no shapes": lambda: cut(adj="queen"),
        "V8 no id column": lambda: Embedder(zones, flows, "zone", w.adj),
        "V8 neither ends": lambda: cut(adj=w.adj.toDF("a", "b")),
    }
    return spark.createDataFrame([(name, _outcome(call)) for name, call in calls.items()], "check string, outcome string")


CHECKS_SQL = "select * from (values " + ", ".join(_quoted(*x) for x in [
    ("taken", "taken"), ("V1 flow to an unknown zone", "ValueError"), ("V1 in the embedding", "ValueError"), ("V2 neighbour of an unknown zone", "ValueError"), ("V3 no embedding", "KeyError"), ("V3 no named embedding", "KeyError"), ("V3 none in a table", "KeyError"),
    ("V4 two parts", "ValueError"), ("V4 unknown mode", "ValueError"), ("V4 mode in capitals", "taken"), ("V4 unknown column", "KeyError"), ("V5 no population", "KeyError"), ("V5 no hospital column", "KeyError"), ("V5 no extra column", "KeyError"),
    ("V6 no flow above 0", "RuntimeError"), ("V6 self flows alone", "RuntimeError"), ("V7 unknown backbone", "ValueError"), ("V7 unknown features", "ValueError"), ("V7 unknown contiguity", "ValueError"), ("V8 no shapes", "TypeError"), ("V8 no id column", "KeyError"), ("V8 neither ends", "ValueError"),
]) + ") t(\"check\", outcome)"


def first_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten ends of written flows that no zone has."""
    w = R.written(spark, folder)
    return validate.first_of(validate.unknown_endpoints(w.flows, w.zones))


def unknown_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Ends of written neighbourhoods that no zone has."""
    w = R.written(spark, folder)
    return validate.unknown_neighbours(w.adj, w.zones)


def contiguity_any(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of the grid by shapes, however the kind is written, and by a table."""
    w = R.world(spark, folder, R.F1)
    squares = R._squares(w.zones, R.F1)
    kinds = {"queen": " Queen ", "rook": "ROOK", "table": w.adj}
    found = [contiguity.contiguity(squares, given).select(F.lit(kind).alias("kind"), F.least("focal", "neighbor").alias("focal"), F.greatest("focal", "neighbor").alias("neighbor")) for kind, given in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- features, joins and counts


def features_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the grid where one zone has no population: the column says nothing any more, the others stay."""
    w = R.world(spark, folder, R.F2)
    zones = w.zones.withColumn("POPU", F.when(F.col("zone_id") != "7", F.col("POPU")))
    values, names = features.features(zones, w.flows, "coords_pop", "hosp")
    return values.select("zone_id", *[r6(n).alias(n) for n in names])


def edge_costs_default(spark: SparkSession, folder: str) -> DataFrame:
    """Costs of neighbourhoods where every third zone has no embedding and counts as (0, 0), and others have two, of which the last counts."""
    w = R.world(spark, folder, R.F2)
    z = F.col("zone_id").cast("int")
    places = R._places(w).where(z % 3 != 0)
    stale = places.where(z % 2 == 0).select("zone_id", (F.col("row_ord") - 1000).alias("row_ord"), F.lit(99.0).alias("emb_x"), F.lit(99.0).alias("emb_y"))
    return partition.costed_edges(w.adj, w.zones, stale.unionByName(places)).select("u", "v", r6("w").alias("w"))


def embed_api(spark: SparkSession, folder: str) -> DataFrame:
    """The zone table of the grid with one record twice and a zone without a place, as the class embeds it: every row stays."""
    w = R.world(spark, folder, R.F2)
    more = spark.createDataFrame([("nowhere", 5000), ("7", 5001)], "zone_id string, row_ord long")
    zones = w.zones.select("zone_id", "row_ord", "XCoord", "YCoord").unionByName(more, allowMissingColumns=True)
    made = Embedder(zones, w.flows.toDF("from", "to", "n"), "zone_id", w.adj, origin="from", destin="to", flow="n").embed("east", "north")
    return made.select("zone_id", "row_ord", r6("east").alias("east"), r6("north").alias("north"))


def two_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Each zone of the grid with the embeddings of both backbones."""
    w = R.world(spark, folder, R.F2)
    x = R._weights(w)
    operator = flow_graph.build_graph(x.edges, w.adj, w.zones, x.glue)
    values, names = features.features(w.zones, w.flows)
    plain = diffuse.sgcn(operator, values, names, 5).toDF("_zone", "x", "y")
    deep = diffuse.gcn(operator, values, names, R.GCN_LAYERS).toDF("_zone", "gx", "gy")
    return attach(attach(w.zones.select("zone_id", "row_ord"), "zone_id", plain), "zone_id", deep).select("zone_id", *[r6(c).alias(c) for c in ("x", "y", "gx", "gy")])


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many clusters the blocks of the grid are, and how many flows of it have a weight."""
    w = R.world(spark, folder, R.F2)
    return spark.createDataFrame([(metrics.cluster_count(R._blocks(w.zones)), flow_graph.flow_edges(w.flows, w.zones).count())], "n_clusters long, n_flow_edges long")


def result_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of clusters with bays and holes, given as a partition."""
    w = R.world(spark, folder, R.F2)
    label = R.ragged(w.zones)
    sums = w.zones.join(label, "zone_id").groupBy("cluster").agg(F.sum("POPU").alias("Comm_Pop"), F.sum("hosp").alias("Comm_Hosp"))
    li = metrics.modularity_terms(R._pairs(w), label).select("cluster", F.col("li").alias("Comm_LI"))
    part = label.join(sums, "cluster").join(li, "cluster").select(F.col("zone_id").alias("ZoneID"), F.col("cluster").cast("int").alias("Community_ID"), "Comm_Pop", "Comm_Hosp", "Comm_LI")
    made = per_cluster(R._squares(w.zones, R.F2), part, ["hosp", "POPU", "acctbal", "nothing"])
    return made.select(*[c if c in ("cluster", "n_zones") else F.round(c, 4).alias(c) for c in made.columns if c != "geometry"])


def projected(spark: SparkSession, folder: str) -> DataFrame:
    """Equal-area metres of the zones' coordinates, taken as degrees over the whole of a continent."""
    zones = table(spark, folder, "coords_df").where(is_number(F.col("XCoord")) & is_number(F.col("YCoord")))
    lon, lat = -96 + 40 * F.sin(F.col("XCoord") / 1000), 38 + 12 * F.sin(F.col("YCoord") / 1000)
    at = albers(lon, lat)
    return zones.select("row_id", F.round(at["x"], 3).alias("x"), F.round(at["y"], 3).alias("y"))


def _sql_albers() -> str:
    """The projection by its formulas: the ellipsoid's squared eccentricity, q of a latitude, and the cone's constants."""
    e2 = (1 / 298.257222101) * (2 - 1 / 298.257222101)
    q = f"((1 - {e2!r}) * (sin({{0}}) / (1 - {e2!r} * sin({{0}}) * sin({{0}})) - ln((1 - {math.sqrt(e2)!r} * sin({{0}})) / (1 + {math.sqrt(e2)!r} * sin({{0}}))) / (2 * {math.sqrt(e2)!r})))"
    m = f"(cos({{0}}) / sqrt(1 - {e2!r} * sin({{0}}) * sin({{0}})))"
    p1, p2, p0 = "radians(29.5::double)", "radians(45.5::double)", "radians(23.0::double)"
    return f"""
with cone as (select ({m.format(p1)} ** 2 - {m.format(p2)} ** 2) / ({q.format(p2)} - {q.format(p1)}) as n),
fixed as (select n, {m.format(p1)} ** 2 + n * {q.format(p1)} as c from cone),
z as (select row_id, -96 + 40 * sin(XCoord / 1000) as lon, radians(38 + 12 * sin(YCoord / 1000)) as lat from coords_df where XCoord is not null and not isnan(XCoord) and YCoord is not null and not isnan(YCoord)),
polar as (select row_id, 6378137.0::double * sqrt(c - n * {q.format('lat')}) / n as rho, 6378137.0::double * sqrt(c - n * {q.format(p0)}) / n as rho0, n * radians(lon + 96) as theta from z, fixed)
select row_id, round(rho * sin(theta), 3) as x, round(rho0 - rho * cos(theta), 3) as y from polar"""


# --- the pipeline


def _small_config() -> PipelineConfig:
    return PipelineConfig(partition=R._config(R.FORCED))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Both stages in one over the small grid: the clusters, and beside each the modularity and the flow of all."""
    w = R.world(spark, folder, R.F1)
    made = run_pipeline(w.zones.withColumnRenamed("zone_id", "ZoneID"), w.flows.toDF("Origin", "Destin", "Flow"), w.adj, _small_config())
    return R._told(made.part).withColumns({"modularity": F.round(F.lit(made.modularity), 6), "total_flow": F.round(F.lit(made.total_flow), 4)})


def pipeline_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding that the pipeline made on its way."""
    w = R.world(spark, folder, R.F1)
    made = run_pipeline(w.zones.withColumnRenamed("zone_id", "ZoneID"), w.flows.toDF("Origin", "Destin", "Flow"), w.adj, _small_config())
    return made.embedding.select("ZoneID", r6("Emb_X").alias("Emb_X"), r6("Emb_Y").alias("Emb_Y"))


def partition_api(spark: SparkSession, folder: str) -> DataFrame:
    """The zone table of the grid, one record twice, with the cluster of each row as the class partitions it."""
    w = R.world(spark, folder, R.F1)
    zones = R._places(w).join(w.zones.drop("row_ord"), "zone_id")
    twice = zones.unionByName(zones.where("zone_id = '3'").withColumns({"row_ord": F.lit(900).cast("long"), "POPU": F.lit(1e9)}))
    low, high, hospitals, index = R.FORCED
    cut = Partitioner(twice, w.flows.toDF("Origin", "Destin", "Flow"), "zone_id", emb=("emb_x", "emb_y"), w=w.adj, constraints=[("POPU", "min", low), ("POPU", "max", high), ("hosp", "min", hospitals)], min_local_index=index, cluster_column="region")
    return cut.partition().cluster.select("zone_id", "row_ord", "region")


_SQL_QUALITY = "quality as (select round(sum(internal / m - power(deg / (2 * m), 2)), 6) as modularity, round(any_value(m), 4) as total_flow from (select a.cluster, sum(case when a.cluster = b.cluster and out then flow else 0 end) as internal, sum(flow) as deg from (select o as here, d as there, flow, true as out from mv union all select d, o, flow, false from mv) f join placed a on f.here = a.i join placed b on f.there = b.i group by a.cluster), mm)"

QUERIES = {
    "csv_flows": csv_flows,
    "csv_adjacency": csv_adjacency,
    "geojson_zones": geojson_zones,
    "shapefile_areas": shapefile_areas,
    "external_places": external_places,
    "zones_with_id": zones_with_id,
    "zones_by_place": zones_by_place,
    "zones_unique": zones_unique,
    "zones_partition": zones_partition,
    "zones_named_xy": zones_named_xy,
    "zones_centroid": zones_centroid,
    "inferred_population": inferred_population,
    "routed_constraints": routed_constraints,
    "named_columns": named_columns,
    "checks": checks,
    "first_unknown": first_unknown,
    "unknown_neighbours": unknown_neighbours,
    "contiguity_any": contiguity_any,
    "features_missing": features_missing,
    "edge_costs_default": edge_costs_default,
    "embed_api": embed_api,
    "two_embeddings": two_embeddings,
    "counts": counts,
    "result_blocks": result_blocks,
    "projected": projected,
    "pipeline": pipeline,
    "pipeline_embedding": pipeline_embedding,
    "partition_api": partition_api,
}

_EMBEDDED = R._with(R._sql_world(R.F2), R._SQL_NODES, R._SQL_EDGES, R._SQL_GRAPH, R._SQL_H0, R._sql_hops(5))
_BLOCKED = R._with(R._sql_world(R.F2), R._SQL_PART)
_GCN = R._sql_gcn()
SQL = {
    "csv_flows": "select Origin, Destin, Flow from df_flow",
    "csv_adjacency": f"select * from (select {_NORM.format('focal')} as focal, {_NORM.format('neighbor')} as neighbor from df_adj) where focal is not null and neighbor is not null",
    "geojson_zones": "with " + _AREAS.format("row_id", "coords_df").strip() + "\nselect row_id, n_rings, n_points, area from coords_df left join counted on row_id = counted.id left join drawn on row_id = drawn.id",
    "shapefile_areas": "with " + _AREAS.format("area_id", "service_areas").strip() + "\nselect area_id, area_name, n_rings, n_points, area from service_areas join counted on area_id = counted.id join drawn on area_id = drawn.id",
    "external_places": f"select * from (select {_NORM.format('ZoneID')} as ZoneID, XCoord as Emb_X, YCoord as Emb_Y from coords_df) where ZoneID is not null",
    "zones_with_id": f"select row_id, {_NORM.format('ZoneID')} as zone_id from coords_df",
    "zones_by_place": "select row_id, cast(row_number() over (order by row_id) - 1 as varchar) as zone_id from coords_df",
    "zones_unique": f"with {_FIRST} select zone_id, row_id from kept",
    "zones_partition": f"with {_FIRST} select zone_id, row_id, ZoneName from kept",
    "zones_named_xy": f"with {_FIRST} select zone_id, row_id, " + ", ".join(f"round(case when row_id % 5 <> 0 and not isnan({c}) then {c} end, 6) as {c}" for c in ("XCoord", "YCoord")) + " from kept",
    "zones_centroid": f"with {_FIRST}, centres as ({R.CENTROIDS_SQL.strip()}) select zone_id, kept.row_id, cx, cy from kept left join centres using (row_id)",
    "inferred_population": INFERRED_SQL,
    "routed_constraints": ROUTED_SQL,
    "named_columns": NAMED_SQL,
    "checks": CHECKS_SQL,
    "first_unknown": R.BAD_ENDPOINTS_SQL + " order by zone_id limit 10",
    "unknown_neighbours": R._with(R._SQL_WRITTEN) + "select distinct zone_id from (select focal as zone_id from adj union all select neighbor from adj) where zone_id not in (select zone_id from zones)",
    "contiguity_any": R._with(R._sql_world(R.F1)) + "select kind, a.zone_id as focal, b.zone_id as neighbor from zones a join zones b on a.zone_id < b.zone_id, (values ('queen'), ('rook'), ('table')) t(kind) where case when kind = 'queen' then greatest(abs(a.row_ord % 5 - b.row_ord % 5), abs(floor(a.row_ord / 5.0) - floor(b.row_ord / 5.0))) = 1 else abs(a.row_ord % 5 - b.row_ord % 5) + abs(floor(a.row_ord / 5.0) - floor(b.row_ord / 5.0)) = 1 end",
    "features_missing": R._with(R._sql_world(R.F2)) + "select zone_id, round((x - avg(x) over ()) / stddev_pop(x) over (), 6) as f0, round((y - avg(y) over ()) / stddev_pop(y) over (), 6) as f1, 0.0::double as f2 from zones",
    "edge_costs_default": R._with(R._sql_world(R.F2), "placed as (select zone_id, case when row_ord % 3 = 0 then 0.0::double else x end as x, case when row_ord % 3 = 0 then 0.0::double else y end as y from zones)", R._SQL_COSTS.replace("join zones", "join placed")) + "select u, v, round(w, 6) as w from costs",
    "embed_api": _EMBEDDED + "select z.zone_id, z.row_ord, round(f0, 6) as east, round(f1, 6) as north from (select zone_id, row_ord from zones union all values ('nowhere', 5000), ('7', 5001)) z(zone_id, row_ord) left join h5 on z.zone_id = h5.zone_id",
    "two_embeddings": _EMBEDDED.rstrip() + f",\ndeep as ({_GCN})\nselect zone_id, round(f0, 6) as x, round(f1, 6) as y, Emb_X as gx, Emb_Y as gy from zones left join h5 using (zone_id) left join deep on deep.ZoneID = zone_id",
    "counts": R._with(R._sql_world(R.F2), R._SQL_PART) + "select (select count(distinct cluster) from part) as n_clusters, (select count(*) from flows join zones a on origin = a.zone_id join zones b on destin = b.zone_id where origin <> destin and flow > 0) as n_flow_edges",
    "result_blocks": R._with(R._sql_world(R.F2), f"ragged as ({R._SQL_RAGGED.replace('as cluster, x, y from', 'as cluster, x, y, zone_id from').replace('as y from zones', 'as y, zone_id from zones')})", R._sql_shapes("ragged", R.F2.side), "flowed as (select a.cluster, sum(case when a.cluster = b.cluster then flow else 0 end) as internal, sum(flow) as outf from flows join ragged a on origin = a.zone_id join ragged b on destin = b.zone_id group by a.cluster)")
    + "select cast(cluster as integer) as cluster, count(*) as n_zones, round(any_value(case when outf > 0 then internal / outf else 0 end), 4) as Comm_LI, round(sum(popu), 4) as Comm_Pop, round(sum(hosp), 4) as Comm_Hosp, " + ", ".join(f"round({a}({c}), 4) as {n}_{a}" for c, n in (("popu", "POPU"), ("acctbal", "acctbal"), ("hosp", "hosp")) for a in ("sum", "min", "max")) + ", round(any_value(reock), 4) as reock, round(any_value(polsby_popper), 4) as polsby_popper from zones join ragged using (zone_id) join shapes using (cluster) left join flowed using (cluster) group by cluster",
    "projected": _sql_albers(),
    "pipeline": R._sql_embedded(R.F1, R.FORCED).rstrip() + ",\n" + _SQL_QUALITY + "\n" + R._SQL_TOLD.replace("Comm_LI from", "Comm_LI, modularity, total_flow from") + ", quality",
    "pipeline_embedding": R._with(R._sql_world(R.F1), R._SQL_NODES, R._SQL_EDGES, R._SQL_GRAPH, R._SQL_H0, R._sql_hops(5)) + "select zone_id as ZoneID, round(f0, 6) as Emb_X, round(f1, 6) as Emb_Y from h5",
    "partition_api": R._sql_partition(R.F1, R.FORCED).replace(R._SQL_TOLD, "select placed.zone_id, z.row_ord, cluster as region from placed join (select zone_id, row_ord from zones union all values ('3', 900)) z(zone_id, row_ord) on placed.zone_id = z.zone_id"),
}
