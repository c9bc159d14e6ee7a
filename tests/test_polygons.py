import math
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from zonespark.functions.geometry import albers, centroid, in_degrees, polygon_area
from zonespark.operators.compact import compactness, dissolved
from zonespark.operators.contiguity import contiguity, polygon_neighbours
from zonespark.plans.api_queries import csv_adjacency, csv_flows
from zonespark.sources.regions import read_adjacency, read_flows, read_geojson, read_projection, read_shapefile, shapefile_bytes, shapes

RINGS = "array<array<struct<x: double, y: double>>>"


def square(x, y, side=1.0, turn=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return ring[::-1] if turn else ring


def grid(spark, cells, cluster=0):
    return spark.createDataFrame([(f"{x}{y}", cluster, [square(float(x), float(y), turn=(x + y) % 2 == 1)]) for x, y in cells], f"zone_id string, cluster int, geometry {RINGS}")


def test_area_and_centroid(spark):
    shapes = [[square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0, True)], [square(1e6, 1e6, 2.0)], [[]], [], None, [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]], [square(0.0, 0.0, 4.0), square(2.0, 0.0, 2.0)]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"i int, g {RINGS}").select("i", polygon_area(F.col("g")).alias("a"), centroid(F.col("g")).alias("c")).orderBy("i").collect()
    assert [r["a"] for r in rows] == [12.0, 4.0, 0.0, 0.0, None, 0.0, 12.0]
    assert [r["c"] and (r["c"]["x"], r["c"]["y"]) for r in rows] == [(2.0, 2.0), (1e6 + 1, 1e6 + 1), None, None, None, None, (pytest.approx(20 / 12), pytest.approx(28 / 12))]


def test_neighbours_of_four_squares(spark):
    four = grid(spark, [(0, 0), (0, 1), (1, 0), (1, 1)])
    assert polygon_neighbours(four, "rook").count() == 4
    assert polygon_neighbours(four, "queen").count() == 6
    assert all(r["focal"] < r["neighbor"] for r in contiguity(four, " Queen ").collect())
    for w in ("bishop", 3):
        with pytest.raises(ValueError):
            contiguity(four, w)
    assert polygon_neighbours(four.withColumn("geometry", F.lit(None).cast(RINGS)), "rook").count() == 0


def test_compactness(spark):
    four = compactness(grid(spark, [(0, 0), (0, 1), (1, 0), (1, 1)])).first()
    assert (four["area"], four["perimeter"], four["reock"]) == (4, 8, 1) and four["polsby_popper"] == pytest.approx(math.pi / 4)
    bent = compactness(grid(spark, [(0, 0), (1, 0), (0, 1)])).first()
    assert (bent["area"], bent["perimeter"]) == (3, 8) and bent["reock"] == pytest.approx(3 / 3.5)
    none = compactness(grid(spark, [(0, 0)]).withColumn("geometry", F.lit(None).cast(RINGS))).first()
    assert none["reock"] is None and none["polsby_popper"] is None


def test_dissolved_ring_has_a_hole(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    shape = dissolved(grid(spark, ring)).first()["geometry"]
    assert [len(r) for r in shape] == [13, 5] and shape[0][0] == shape[0][-1]


def test_albers(spark):
    # the projection's own origin and a scale check: a degree of latitude is about 111 km
    row = spark.range(1).select(albers(F.lit(-96.0), F.lit(23.0)).alias("o"), albers(F.lit(-96.0), F.lit(38.0)).alias("a"), albers(F.lit(-96.0), F.lit(39.0)).alias("b")).first()
    assert abs(row["o"]["x"]) < 1e-6 and abs(row["o"]["y"]) < 1e-6 and 109_000 < row["b"]["y"] - row["a"]["y"] < 113_000
    world = spark.createDataFrame([(0, [[(-90.0, 40.0), (-89.0, 40.0), (-89.0, 41.0), (-90.0, 41.0), (-90.0, 40.0)]])], f"cluster int, geometry {RINGS}")
    # a cell of one degree by its exact area on the sphere of equal area, about 9 395 square km
    assert compactness(world, degrees=True).first() == compactness(world, crs="EPSG:4326").first()
    assert compactness(world, degrees=True).first()["area"] == pytest.approx(9.395e9, rel=0.01)


def test_delimited_and_geojson(spark, tmp_path):
    (tmp_path / "od.csv").write_text("Origin,Destin,Flow\n007,1, 2.5\n1,,x\n")
    assert [tuple(r) for r in read_flows(spark, str(tmp_path / "od.csv")).collect()] == [("007", "1", 2.5), ("1", None, None)]
    assert read_adjacency(spark, str(tmp_path / "od.csv")).columns == ["Origin", "Destin", "Flow"]
    (tmp_path / "z.json").write_text(
        '{"type":"Feature","properties":{"ZoneID":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}\n'
        '{"type":"Feature","properties":{"ZoneID":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}\n'
    )
    rows = {r["ZoneID"]: r["geometry"] for r in read_geojson(spark, str(tmp_path / "z.json")).collect()}
    assert [len(x) for x in rows["a"]] == [4] and len(rows["b"]) == 2 and rows["b"][1][0]["x"] == 5.0


def shapefile():
    fields = [("ZoneID", "C", 6), ("POPU", "N", 8)]
    return shapefile_bytes([("007", 12.5), ("b", 3), ("", "********")], fields, [[square(0.0, 0.0)], [square(0.0, 0.0, 4.0), square(1.0, 1.0)], None])


def check_shapes(df, times=1):
    rows = sorted(df.collect(), key=lambda r: (r["ZoneID"] or "~"))
    assert [(r["ZoneID"], r["POPU"]) for r in rows] == [x for x in (("007", 12.5), ("b", 3.0), (None, None)) for _ in range(times)]
    assert len(rows[times]["geometry"]) == 2 and rows[-1]["geometry"] is None
    assert sorted((r[0] or 0 for r in df.select(polygon_area(F.col("geometry"))).collect())) == [x for x in (0, 1.0, 15.0) for _ in range(times)]


def test_shapefile(spark, tmp_path):
    shp, dbf = shapefile()
    for name in ("z.zip", "y.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("in/zones.shp", shp)
            z.writestr("in/zones.dbf", dbf)
            if name == "z.zip":
                z.writestr("in/zones.prj", 'GEOGCS["GCS_North_American_1983"]')
    (tmp_path / "plain.shp").write_bytes(shp)
    (tmp_path / "plain.dbf").write_bytes(dbf)
    check_shapes(read_shapefile(spark, str(tmp_path / "z.zip")))
    check_shapes(read_shapefile(spark, str(tmp_path / "plain.shp")))
    check_shapes(read_shapefile(spark, f"{tmp_path / 'z.zip'};{tmp_path / 'plain.shp'}"), 2)
    assert in_degrees(read_projection(spark, str(tmp_path / "z.zip"))) and read_projection(spark, str(tmp_path / "y.zip")) is None
    assert read_projection(spark, str(tmp_path / "plain.shp")) is None
    (tmp_path / "plain.prj").write_text('PROJCS["Albers"]')
    assert not in_degrees(read_projection(spark, str(tmp_path / "plain.shp"))) and not in_degrees("EPSG:5070") and in_degrees("epsg:4326")
    with pytest.raises(ValueError):
        in_degrees("moon")
    with pytest.raises(ValueError):
        list(shapes(b"\0" * 100 + struct.pack(">ii", 1, 2) + struct.pack("<i", 3)))


def test_written_values_come_back(spark, tmp_path):
    nan = float("nan")
    texts = [None, "", " ", "\\N", "\\", '"', '\\"', ",", "\r", "a\r\nb", " x\t", "NaN", "null", "#x"]
    numbers = [None, nan, math.inf, -math.inf, -0.0, 5e-324, 1 / 3]
    rows = [(a, b, numbers[(i * 3 + j) % len(numbers)]) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    spark.createDataFrame(rows, "Origin string, Destin string, Flow double").write.parquet(f"{tmp_path}/df_flow.parquet")
    spark.createDataFrame(rows, "focal string, neighbor string, BorderKm double").write.parquet(f"{tmp_path}/df_adj.parquet")
    assert Counter(map(repr, (tuple(r) for r in csv_flows(spark, str(tmp_path)).collect()))) == Counter(map(repr, rows))
    kept = [(a.strip(), b.strip()) for a, b, _ in rows if a and b and a.strip() and b.strip()]
    assert Counter(tuple(r) for r in csv_adjacency(spark, str(tmp_path)).collect()) == Counter(kept)
