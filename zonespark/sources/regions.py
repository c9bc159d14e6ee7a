"""Readers of the inputs of regionalization: delimited flows and adjacency, GeoJSON and shapefile polygons.

Ids are always read as text; they are normalized later. Polygons come as nested rings."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RINGS = "array<array<struct<x: double, y: double>>>"


def read_flows(spark: SparkSession, path: str, origin: str = "Origin", destin: str = "Destin", flow: str = "Flow", **options: str | bool) -> DataFrame:
    """``Origin, Destin, Flow`` of delimited files with a header; a flow that can't be read is null. ``options`` are Spark's of its CSV reader."""
    rows = spark.read.options(**options).csv(path, header=True, inferSchema=False)
    return rows.select(F.col(origin).alias("Origin"), F.col(destin).alias("Destin"), F.trim(F.col(flow)).try_cast("double").alias("Flow"))


def read_adjacency(spark: SparkSession, path: str, **options: str | bool) -> DataFrame:
    """All columns of delimited files with a header, as text. ``options`` are Spark's of its CSV reader."""
    return spark.read.options(**options).csv(path, header=True, inferSchema=False)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of files with one feature a line: its properties as columns and ``geometry`` as rings.
    Of a multipolygon the rings of all parts follow each other."""
    found = spark.read.json(path).schema["properties"].dataType
    properties = [c.name for c in found.fields]
    # coordinates of differing depth are kept as the text they are
    shape = StructType.fromDDL("geometry struct<type: string, coordinates: string>").add("properties", found)
    rows = spark.read.schema(shape).json(path)
    coordinates = F.col("geometry.coordinates")
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "MultiPolygon", multi).when(F.col("geometry.type") == "Polygon", polygon)
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select(*[F.col("properties")[c].alias(c) for c in properties], points.alias("geometry"))


def shapes(shp: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The rings of each record of a polygon shapefile; None for a null shape."""
    at = 100
    while at + 8 <= len(shp):
        words = struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (5, 15, 25):
            parts, points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            values = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            corners = list(zip(values[::2], values[1::2], strict=True))
            yield [corners[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        elif kind == 0:
            yield None
        else:
            raise ValueError(f"shape type {kind} is no polygon")
        at += 8 + 2 * words


def attributes(dbf: bytes) -> tuple[list[str], list[str], Iterator[tuple]]:
    """Names, kinds and rows of a dBase table; numbers (kinds N and F) as floats, blanks as None, all else as text."""
    rows, header, width = struct.unpack("<iHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(dbf[at + 11]), dbf[at + 16]))
        at += 32

    def read() -> Iterator[tuple]:
        for i in range(rows):
            record, place, out = dbf[header + i * width : header + (i + 1) * width], 1, []
            for _, kind, size in fields:
                text = record[place : place + size].decode("latin-1").strip()
                place += size
                out.append(None if not text or set(text) == {"*"} else float(text) if kind in "NF" else text)
            yield tuple(out)

    return [f[0] for f in fields], [f[1] for f in fields], read()


def _unpacked(shp: bytes | None, dbf: bytes | None, packed: bytes | None) -> tuple[bytes, bytes]:
    """The .shp and .dbf of a shapefile, out of its archive if it has one."""
    if packed is None:
        return bytes(shp), bytes(dbf)
    with zipfile.ZipFile(io.BytesIO(packed)) as z:
        return tuple(z.read(next(n for n in z.namelist() if n.lower().endswith(end))) for end in (".shp", ".dbf"))


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """``shp, dbf, packed``: a row for each shapefile, plain or zipped, of paths separated by ``;``. Files are read where
    Spark reads them, so that any storage will do."""
    paths = [p for p in path.split(";") if p]
    plain = [p.rsplit(".", 1)[0] for p in paths if not p.lower().endswith(".zip")]
    wanted = [*(p for p in paths if p.lower().endswith(".zip")), *(f"{p}{end}" for p in plain for end in (".shp", ".dbf"))]
    files = spark.read.format("binaryFile").load(wanted)
    kind, base = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.regexp_replace("path", r"\.[^./]+$", "")
    of = lambda end: F.max(F.when(F.col("kind") == end, F.col("content")))
    return files.select(base.alias("base"), kind.alias("kind"), "content").groupBy("base").agg(of("shp").alias("shp"), of("dbf").alias("dbf"), of("zip").alias("packed")).drop("base")


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """The attributes of polygon shapefiles and ``geometry`` as rings; null for a null shape. ``path`` names zipped files or
    .shp files beside their .dbf, several separated by ``;``, all with the columns of the first by name. A shapefile is at most
    2 GB by its format, and one task reads it. Numbers are doubles, all else is text."""
    files = _contents(spark, path)

    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                names, kinds, _ = attributes(_unpacked(row.shp, row.dbf, row.packed)[1])
                yield pd.DataFrame({"name": names, "kind": kinds})

    # as many rows as a shapefile has columns
    columns = [(r["name"], r["kind"]) for r in files.limit(1).mapInPandas(header, "name string, kind string").collect()]
    schema = ", ".join([*(f"`{n}` {'double' if k in 'NF' else 'string'}" for n, k in columns), f"geometry {RINGS}"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                shp, dbf = _unpacked(row.shp, row.dbf, row.packed)
                names, _, rows = attributes(dbf)
                at = [names.index(n) for n, _ in columns]
                both = zip(rows, shapes(shp), strict=True)
                while part := list(islice(both, 1024)):
                    made = {n: [values[i] for values, _ in part] for i, (n, _) in zip(at, columns, strict=True)}
                    yield pd.DataFrame({**made, "geometry": [None if rings is None else [[{"x": x, "y": y} for x, y in ring] for ring in rings] for _, rings in part]})

    return files.mapInPandas(records, schema)


def read_projection(spark: SparkSession, path: str) -> str | None:
    """The text of a shapefile's .prj, as ``crs`` of the compactness measures takes it; None without one."""
    if path.lower().endswith(".zip"):
        packed = spark.read.format("binaryFile").load(path).select("content").first()[0]
        with zipfile.ZipFile(io.BytesIO(packed)) as z:
            return next((z.read(n).decode("latin-1") for n in z.namelist() if n.lower().endswith(".prj")), None)
    try:
        return bytes(spark.read.format("binaryFile").load(f"{path.rsplit('.', 1)[0]}.prj").select("content").first()[0]).decode("latin-1")
    except AnalysisException:
        return None


def shapefile_bytes(rows: list[tuple], fields: list[tuple[str, str, int]], geometries: list[list | None]) -> tuple[bytes, bytes]:
    """A polygon shapefile of a few rows, as .shp and .dbf: ``fields`` are (name, C or N, width), geometries rings of (x, y)."""
    records = []
    for i, rings in enumerate(geometries, 1):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for ring in rings for p in ring]
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            xs, ys = zip(*points, strict=True)
            body = struct.pack("<i4d", 5, min(xs), min(ys), max(xs), max(ys)) + struct.pack(f"<ii{len(rings)}i", len(rings), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records.append(struct.pack(">ii", i, len(body) // 2) + body)
    width = 1 + sum(size for _, _, size in fields)
    head = struct.pack("<4BiHH", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), width) + b"\0" * 20
    told = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([size]) + b"\0" * 15 for n, k, size in fields)
    lines = b"".join(b" " + b"".join(("" if v is None else str(v)).encode("latin-1", "replace")[:size].ljust(size) for v, (_, _, size) in zip(row, fields, strict=True)) for row in rows)
    return b"\0" * 100 + b"".join(records), head + told + b"\r" + lines
