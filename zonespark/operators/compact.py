"""Dissolved shapes of clusters and their compactness, for polygons that cover the plane without overlap.

The border of a cluster is made of the segments that occur once among its members, its area is the sum
of theirs; neither needs a union of polygons. The convex hull is thinned in each task before the
points of a cluster meet: a point that is on no hull of its task's points is on no hull of all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_degrees, polygon_area, reproject, segments, vertices


def borders(zones: DataFrame, cluster: str = "cluster", geometry: str = "geometry") -> DataFrame:
    """``cluster, ax, ay, bx, by``: the segments of each cluster's border."""
    each = zones.where(F.col(geometry).isNotNull()).select(cluster, F.explode(segments(F.col(geometry))).alias("s")).select(cluster, "s.*")
    return each.groupBy(cluster, "ax", "ay", "bx", "by").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three if all points are on a line."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def shoelace(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = (corners - corners[0]).T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def hull_areas(zones: DataFrame, cluster: str = "cluster", geometry: str = "geometry") -> DataFrame:
    """``cluster, hull_area``."""
    points = zones.where(F.col(geometry).isNotNull()).select(F.col(cluster).alias("cluster"), F.explode(vertices(F.col(geometry))).alias("p")).select("cluster", F.col("p")["x"].alias("x"), F.col("p")["y"].alias("y"))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for b in batches:
            for c, g in b.groupby("cluster"):
                own = g[["x", "y"]].to_numpy()
                kept[c] = hull(np.concatenate([kept[c], own]) if c in kept else own)
        for c, corners in kept.items():
            yield pd.DataFrame({"cluster": c, "x": corners[:, 0], "y": corners[:, 1]})

    def area(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]], "hull_area": [shoelace(hull(frame[["x", "y"]].to_numpy()))]})

    kind = points.schema["cluster"].dataType.simpleString()
    thinned = points.mapInPandas(thin, points.schema)
    return thinned.groupBy("cluster").applyInPandas(area, f"cluster {kind}, hull_area double").withColumnRenamed("cluster", cluster)


def compactness(zones: DataFrame, cluster: str = "cluster", geometry: str = "geometry", degrees: bool = False, crs: str | None = None) -> DataFrame:
    """``cluster, area, perimeter, reock, polsby_popper`` of each cluster.

    ``reock`` is area over convex-hull area, ``polsby_popper`` 4 pi area over squared perimeter; both are 0
    where a cluster has no area, null where none of its zones has a geometry. ``degrees``, or ``crs`` as the name or
    text of a reference system, tells that coordinates are longitudes and latitudes, to be projected to equal-area metres first."""
    degrees = degrees or (crs is not None and in_degrees(crs))
    zones = zones.select(cluster, F.col(geometry).alias("_g"))
    if degrees:
        zones = zones.withColumn("_g", reproject(F.col("_g")))
    areas = zones.where("_g is not null").groupBy(cluster).agg(F.sum(polygon_area(F.col("_g"))).alias("area"))
    length = borders(zones, cluster, "_g").groupBy(cluster).agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("perimeter"))
    joined = zones.select(cluster).distinct().join(areas, cluster, "left").join(length, cluster, "left").join(hull_areas(zones, cluster, "_g"), cluster, "left")
    some = F.col("area").isNotNull()
    return joined.select(
        cluster,
        "area",
        "perimeter",
        F.when(some, F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).otherwise(0.0)).alias("reock"),
        F.when(some, F.when((F.col("perimeter") >= 1e-12) & (F.col("area") > 0), F.lit(4 * math.pi) * F.col("area") / F.pow("perimeter", F.lit(2))).otherwise(0.0)).alias("polsby_popper"),
    )


def dissolved(zones: DataFrame, cluster: str = "cluster", geometry: str = "geometry") -> DataFrame:
    """``cluster, geometry`` with the dissolved shape as rings (``array<array<struct<x,y>>>``), the ring of largest area
    first. A task holds the border of one cluster."""
    border = borders(zones, cluster, geometry).withColumnRenamed(cluster, "cluster")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple, list[tuple]] = {}
        for a, b in zip(zip(frame["ax"], frame["ay"], strict=True), zip(frame["bx"], frame["by"], strict=True), strict=True):
            ends.setdefault(a, []).append(b)
            ends.setdefault(b, []).append(a)
        rings = []
        for start in sorted(ends):
            while ends[start]:
                ring, at = [start], start
                while True:
                    to = min(ends[at])
                    ends[at].remove(to)
                    ends[to].remove(at)
                    ring.append(to)
                    at = to
                    if at == start or not ends[at]:
                        break
                rings.append(ring)
        rings.sort(key=lambda r: -shoelace(np.array(r[:-1])))
        return pd.DataFrame({"cluster": [frame["cluster"].iloc[0]], "geometry": [[[{"x": x, "y": y} for x, y in r] for r in rings]]})

    kind = border.schema["cluster"].dataType.simpleString()
    return border.groupBy("cluster").applyInPandas(link, f"cluster {kind}, geometry array<array<struct<x: double, y: double>>>").withColumnRenamed("cluster", cluster)
