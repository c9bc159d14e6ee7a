"""Which polygons touch: shared vertices (queen) or shared edges (rook), as an equi-join on coordinates.

No pair of polygons is compared that does not share a vertex or an edge. At a vertex where many polygons
meet all of their pairs are neighbours, which is the result itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import segments, vertices
from .prepare import adjacency_of


def polygon_neighbours(zones: DataFrame, mode: str, key: str = "zone_id", geometry: str = "geometry") -> DataFrame:
    """``focal, neighbor`` of touching polygons, each pair once with the lesser id first."""
    if geometry not in zones.columns:
        raise TypeError("contiguity of polygons needs a geometry column")
    parts = {"queen": vertices, "rook": segments}.get(mode)
    if parts is None:
        raise ValueError(f"unknown contiguity: {mode}")
    shared = zones.where(F.col(key).isNotNull() & F.col(geometry).isNotNull()).select(F.col(key).alias("zone"), F.explode(parts(F.col(geometry))).alias("part"))
    if mode == "rook":
        keys = ["ax", "ay", "bx", "by"]
    else:
        keys = ["x", "y"]
    at = shared.select("zone", *[F.col("part")[k].alias(k) for k in keys])
    left, right = at.withColumnRenamed("zone", "focal"), at.withColumnRenamed("zone", "neighbor")
    return left.join(right, keys).where("focal < neighbor").select("focal", "neighbor").distinct()


def contiguity(zones: DataFrame, w: DataFrame | str) -> DataFrame:
    """``focal, neighbor`` from an adjacency table, or from polygons by "queen" or "rook"."""
    if isinstance(w, DataFrame):
        return adjacency_of(w)
    if isinstance(w, str) and w.strip().lower() in ("queen", "rook"):
        return polygon_neighbours(zones, w.strip().lower())
    raise ValueError(f"contiguity must be a table, 'queen' or 'rook', not {w!r}")
