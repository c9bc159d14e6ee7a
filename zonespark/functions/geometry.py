"""Planar geometry of nested rings (``array<array<struct<x,y>>>``) as native column expressions.

The first ring is the outline, any others are holes; ring direction does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """(ax, ay, bx, by) of each edge of a ring, relative to the ring's first point, which keeps the
    cross products small beside the coordinates."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    local = F.transform(ring, lambda p: F.struct((p["x"] - ox).alias("x"), (p["y"] - oy).alias("y")))
    following = F.concat(F.slice(local, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(local, 1, 1))
    return F.zip_with(local, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def ring_moments(ring: Column) -> Column:
    """Unsigned area and first moments of a ring: struct ``a, mx, my`` (all 0 for an empty ring)."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(s: Column, e: Column) -> Column:
        cross = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct((s["a"] + cross).alias("a"), (s["mx"] + (e["ax"] + e["bx"]) * cross).alias("mx"), (s["my"] + (e["ay"] + e["by"]) * cross).alias("my"))

    def done(s: Column) -> Column:
        turn = F.when(s["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        area = F.abs(s["a"]) / 2
        ox, oy = ring[0]["x"], ring[0]["y"]
        return F.struct(area.alias("a"), (turn * s["mx"] / 6 + ox * area).alias("mx"), (turn * s["my"] / 6 + oy * area).alias("my"))

    return F.when(F.size(ring) > 0, F.aggregate(_edges(ring), zero, add, done)).otherwise(zero)


def _moments(geometry: Column) -> Column:
    """Area and first moments with holes taken out."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"), F.lit(1.0).alias("sign"))
    rings = F.filter(geometry, lambda r: r.isNotNull())

    def add(s: Column, m: Column) -> Column:
        return F.struct((s["a"] + s["sign"] * m["a"]).alias("a"), (s["mx"] + s["sign"] * m["mx"]).alias("mx"), (s["my"] + s["sign"] * m["my"]).alias("my"), F.lit(-1.0).alias("sign"))

    return F.aggregate(F.transform(rings, ring_moments), zero, add)


def polygon_area(geometry: Column) -> Column:
    """Area of the outline less the holes; null for a null geometry."""
    return _moments(geometry)["a"]


def centroid(geometry: Column) -> Column:
    """Area centroid, struct ``x, y``, holes taken out; null for null or empty geometry or one without area."""
    m = _moments(geometry)
    return F.when(m["a"] > 0, F.struct((m["mx"] / m["a"]).alias("x"), (m["my"] / m["a"]).alias("y")))


def segments(geometry: Column) -> Column:
    """The edges of all rings as array of struct ``ax, ay, bx, by`` with the lesser end first, so that
    the same border of two neighbours is the same segment. Edges without length are left out."""

    def of(ring: Column) -> Column:
        pairs = F.zip_with(
            F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
            F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))),
            lambda p, q: F.struct(F.least(F.struct(p["x"], p["y"]), F.struct(q["x"], q["y"])).alias("a"), F.greatest(F.struct(p["x"], p["y"]), F.struct(q["x"], q["y"])).alias("b")),
        )
        return F.filter(F.transform(pairs, lambda s: F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), s["b"]["x"].alias("bx"), s["b"]["y"].alias("by"))), lambda s: (s["ax"] != s["bx"]) | (s["ay"] != s["by"]))

    return F.flatten(F.transform(F.filter(geometry, lambda r: r.isNotNull() & (F.size(r) > 1)), of))


def vertices(geometry: Column) -> Column:
    """The distinct vertices of all rings, array of struct ``x, y``."""
    return F.array_distinct(F.flatten(F.filter(geometry, lambda r: r.isNotNull())))


# Fixed values of the conterminous-US Albers equal-area projection (GRS80 ellipsoid, degrees, metres).
ALBERS = {"a": 6378137.0, "inv_f": 298.257222101, "lat1": 29.5, "lat2": 45.5, "lat0": 23.0, "lon0": -96.0}


def albers(lon: Column, lat: Column, p: dict[str, float] = ALBERS) -> Column:
    """Albers equal-area coordinates of degrees, struct ``x, y`` in metres."""
    import math

    f = 1 / p["inv_f"]
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_of(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    phi1, phi2, phi0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    q0, q1, q2 = (q_of(math.sin(x)) for x in (phi0, phi1, phi2))
    n = (m_of(phi1) ** 2 - m_of(phi2) ** 2) / (q2 - q1)
    c = m_of(phi1) ** 2 + n * q1
    rho0 = p["a"] * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho = F.sqrt(c - n * q) * (p["a"] / n)
    theta = F.radians(lon - p["lon0"]) * n
    return F.struct((rho * F.sin(theta)).alias("x"), (F.lit(rho0) - rho * F.cos(theta)).alias("y"))


def reproject(geometry: Column) -> Column:
    """The rings of a geometry in degrees, in Albers metres."""
    return F.transform(geometry, lambda ring: F.transform(ring, lambda p: albers(p["x"], p["y"])))


# Names of reference systems in degrees of longitude and latitude, and how a description of one begins.
GEOGRAPHIC = ("EPSG:4326", "EPSG:4269", "OGC:CRS84")
GEOGRAPHIC_TEXT, PROJECTED_TEXT = ("GEOGCS", "GEOGCRS", "GEODCRS"), ("PROJCS", "PROJCRS")


def in_degrees(crs: str) -> bool:
    """Whether a reference system, by name or well-known text, is in degrees; one that is projected is taken as it is."""
    text = crs.strip().upper()
    if text.startswith(PROJECTED_TEXT):
        return False
    if text in GEOGRAPHIC or text.startswith(GEOGRAPHIC_TEXT):
        return True
    if text.startswith("EPSG:"):
        return False
    raise ValueError(f"unknown reference system {crs!r}")
