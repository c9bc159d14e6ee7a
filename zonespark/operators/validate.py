"""Checks of references between the tables, as anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_endpoints(flows: DataFrame, zones: DataFrame) -> DataFrame:
    """The distinct non-null endpoints of ``origin, destin`` that no zone has: ``zone_id``."""
    ends = flows.select(F.explode(F.array("origin", "destin")).alias("zone_id")).where("zone_id is not null").distinct()
    return ends.join(zones.select("zone_id"), "zone_id", "left_anti")


def unknown_neighbours(adj: DataFrame, zones: DataFrame) -> DataFrame:
    """The distinct non-null ends of ``focal, neighbor`` that no zone has: ``zone_id``."""
    ends = adj.select(F.explode(F.array("focal", "neighbor")).alias("zone_id")).where("zone_id is not null").distinct()
    return ends.join(zones.select("zone_id"), "zone_id", "left_anti")


def first_of(ids: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of ``zone_id`` by text."""
    return ids.select("zone_id").orderBy("zone_id").limit(n)


def check_flows(flows: DataFrame, zones: DataFrame) -> None:
    """Raise ValueError with the number of unknown endpoints and the first ten of them."""
    unknown = unknown_endpoints(flows, zones)
    first = [r[0] for r in first_of(unknown).collect()]
    if first:
        raise ValueError(f"{unknown.count()} flow endpoints are not in the zone table, such as {first}")


def check_adjacency(adj: DataFrame, zones: DataFrame) -> None:
    """Raise ValueError for an adjacency end that no zone has."""
    first = unknown_neighbours(adj, zones).limit(1).collect()
    if first:
        raise ValueError(f"adjacency names the unknown zone {first[0][0]!r}")
