"""Zone, flow and adjacency tables in their normal form.

Zones      ``zone_id, row_ord, ...`` one row per normalized id, the first in row order
Flows      ``origin, destin, flow``  normalized endpoints; null and NaN flows are left out
Adjacency  ``focal, neighbor``       normalized; rows with a null end are left out

Row order is ``row_ord`` if the table has such a column, else the order in which Spark reads it, fixed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import centroid
from ..functions.keys import norm_zone_key
from ..plans.config import coordinate_names, flow_columns
from ..plans.runtime import materialize
from .ordering import number_rows

ORDER = "row_ord"
KEY = "zone_id"


def key_of(df: DataFrame, column: str) -> Column:
    """Normal form of an id column, by its type."""
    return norm_zone_key(F.col(f"`{column}`"), df.schema[column].dataType)


def in_row_order(df: DataFrame) -> DataFrame:
    """``df`` with ``row_ord``."""
    if ORDER in df.columns:
        return df
    return materialize(df.withColumn(ORDER, F.monotonically_increasing_id()), "rows")


def keep_first(df: DataFrame, key: str = KEY, order: str = ORDER, last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``; null keys left out."""
    by = F.col(order).desc() if last else F.col(order).asc()
    return df.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("_nth = 1").drop("_nth")


def with_zone_id(df: DataFrame, id_column: str | None) -> DataFrame:
    """``df`` in row order with ``zone_id``; without an id column a row's place is its id."""
    if id_column is None:
        return number_rows(in_row_order(df), [ORDER], "_place").withColumn(KEY, F.col("_place").cast("string")).drop("_place")
    if id_column not in df.columns:
        raise KeyError(id_column)
    return in_row_order(df).withColumn(KEY, key_of(df, id_column))


def partition_zones(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """Zone table of the partition stage: one row per id, the first."""
    return keep_first(with_zone_id(df, id_column))


def as_double(df: DataFrame, column: str) -> Column:
    """A column as double; what can't be read is null."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.trim(F.col(f"`{column}`")).try_cast("double")
    return F.col(f"`{column}`").cast("double")


def embedding_zones(df: DataFrame, id_column: str | None = None, coordxy: str | None = None) -> DataFrame:
    """Zone table of the embedding stage with ``XCoord, YCoord`` from the named columns (by default those
    two), or else the centroid of ``geometry``. Ids are made unique first; a zone without coordinates keeps its row."""
    zones = partition_zones(df, id_column)
    names = coordinate_names(coordxy)
    if names is None and {"XCoord", "YCoord"} <= set(df.columns):
        names = ("XCoord", "YCoord")
    if names is not None:
        missing = [n for n in names if n not in df.columns]
        if missing:
            raise KeyError(f"no column {', '.join(missing)}")
        x, y = (F.when(~F.isnan(as_double(df, n)), as_double(df, n)) for n in names)
        return zones.withColumns({"XCoord": x, "YCoord": y})
    if "geometry" not in df.columns:
        raise KeyError("neither coordinates nor a geometry column")
    if zones.where("geometry is not null").isEmpty():
        raise ValueError("all geometries are null")
    centre = centroid(F.col("geometry"))
    return zones.withColumns({"XCoord": centre["x"], "YCoord": centre["y"]})


def located_zones(zones: DataFrame, key: str = KEY) -> DataFrame:
    """Zones with both coordinates, one row per id. Coordinates are checked before ids are made unique,
    so a later record with coordinates can stand for a zone whose first record has none."""
    x, y = F.col("XCoord").cast("double"), F.col("YCoord").cast("double")
    return keep_first(in_row_order(zones).withColumns({"XCoord": x, "YCoord": y}).where(x.isNotNull() & ~F.isnan(x) & y.isNotNull() & ~F.isnan(y)), key)


def unique_zones(zones: DataFrame, id_column: str = "ZoneID") -> DataFrame:
    """One row per normalized ``ZoneID``, with or without coordinates."""
    if id_column not in zones.columns:
        raise KeyError(id_column)
    return partition_zones(zones, id_column)


def flows_of(df: DataFrame, origin: str | None = None, destin: str | None = None, flow: str | None = None) -> DataFrame:
    """``origin, destin, flow`` of a flow table. Repeated rows stay."""
    o, d, f = flow_columns(df, origin, destin, flow)
    value = as_double(df, f)
    return df.select(key_of(df, o).alias("origin"), key_of(df, d).alias("destin"), value.alias("flow")).where("flow is not null and not isnan(flow)")


def adjacency_of(df: DataFrame) -> DataFrame:
    """``focal, neighbor`` of an adjacency table, whatever the case of the two names. Repeated rows stay."""
    names = {c.lower(): c for c in reversed(df.columns)}
    if not {"focal", "neighbor"} <= set(names):
        raise ValueError("an adjacency table needs the columns focal and neighbor")
    return df.select(key_of(df, names["focal"]).alias("focal"), key_of(df, names["neighbor"]).alias("neighbor")).where("focal is not null and neighbor is not null")


def external_embedding(df: DataFrame, zone_col: str = "ZoneID", x_col: str = "Emb_X", y_col: str = "Emb_Y") -> DataFrame:
    """``ZoneID, Emb_X, Emb_Y`` of an embedding made elsewhere; null ids left out, repeated ones kept."""
    for c in (zone_col, x_col, y_col):
        if c not in df.columns:
            raise KeyError(c)
    return df.select(key_of(df, zone_col).alias("ZoneID"), F.col(x_col).alias("Emb_X"), F.col(y_col).alias("Emb_Y")).where("ZoneID is not null")
