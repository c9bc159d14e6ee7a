"""Global order without a global sort in one task: numbering, weighted and interpolated percentiles.

Rows are range-partitioned, so that partition numbers follow the order; a count or sum per partition
reaches the driver (as many values as there are shuffle partitions), and the rest of the work is a
window inside one partition each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize

#: Up to so many rows (counted first) one task sorts them, which saves jobs and changes no result.
ONE_TASK_ROWS = 1_000_000


def in_ranges(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written in range partitions of ``by``; ``_part`` numbers them in order."""
    return materialize(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")


def _offsets(parts: DataFrame, amount: Column) -> list[tuple[int, float, float]]:
    """(partition, amount before it, amount in it), in order."""
    out, before = [], 0
    for part, inside in sorted((r[0], r[1]) for r in parts.groupBy("_part").agg(amount.alias("a")).collect()):
        out.append((part, before, inside))
        before += inside
    return out


def number_rows(df: DataFrame, by: list[str], name: str, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """``df`` with ``name``, the place of each row in the order ``by`` from 0; ties in any order."""
    if df.count() <= one_task:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1).cast("bigint"))
    parts = in_ranges(df, *by)
    offsets = _offsets(parts, F.count(F.lit(1)))
    if not offsets:
        return parts.drop("_part").withColumn(name, F.lit(0).cast("bigint"))
    start = F.element_at(F.create_map(*[F.lit(x) for part, before, _ in offsets for x in (part, before)]), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return parts.withColumn(name, (start + place).cast("bigint")).drop("_part")


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float = 0.5, one_task: int = ONE_TASK_ROWS) -> float | None:
    """The least value at which the running weight reaches ``q`` of the total; None for no rows."""
    # values that repeat are one row, so it is distinct values that count
    sums = materialize(df.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w")), "sums")
    if sums.count() <= one_task:
        running = F.sum("w").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        whole = F.sum("w").over(Window.partitionBy())
        reached = sums.select("v", running.alias("c"), whole.alias("t"))
        return reached.agg(F.coalesce(F.min(F.when(F.col("c") >= F.lit(q) * F.col("t"), F.col("v"))), F.max("v"))).first()[0]
    parts = in_ranges(sums, "v")
    offsets = _offsets(parts, F.sum("w"))
    if not offsets:
        return None
    goal = q * (offsets[-1][1] + offsets[-1][2])
    part, before = next(((p, b) for p, b, inside in offsets if b + inside >= goal), offsets[-1][:2])
    running = F.sum("w").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    inside = parts.where(F.col("_part") == part).select("v", running.alias("c"))
    found = inside.where(F.col("c") >= F.lit(goal)).agg(F.min("v")).first()[0]
    return found if found is not None else inside.agg(F.max("v")).first()[0]


def percentile(df: DataFrame, value: str, percent: float, one_task: int = ONE_TASK_ROWS) -> float | None:
    """Exact percentile with linear interpolation between the two nearest values; None for no rows."""
    if df.count() <= one_task:
        return df.agg(F.percentile(value, F.lit(percent / 100))).first()[0]
    parts = in_ranges(df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), "v")
    offsets = _offsets(parts, F.count(F.lit(1)))
    if not offsets:
        return None
    last = offsets[-1][1] + offsets[-1][2] - 1
    at = percent / 100 * last
    low, high = math.floor(at), math.ceil(at)
    wanted = {low, high}
    holding = [(p, b) for p, b, n in offsets if any(b <= k < b + n for k in wanted)]
    start = F.element_at(F.create_map(*[F.lit(x) for p, b in holding for x in (p, b)]), F.col("_part"))
    place = start + F.row_number().over(Window.partitionBy("_part").orderBy("v")) - 1
    rows = parts.where(F.col("_part").isin([p for p, _ in holding])).select("v", place.alias("k")).where(F.col("k").isin(sorted(wanted))).collect()
    values = {r["k"]: r["v"] for r in rows}
    return values[low] + (values[high] - values[low]) * (at - low)
