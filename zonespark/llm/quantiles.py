"""Percentiles of very large numeric columns by mergeable sketches.

The sketch is a randomized compactor hierarchy (KLL): values enter a level-0 buffer; a full level is
sorted and, from a random start, every other value moves up a level, where it stands for twice
as many. Two sketches merge level by level. A rank read from a sketch of parameter ``k`` is
off by at most ``rank_error(k)`` with 99 percent probability, however many values or merges it
has seen; a group of at most ``k`` values is answered exactly.

The hierarchy itself is Spark's built-in KLL aggregate, so that building and merging stay in the JVM
and are partial before any shuffle: a hot group reaches its reducer as one sketch per task.

Defined cases: null and NaN values are left out, infinities are ordered at the ends; a group without
values has no row; null group keys are a group of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_number

K = 400
RANKS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """Rank error, as a share of the number of values, not exceeded with 99 percent probability."""
    return 2.296 / k**0.9723


def sketches(df: DataFrame, keys: Sequence[Column | str], value: str, k: int = K) -> DataFrame:
    """One row per group: its keys, ``n_values`` and ``sketch`` (binary, to be stored and merged later)."""
    return df.where(is_number(F.col(value))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, keys: Sequence[Column | str], k: int = K) -> DataFrame:
    """Sketches of parts (partitions, days) merged per ``keys``."""
    return parts.groupBy(*keys).agg(F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def over_days(parts: DataFrame, unions: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of days (``day``) merged per ``keys`` over each union of days; ``unions`` has ``days``, the name of a
    union, and ``day``, one row for each of its days. It is broadcast. A null day is in no union."""
    return merged(parts.join(F.broadcast(unions.select("days", "day").distinct()), "day"), [*keys, "days"], k)


def name_of(rank: float) -> str:
    """Column name of a percentile: p05, p50, p99, p99_9."""
    text = f"{rank * 100:.6f}".rstrip("0").rstrip(".")
    whole, _, rest = text.partition(".")
    return f"p{whole.zfill(2)}" + (f"_{rest}" if rest else "")


def percentiles(parts: DataFrame, ranks: Sequence[float] = RANKS) -> DataFrame:
    """The sketches' percentiles in place of the sketch, one column each."""
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(r)) for r in ranks]))
    found = parts.withColumn("_values", values)
    return found.select(*[F.col(f"`{c}`") for c in parts.columns if c != "sketch"], *[(F.col("_values")[i] + F.lit(0.0)).alias(name_of(r)) for i, r in enumerate(ranks)])
