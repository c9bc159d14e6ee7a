"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load.

1. *Estimate.* Keys are hashed into bundles, several a task, and one pass over the key column alone
   counts the rows of each. A key above a fraction of a task's fair share, a *heavy* one, can only be
   in a bundle above it: of these few bundles a second pass counts the rows per key. What is shuffled is
   bundles a task and the keys of the full bundles, never all keys, and what reaches the driver is bounded
   by the number of tasks, not by the data: loads of bundles and at most ``per_share * tasks`` heavy keys.
2. *Bin-pack.* A heavy key above the fair share is cut into shards proportionate to its load.
   Shards, heavy keys and bundles are packed onto tasks, largest first onto the least loaded.
3. *Fragment.* Each row goes to the task of its bundle or, for a heavy key, to one of the key's
   shards by the hash of the whole row, so that no other column's skew can unbalance a shard.
4. *Replicate.* A matching table's rows go to the tasks that hold shards of their key, and to no other.

Rows are shuffled once; what follows runs inside the tasks and leaves one row per key and
shard (for distinct counts of split keys: per key and value) to merge.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bundles to a task, so that light keys can be spread evenly over any number of tasks; and the fewest there are.
PER_TASK, FEWEST = 16, 1024
#: A key is heavy from 1 / PER_SHARE of a task's fair share of the rows.
PER_SHARE = 4


@dataclass(frozen=True)
class Plan:
    """Where rows go: ``bundle_task[b]`` for bundle b, ``heavy[key]`` the tasks of a heavy key's shards."""

    tasks: int
    rows: int
    bundle_task: list[int]
    heavy: dict[str, list[int]]
    loads: list[int]

    def bundle(self, key: Column) -> Column:
        """Task of the bundle of a key."""
        return F.element_at(_constant(self.bundle_task), F.pmod(F.hash(key), F.lit(len(self.bundle_task))) + 1)

    def shards(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with the tasks of the shards of its heavy keys, null for all other keys. The table of heavy keys
        is broadcast: it has at most PER_SHARE rows a task, and as many shards besides as there are tasks."""
        kind = df.schema[key].dataType
        heavy = df.sparkSession.createDataFrame([(k, t) for k, t in self.heavy.items()], T.StructType([T.StructField(key, kind), T.StructField(name, T.ArrayType(T.IntegerType()))]))
        return df.join(F.broadcast(heavy), key, "left").select(*[F.col(f"`{c}`") for c in df.columns], name)


def _constant(numbers: list[int]) -> Column:
    """An array as one constant, however long: the optimizer reads the text once."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def pack(loads: dict[str, int], bundles: list[int], tasks: int, rows: int) -> Plan:
    """Cut heavy keys into shards of at most a fair share and pack everything, largest first."""
    fair = max(1, -(-rows // tasks))
    items: list[tuple[float, int, object]] = []
    for key, n in loads.items():
        shards = max(1, -(-n // fair))
        items += [(n / shards, i, key) for i in range(shards)]
    items += [(n, 0, b) for b, n in enumerate(bundles)]
    heap = [(0.0, t) for t in range(tasks)]
    bundle_task, heavy, total = [0] * len(bundles), {k: [] for k in loads}, [0.0] * tasks
    for n, _, what in sorted(items, key=lambda x: (-x[0], str(x[2]), x[1])):
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        total[t] += n
        if isinstance(what, int):
            bundle_task[what] = t
        else:
            heavy[what].append(t)
    return Plan(tasks, rows, bundle_task, heavy, [round(x) for x in total])


def plan(df: DataFrame, key: str, tasks: int | None = None, bundles: int | None = None, per_share: int = PER_SHARE) -> Plan:
    """Measure the loads of ``df`` per ``key`` (null keys left out) and pack them onto ``tasks`` tasks."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = bundles or max(FEWEST, PER_TASK * tasks)
    keys = df.select(F.col(key).alias("key")).where("key is not null").withColumn("bundle", F.pmod(F.hash("key"), F.lit(bundles)))
    # as many rows as there are bundles
    light = [0] * bundles
    for r in keys.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect():
        light[r["bundle"]] = r["n"]
    rows = sum(light)
    heavy_from = max(1, rows // (tasks * per_share))
    full = [n >= heavy_from for n in light]
    found = {}
    if any(full):
        suspects = keys.where(F.element_at(_constant([int(f) for f in full]), F.col("bundle") + 1) == 1)
        # at most per_share a task
        for r in suspects.groupBy("key", "bundle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= heavy_from).collect():
            found[r["key"]] = r["n"]
            light[r["bundle"]] -= r["n"]
    return pack(found, light, tasks, rows)


def fragment(df: DataFrame, key: str, where: Plan, task: str = "_task", shards: str = "_shards") -> DataFrame:
    """``df`` without null keys, each row in its task; columns ``task`` and ``shards`` say which, of which."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    placed = where.shards(df.where(F.col(key).isNotNull()), key, shards)
    own = F.element_at(shards, (F.pmod(row, F.size(shards)) + 1).cast("int"))
    return placed.withColumn(task, F.when(F.col(shards).isNull(), where.bundle(F.col(key))).otherwise(own)).repartitionById(where.tasks, F.col(task))


def replicate(df: DataFrame, key: str, where: Plan, task: str = "_task", shards: str = "_shards") -> DataFrame:
    """``df`` without null keys, each row in every task that holds a shard of its key."""
    placed = where.shards(df.where(F.col(key).isNotNull()), key, shards)
    return placed.withColumn(task, F.explode(F.array_distinct(F.coalesce(shards, F.array(where.bundle(F.col(key))))))).drop(shards).repartitionById(where.tasks, F.col(task))


def balanced_join(df: DataFrame, other: DataFrame, key: str, how: str = "inner", where: Plan | None = None) -> DataFrame:
    """Equi-join of a skewed table with a matching table, whose rows are replicated to the shards only.

    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing (they are left out of all four).
    A column of ``other`` whose name ``df`` has too comes out as ``<name>_right``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    where = where or plan(df, key)
    task, shards = "_task", "_shards"
    while {task, shards} & {*df.columns, *other.columns}:
        task, shards = f"{task}_", f"{shards}_"
    for c in other.columns:
        if c != key and c in df.columns:
            new = f"{c}_right"
            while new in df.columns or new in other.columns:
                new += "_"
            other = other.withColumnRenamed(c, new)
    return fragment(df, key, where, task, shards).join(replicate(other, key, where, task, shards), [task, key], how).drop(task, shards)


def key_totals(df: DataFrame, key: str, value: str, distinct: str, where: Plan | None = None) -> DataFrame:
    """Per ``key``: ``n_rows``, ``total`` of ``value`` and ``n_distinct`` values of ``distinct``.

    Null keys are left out. Null and NaN values add nothing to the total (null if a key has no number),
    nulls are no distinct values, repeated rows count each time. An empty table gives no rows. Columns beyond the three named are not read.
    """
    df = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"), F.col(distinct).alias("_d"))
    out, key = key, "_key"
    where = where or plan(df, key)
    number = F.when(~F.isnan("_v"), F.col("_v"))
    local = (
        fragment(df, key, where)
        .groupBy("_task", "_key", "_d", (F.size("_shards") > 1).alias("_split"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("s"))
    )
    # values of split keys stay apart until all shards of the key have met
    apart = F.when(F.col("_split"), F.col("_d"))
    shard = local.groupBy("_task", "_key", apart.alias("_apart")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("_d").alias("d"))
    met = shard.groupBy("_key", "_apart").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.when(F.col("_apart").isNull(), F.sum("d")).otherwise(F.lit(1)).alias("d"))
    return met.groupBy(F.col("_key").alias(out)).agg(F.sum("n").alias("n_rows"), F.sum("s").alias("total"), F.sum("d").alias("n_distinct"))


def dominant(totals: DataFrame, rows: int, share: float) -> DataFrame:
    """The keys of ``totals`` that hold at least ``share`` of ``rows``."""
    return totals.where(F.col("n_rows") >= F.lit(share) * F.lit(rows))
