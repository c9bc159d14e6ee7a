"""References to records that do not exist.

Every reference of a child table is dated and compared with the life of the record it names.
``missing`` no record has the key, ``late`` the reference is dated before the record begins,
``deleted`` it is dated on or after the record's end. The first that applies is the state.

Orphans are then passed down the foreign-key graph: a record that refers to a *direct* orphan
is itself orphaned by inheritance, and so are its own children, until nothing is added. Several records
may have one key; a key passes it on once all of them are orphaned, for as long as one is sound a
reference still finds a sound record. One round of the fixpoint is one pair of semi-joins per edge of the
graph over the orphans that the last round added; keys and references are written down narrow first, so
that no round reads the tables again. Self-references and cycles are allowed.

Defined cases: blank (null) references are no references and never orphans. A null date is
neither late nor deleted. Records without a begin are never late, records with any open end
never deleted. Repeated rows are reported each. An empty parent makes all references missing,
an empty child gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize

#: The parent's life table is broadcast up to this many keys (about 64 bytes each), else joined by shuffle.
BROADCAST_KEYS = 500_000
#: Keys holding at least this share of all references are joined apart from the rest; there are at most 1 / share of them.
HOT_SHARE = 1 / 1000
#: Rounds of a cascade that are kept as tables of their own before they are written into one.
MOST_ROUNDS = 16


@dataclass(frozen=True)
class Node:
    """A table of the foreign-key graph: its rows, the column that numbers them, the key by which others
    refer to it (null: nobody does), and the dates between which a record lives (none: always)."""

    rows: DataFrame
    row_id: str
    key: Column | None = None
    begins: Column | None = None
    ends: Column | None = None


@dataclass(frozen=True)
class Reference:
    """An edge of the graph: ``field``, whose normalized value is ``key``, names a record of ``parent``; ``dated`` says when."""

    child: str
    field: str
    key: Column
    parent: str
    dated: Column | None = None


def lives(parent: DataFrame, key: Column, begins: Column, ends: Column) -> DataFrame:
    """One row for each key: earliest begin, and latest end or null while any record is open."""
    return (
        parent.select(key.cast("string").alias("key"), begins.alias("begins"), ends.alias("ends"))
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("begins").alias("begins"), F.when(F.count("ends") == F.count(F.lit(1)), F.max("ends")).alias("ends"))
    )


def references(child: DataFrame, row_id: str, tbl: str, fields: list[tuple[str, Column]], dated: Column) -> DataFrame:
    """The references of ``child`` one under the other: ``tbl, row_id, field, key, dated``; blank ones left out."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), key.cast("string").alias("key")) for name, key in fields])
    return (
        child.select(F.col(row_id).cast("bigint").alias("row_id"), dated.cast("date").alias("dated"), F.explode(each).alias("r"))
        .select(F.lit(tbl).alias("tbl"), "row_id", "r.field", "r.key", "dated")
        .where("key is not null")
    )


def _state(begins: Column, ends: Column, found: Column, dated: Column) -> Column:
    return F.when(found.isNull(), "missing").when(dated < begins, "late").when(dated >= ends, "deleted")


def direct_orphans(refs: DataFrame, life: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``refs`` that are orphaned, with their ``state``.

    ``life`` is counted first. Up to ``broadcast_keys`` it is broadcast and the references are never
    shuffled. Beyond that the join is by shuffle, and the few keys that hold more than HOT_SHARE of
    all references (so at most 1 / HOT_SHARE of them) are joined by a broadcast of their lives alone.
    """
    life = materialize(life.select("key", "begins", "ends", F.lit(True).alias("found")), "lives")
    if life.count() <= broadcast_keys:
        joined = refs.join(F.broadcast(life), "key", "left")
    else:
        loads = materialize(refs.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "loads")
        total = loads.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(loads.where(F.col("n") >= max(1, total * HOT_SHARE)).select("key"))
        joined = (
            refs.join(hot, "key", "left_semi")
            .join(F.broadcast(life.join(hot, "key", "left_semi")), "key", "left")
            .unionByName(refs.join(hot, "key", "left_anti").join(life, "key", "left"))
        )
    return joined.withColumn("state", _state(F.col("begins"), F.col("ends"), F.col("found"), F.col("dated"))).where("state is not null").drop("begins", "ends", "found")


def _dated(e: Reference) -> Column:
    return F.lit(None).cast("date") if e.dated is None else e.dated


def cascade(nodes: dict[str, Node], edges: list[Reference], max_rounds: int | None = None, every_field: bool = False, any_record: bool = False) -> DataFrame:
    """Direct and inherited orphans of a foreign-key graph: ``tbl, row_id, field, key, dated, state, round``.

    Round 0 holds the direct orphans, one row per reference. In round n the references to keys that
    round n - 1 orphaned are ``inherited``; a record that an earlier round reached is not reported again,
    so that the iteration ends on cyclic graphs too; with ``every_field`` it is, in the fields that were not
    reported yet. With ``any_record`` a key is orphaned by any of its records. Edges whose parent no other edge
    leads to need no round. The rounds go on until nothing is added; more than ``max_rounds`` of them are an error.
    """
    nothing = F.lit(None).cast("date")
    # edges of the same tables and dates are looked up together
    together: dict[tuple[str, str, str], list[Reference]] = {}
    for e in edges:
        together.setdefault((e.child, e.parent, str(e.dated)), []).append(e)
    direct = []
    for (child, parent, _), own in together.items():
        node = nodes[parent]
        life = lives(node.rows, node.key, nothing if node.begins is None else node.begins, nothing if node.ends is None else node.ends)
        direct.append(direct_orphans(references(nodes[child].rows, nodes[child].row_id, child, [(e.field, e.key) for e in own], _dated(own[0])), life))
    columns = ["tbl", "row_id", "field", "key", "dated", "state"]
    found = reduce(DataFrame.unionByName, [d.select(*columns) for d in direct]).withColumn("round", F.lit(0))
    children = {e.child for e in edges}
    passed = [e for e in edges if e.parent in children]
    if not passed:
        return found
    parents = sorted({e.parent for e in passed})
    # the keys of records that can pass something on, and the references to them
    keyed = reduce(DataFrame.unionByName, [nodes[p].rows.select(F.lit(p).alias("tbl"), F.col(nodes[p].row_id).cast("bigint").alias("row_id"), nodes[p].key.cast("string").alias("key")) for p in parents])
    keyed = materialize(keyed.where("key is not null"), "keyed", ["tbl"])
    links = reduce(DataFrame.unionByName, [references(nodes[e.child].rows, nodes[e.child].row_id, e.child, [(e.field, e.key)], _dated(e)).withColumn("parent", F.lit(e.parent)) for e in passed])
    links = materialize(links, "links", ["parent"])
    fresh = materialize(found, "orphans")
    rounds, seen, told = [fresh], fresh.select("tbl", "row_id").distinct(), fresh.select("tbl", "row_id", "field").distinct()
    records = keyed.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"))
    for n in count(1):
        if max_rounds is not None and n > max_rounds:
            raise RuntimeError(f"orphans are still inherited after {max_rounds} rounds")
        hit = keyed.join(fresh.select("tbl", "row_id").distinct(), ["tbl", "row_id"], "left_semi").select("tbl", "key").distinct()
        if not any_record:
            gone = keyed.join(hit, ["tbl", "key"], "left_semi").join(seen, ["tbl", "row_id"], "left_semi").groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("gone"))
            hit = records.join(hit, ["tbl", "key"], "left_semi").join(gone, ["tbl", "key"]).where("gone = n").select("tbl", "key")
        hit = materialize(hit.withColumnRenamed("tbl", "parent"), "hit")
        hit = F.broadcast(hit) if hit.count() <= BROADCAST_KEYS else hit
        step = links.join(hit, ["parent", "key"], "left_semi")
        if every_field:
            step = step.join(told, ["tbl", "row_id", "field"], "left_anti")
        else:
            step = step.join(seen, ["tbl", "row_id"], "left_anti")
        step = materialize(step.select("tbl", "row_id", "field", "key", "dated", F.lit("inherited").alias("state"), F.lit(n).alias("round")), "inherited")
        if step.isEmpty():
            break
        rounds.append(step)
        # plans stay short, however long the chain
        if len(rounds) > MOST_ROUNDS:
            rounds = [materialize(reduce(DataFrame.unionByName, rounds), "rounds")]
        # only records that are new pass anything on
        fresh = materialize(step.join(seen, ["tbl", "row_id"], "left_anti"), "fresh") if every_field else step
        seen = materialize(seen.unionByName(fresh.select("tbl", "row_id").distinct()), "seen")
        if every_field:
            told = materialize(told.unionByName(step.select("tbl", "row_id", "field").distinct()), "told")
    return reduce(DataFrame.unionByName, rounds)


def per_period(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, month and state; a null date counts under a null month."""
    month = F.date_format("dated", "yyyy-MM")
    return orphans.groupBy("tbl", "field", month.alias("month"), "state").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("key").alias("n_keys"))
