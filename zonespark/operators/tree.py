"""Rooted trees as tables: Euler tours, heavy paths, common ancestors and sums over subtrees.

A forest is rooted once, each tree at its least node. ``tin`` and ``tout`` are the steps of the tour of a tree
at which a node is entered and left, so the subtree of v is what is entered from ``tin`` to ``tout``. Any
connected part of a tree is again a tree by the same tour; sums over all its subtrees are differences
of running sums along the tour.

A forest of at most ``ONE_TASK_NODES`` nodes (counted first) is rooted in one task; beyond that by joins alone: the
tour is a linked list of the edges in both directions, ranked by pointer jumping in as many rounds as
the log of its length. No task ever holds a tree, a node's neighbours or a path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .flow_graph import small
from .forest import components
from .ordering import number_rows

ONE_TASK_NODES = 2_000_000
#: Rows that one task sums up in a running sum.
CHUNK = 200_000
TREE = "node long, tree long, parent long, tin long, tout long, head long"


def running(df: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``values`` replaced by their running sums in the order of ``at`` (whole numbers, dense) within ``keys``.

    Sums run within chunks of the order; the sums of chunks, few as they are, run on their own and are added."""
    cut = df.withColumn("_chunk", F.floor(F.col(at) / chunk).cast("long"))
    whole = cut.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select(*keys, "_chunk", *[F.coalesce(F.sum(v).over(before), F.lit(0.0)).alias(f"_before_{v}") for v in values])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({v: F.sum(v).over(inside) for v in values}).join(ahead, [*keys, "_chunk"])
    return summed.withColumns({v: F.col(v) + F.col(f"_before_{v}") for v in values}).drop("_chunk", *[f"_before_{v}" for v in values])


def rooted(edges: DataFrame, nodes: DataFrame, one_task: int = ONE_TASK_NODES) -> DataFrame:
    """``node, tree, parent, tin, tout, head`` of a forest ``u, v`` of ``node`` (whole numbers): ``tree`` is the least node and
    root, whose ``parent`` is null; ``head`` the topmost node of the heavy path a node is on."""
    edges, nodes = edges.select(F.col("u").cast("long"), F.col("v").cast("long")), nodes.select(F.col("node").cast("long"))
    if nodes.count() <= one_task:
        rows = nodes.select(F.col("node").alias("u"), F.lit(-1).cast("long").alias("v")).unionByName(edges)
        return materialize(rows.coalesce(1).mapInPandas(_root_all, TREE), "trees")
    return _root_by_joins(edges, nodes)


def _root_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"u": [], "v": []}, dtype=np.int64)], ignore_index=True)
    u, v = frame["u"].to_numpy(), frame["v"].to_numpy()
    names = np.sort(u[v < 0])
    n = len(names)
    if not n:
        return
    a, b = np.searchsorted(names, u[v >= 0]), np.searchsorted(names, v[v >= 0])
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.lexsort((others, ends))
    others, first = others[by].tolist(), np.searchsorted(ends[by], np.arange(n + 1)).tolist()
    parent, tree, order = [-1] * n, [-1] * n, []
    for root in range(n):
        if tree[root] >= 0:
            continue
        tree[root] = root
        at = len(order)
        order.append(root)
        while at < len(order):
            x = order[at]
            at += 1
            for y in others[first[x] : first[x + 1]]:
                if tree[y] < 0:
                    tree[y], parent[y] = root, x
                    order.append(y)
    size = [1] * n
    for x in reversed(order):
        if parent[x] >= 0:
            size[parent[x]] += size[x]
    tin, head, heavy, entered = [0] * n, list(range(n)), [-1] * n, [0] * n
    for x in order:
        p = parent[x]
        if p >= 0:
            # of equal subtrees the first has the heavy path
            if heavy[p] < 0 or size[x] > size[heavy[p]]:
                heavy[p] = x
            tin[x] = tin[p] + 1 + entered[p]
            entered[p] += 2 * size[x]
    for x in order:
        if parent[x] >= 0 and heavy[parent[x]] == x:
            head[x] = head[parent[x]]
    parent_, tin_, size_ = np.array(parent), np.array(tin, np.int64), np.array(size, np.int64)
    made = pd.DataFrame({"node": names, "tree": names[tree], "parent": pd.array(names[parent_], "Int64"), "tin": tin_, "tout": tin_ + 2 * size_ - 1, "head": names[head]})
    made.loc[parent_ < 0, "parent"] = pd.NA
    yield made


def _jump(table: DataFrame, name: str, add: str | None = None) -> DataFrame:
    """Pointer jumping: ``at, to`` where ``to`` leads further until it is null, summing ``add`` on the way; gives ``at``, the
    last place reached (``end``) and the sum."""
    table = table.withColumn("end", F.coalesce("to", "at"))
    while True:
        table = materialize(table, name)
        if table.where("to is not null").isEmpty():
            return table.drop("to")
        far = table.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("end").alias("_end"), *([F.col(add).alias("_add")] if add else []))
        met = table.join(far, "to", "left")
        more = {add: F.col(add) + F.coalesce("_add", F.lit(0))} if add else {}
        table = met.withColumns({"end": F.coalesce("_end", "end"), **more}).select("at", F.col("_to").alias("to"), "end", *([add] if add else []))


def _root_by_joins(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    trees = materialize(components(edges, nodes).select("node", F.col("component").alias("tree")), "tree_of")
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    arcs = materialize(number_rows(both, ["u", "v"], "i"), "arcs")
    bounds = arcs.groupBy("u").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    back = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("i").alias("back"))
    # after u -> v comes the arc of v that follows v -> u, around; the tour ends where it would leave the root once more
    after = F.when(F.col("back") < F.col("last"), F.col("back") + 1).otherwise(F.col("first"))
    steps = arcs.join(back, ["u", "v"]).join(bounds.withColumnRenamed("u", "v"), "v").join(trees.withColumnRenamed("node", "u"), "u")
    ended = (F.col("v") == F.col("tree")) & (F.col("back") == F.col("last"))
    steps = materialize(steps.select("i", "u", "v", "tree", "back", F.when(~ended, after).alias("next")), "steps")
    ranked = _jump(steps.select(F.col("i").alias("at"), F.col("next").alias("to"), F.lit(1).cast("long").alias("left")), "ranked", "left").select(F.col("at").alias("i"), "left")
    length = trees.groupBy("tree").agg((2 * (F.count(F.lit(1)) - 1)).alias("arcs"))
    placed = materialize(steps.join(ranked, "i").join(length, "tree").select("i", "u", "v", "tree", "back", "arcs", (F.col("arcs") - F.col("left")).alias("pos")), "placed")
    returns = placed.select(F.col("i").alias("back"), F.col("pos").alias("pos_back"))
    down = placed.join(returns, "back").where("pos < pos_back")
    # the root is entered before the first step and left after the last
    inner = down.select(F.col("v").alias("node"), "tree", F.col("u").alias("parent"), (F.col("pos") + 1).alias("tin"), (F.col("pos_back") + 1).alias("tout"))
    tops = length.select(F.col("tree").alias("node"), "tree", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("tin"), (F.col("arcs") + 1).alias("tout"))
    found = materialize(inner.unionByName(tops), "toured")
    heavy = found.where("parent is not null").groupBy("parent").agg(F.max_by("node", F.struct((F.col("tout") - F.col("tin")).alias("size"), (-F.col("node")).alias("first"))).alias("heavy"))
    marked = found.join(heavy, "parent", "left").select(F.col("node").alias("at"), F.when(F.col("heavy") == F.col("node"), F.col("parent")).alias("to"))
    heads = _jump(marked, "heads").select(F.col("at").alias("node"), F.col("end").alias("head"))
    return materialize(found.join(heads, "node").select("node", "tree", "parent", "tin", "tout", "head"), "trees")


def meets(pairs: DataFrame, trees: DataFrame, local: bool | None = None) -> DataFrame:
    """``pairs`` (``o, d`` and more columns) of one tree, others left out, with ``meet``, their lowest common ancestor.

    From path to path: of two ends on different paths the one climbs above its head whose head's subtree
    doesn't hold the other. Rounds of joins, as many as paths on the way, at most the log of the tree."""
    rows = trees.count()
    kept = list(pairs.columns)
    at = {e: small(trees.select(F.col("node").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("tree", "tin", "head")]), rows) for e in ("o", "d")}
    paths = trees.select(F.col("node").alias("h"), F.col("tin").alias("low"), F.col("tout").alias("high"), F.col("parent").alias("up"))
    ups = trees.select(F.col("node").alias("up"), F.col("tin").alias("tin_up"), F.col("head").alias("head_up"))
    # of each path's head: its subtree, and where one lands above it
    above = materialize(trees.where("head = node").select(F.col("node").alias("h")).join(paths, "h").join(ups, "up", "left"), "above")
    tops = above.count()
    open_ = pairs.join(at["o"], "o").join(at["d"], "d").where("tree_o = tree_d")
    open_ = open_.select(*kept, F.col("o").alias("x"), F.col("d").alias("y"), F.col("tin_o").alias("tx"), F.col("tin_d").alias("ty"), F.col("head_o").alias("hx"), F.col("head_d").alias("hy"))
    done: list[DataFrame] = []
    while True:
        open_ = materialize(open_, "climbing")
        done.append(open_.where("hx = hy").select(*kept, F.when(F.col("tx") <= F.col("ty"), F.col("x")).otherwise(F.col("y")).alias("meet")))
        rest = open_.where("hx <> hy")
        if rest.isEmpty():
            break
        sides = [small(above.select(*[F.col(c).alias(f"{c}_{s}") for c in above.columns]), tops).withColumnRenamed(f"h_{s}", f"h{s}") for s in ("x", "y")]
        both = rest.join(sides[0], "hx").join(sides[1], "hy")
        # x stays if its path's head holds y
        stays = (F.col("low_x") <= F.col("ty")) & (F.col("ty") <= F.col("high_x"))
        move = lambda stay, s: [F.when(stay, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in ((s, f"up_{s}"), (f"t{s}", f"tin_up_{s}"), (f"h{s}", f"head_up_{s}"))]
        open_ = both.select(*kept, *move(stays, "x"), *move(~stays, "y"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def subtree_sums(nodes: DataFrame, values: Sequence[str], key: str = "cluster", chunk: int = CHUNK) -> DataFrame:
    """``nodes`` (``node, tin, tout``, a connected part of a tree for each ``key``) with ``values`` replaced by their sums over
    each node's subtree within its part."""
    enter = nodes.select(key, "node", F.col("tin").alias("at"), *values, F.lit(0).alias("leaves"))
    leave = nodes.select(key, "node", F.col("tout").alias("at"), *[F.lit(0.0).alias(v) for v in values], F.lit(1).alias("leaves"))
    summed = running(enter.unionByName(leave), [key], "at", values, chunk)
    # from before the node is entered to where it is left
    sign: Column = F.when(F.col("leaves") == 1, 1.0).otherwise(-1.0)
    between = summed.groupBy("node").agg(*[F.sum(sign * F.col(v)).alias(f"_{v}") for v in values])
    return nodes.join(between, "node").withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])
