"""Connected components and the minimum spanning forest of an edge table.

Both thin the edges first: each task keeps spanning forests of blocks of its own edges, which loses neither
components nor the minimum forest (an edge that closes a cycle as its dearest is in none). What
is left is merged in one task once it is at most ``LOCAL_EDGES``; until then rounds run on all
tasks: components by large-star and small-star, the forest by Boruvka contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize

LOCAL_EDGES = 2_000_000


#: Edges that a task holds at once while it thins its own.
BLOCK_EDGES = 500_000


def joins(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """Which of the edges ``a, b`` between ``n`` numbers join what was apart, one after the other, and the least number
    that each number is joined with."""
    up = list(range(n))
    took = np.zeros(len(a), bool)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            took[i] = True
            if x < y:
                up[y] = x
            else:
                up[x] = y
    return took, [root(x) for x in range(n)]


def _forest(frame: pd.DataFrame, ends: tuple[str, str] = ("u", "v")) -> pd.DataFrame:
    """The edges of a frame that join something, cheapest first where they have a cost."""
    if "w" in frame:
        frame = frame.sort_values(["w", "u", "v"], kind="stable", ignore_index=True)
    codes, names = pd.factorize(np.concatenate([frame[e].to_numpy() for e in ends]))
    return frame[joins(*np.split(codes, 2), len(names))[0]]


def _spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of each block of a task's edges. What is left of a block stays for the next one while it is
    small beside it, so that a task holds a bounded number of edges whatever the size of its partition."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held += [b] if len(b) else []
        if sum(map(len, held)) >= BLOCK_EDGES:
            thin = _forest(pd.concat(held, ignore_index=True))
            held = [thin] if len(thin) <= BLOCK_EDGES // 2 else []
            if not held:
                yield thin
    if held:
        yield _forest(pd.concat(held, ignore_index=True))


def _thin(edges: DataFrame) -> DataFrame:
    return edges.mapInPandas(_spanning, edges.schema)


def components(edges: DataFrame, nodes: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, component`` with the least node of each component; ``edges`` are ``u, v``, ``nodes`` are ``node``.

    Edges of unknown or null ends are left out, nodes without edges are components of their own."""
    nodes = nodes.select("node").where("node is not null").distinct()
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    for end in ("u", "v"):
        edges = edges.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    links = materialize(_thin(edges.select("u", "v")), "links")
    if links.count() > local_edges:
        while True:
            after = materialize(_small_star(_large_star(links)), "stars")
            changed = after.count() != links.count() or not after.exceptAll(links).isEmpty()
            links = after
            if not changed:
                break
        labels = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        labels = labels.groupBy("node").agg(F.min("component").alias("component"))
    else:
        labels = links.coalesce(1).mapInPandas(_labels, f"node {links.schema['u'].dataType.simpleString()}, component {links.schema['u'].dataType.simpleString()}")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    ends = pd.concat(frames, ignore_index=True)
    # sorted, so that the least number is the least node
    nodes, codes = np.unique(np.concatenate([ends["u"].to_numpy(), ends["v"].to_numpy()]), return_inverse=True)
    yield pd.DataFrame({"node": nodes, "component": nodes[joins(*np.split(codes, 2), len(nodes))[1]]})


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to its least one (itself included)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's lesser neighbours and itself are linked to its least one."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def spanning_forest(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The minimum spanning forest ``u, v, w`` of edges ``u, v, w``; equal costs are ordered by the lesser, then the
    greater end. Loops and null ends are left out; of parallel edges only the cheapest can be in it."""
    lesser = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").where("u is not null and v is not null and u <> v")
    thin = materialize(_thin(lesser.groupBy("u", "v").agg(F.min("w").alias("w"))), "thin")
    taken: list[DataFrame] = []
    # (a, b) are the components of the ends of the edge (u, v)
    rest = thin.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w")
    while rest.count() > local_edges:
        ends = rest.select(F.col("a").alias("c"), "a", "b", "u", "v", "w").unionByName(rest.select(F.col("b").alias("c"), "a", "b", "u", "v", "w"))
        best = ends.withColumn("_n", F.row_number().over(Window.partitionBy("c").orderBy("w", "u", "v"))).where("_n = 1")
        chosen = materialize(best.select("a", "b", "u", "v", "w").distinct(), "chosen")
        taken.append(chosen.select("u", "v", "w"))
        merged = components(chosen.select(F.col("a").alias("u"), F.col("b").alias("v")), ends.select(F.col("c").alias("node")), local_edges)
        merged = materialize(merged, "merged")
        for end in ("a", "b"):
            rest = rest.join(merged.select(F.col("node").alias(end), F.col("component").alias(f"{end}_")), end)
        rest = rest.select(F.col("a_").alias("a"), F.col("b_").alias("b"), "u", "v", "w").where("a <> b")
        pair = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("w", "u", "v")
        rest = materialize(rest.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n"), "contracted")
    last = rest.coalesce(1).mapInPandas(_kruskal, thin.schema)
    for part in taken:
        last = last.unionByName(part)
    return last


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if frames:
        yield _forest(pd.concat(frames, ignore_index=True), ("a", "b"))[["u", "v", "w"]]
