"""Points near other points, and the region that contains each point.

* A sample of the points, some ``LEAF_SAMPLE`` to a leaf, grows a quadtree on the driver: cells split
  while their estimated load is above ``leaf_rows``, but not below four radii in width.
* Each point goes to the leaf that holds it and, as a copy, to every leaf its radius touches; each
  region goes with its outline to every leaf its border may cross, and without to every leaf inside it.
* Within a leaf a packed R-tree is bulk-loaded (sort-tile-recursive) and probed with whole arrays
  of queries; candidates are refined by exact distance, or by an even-odd test of all rings.
* A pair is reported only by the leaf that holds its reference point, the location of its lesser
  id, so that copies at borders bring no duplicates.

A leaf that stays above ``leaf_rows`` where it can't be split is shared out as blocks: its points
are hashed into s shards, and each pair of shards is a group of its own, so that no group holds
more than about twice ``leaf_rows`` points. The sample decides only where borders run, never
which points take part.

Defined cases: points without both coordinates (null, NaN, infinite) are near nothing and inside
nothing; points at the same place are near each other; repeated ids are points of their own, but
no pair is reported for equal ids; empty inputs give empty results. A point on a region's border
belongs to the side to which the even-odd rule assigns it: of two regions with a common border, to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF_ROWS = 10_000
#: Points sampled for each leaf there will be, and for all: at least, and at most (16 bytes each on the driver).
LEAF_SAMPLE, SAMPLE_ROWS, MAX_SAMPLE = 50, 50_000, 10_000_000
MAX_DEPTH = 24
MAX_LEAVES = 200_000


@dataclass(frozen=True)
class Quadtree:
    """Leaves as ranges of the Z-order code at ``depth``; ``shards[i]`` blocks of leaf i."""

    x0: float
    y0: float
    size: float
    depth: int
    starts: np.ndarray
    levels: np.ndarray
    shards: np.ndarray

    def cells(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column and row of the finest grid; what lies outside counts to the border cells."""
        n = 1 << self.depth
        return tuple(np.clip(np.floor((v - o) * (n / self.size)), 0, n - 1).astype(np.int64) for v, o in ((x, self.x0), (y, self.y0)))

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Leaf of each location."""
        return np.searchsorted(self.starts, interleave(*self.cells(x, y)), side="right") - 1

    def crossed(self, leaf: np.ndarray, xs: np.ndarray, ys: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the leaves a polygon's border may cross, and which of the others lie inside it. A leaf at the edge
        of the tree holds all that lies beyond, so it always counts as crossed."""
        level = self.levels[leaf]
        cx, cy = deinterleave(self.starts[leaf])
        n = 1 << self.depth
        wide = np.left_shift(1, self.depth - level)
        edge = (cx == 0) | (cy == 0) | (cx + wide == n) | (cy + wide == n)
        cell = self.size / n
        slack = cell * 1e-6 + max(abs(self.x0), abs(self.y0), self.size) * 1e-12
        low_x, low_y = self.x0 + cx * cell - slack, self.y0 + cy * cell - slack
        high_x, high_y = low_x + wide * cell + 2 * slack, low_y + wide * cell + 2 * slack
        joined = ring[1:] == ring[:-1]
        ax, ay, bx, by = xs[:-1][joined], ys[:-1][joined], xs[1:][joined], ys[1:][joined]
        cross = edge.copy()
        for at in range(0, len(leaf), max(1, (1 << 20) // max(1, len(ax)))):
            part = slice(at, at + max(1, (1 << 20) // max(1, len(ax))))
            x0, y0, x1, y1 = (v[part, None] for v in (low_x, low_y, high_x, high_y))
            over = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
            # all corners on one side of the line through the edge: they don't meet
            sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
            apart = np.all([v > 0 for v in sides], axis=0) | np.all([v < 0 for v in sides], axis=0)
            cross[part] |= (over & ~apart).any(axis=1)
        inside = ~cross
        if inside.any():
            inside[inside] = even_odd((low_x + high_x)[inside] / 2, (low_y + high_y)[inside] / 2, xs, ys, ring)
        return cross, inside

    def touched(self, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) for every leaf that a box touches, each once: boxes are halved along the tree."""
        (cx0, cy0), (cx1, cy1) = self.cells(xmin, ymin), self.cells(xmax, ymax)
        box = np.arange(len(xmin))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        node = np.zeros(len(xmin), np.int64)
        for level in range(self.depth + 1):
            if not len(box):
                break
            width = self.depth - level
            first = node << (2 * width)
            leaf = np.searchsorted(self.starts, first, side="right") - 1
            done = self.levels[leaf] <= level
            found.append((box[done], leaf[done]))
            box, node = box[~done], node[~done]
            if level == self.depth:
                break
            box, node = np.repeat(box, 4), (np.repeat(node << 2, 4) + np.tile(np.arange(4), len(node)))
            gx, gy = deinterleave(node)
            w = width - 1
            keep = ((gx << w) <= cx1[box]) & (((gx + 1) << w) > cx0[box]) & ((gy << w) <= cy1[box]) & (((gy + 1) << w) > cy0[box])
            box, node = box[keep], node[keep]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def interleave(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Z-order code of grid cells."""
    out = np.zeros_like(cx)
    for bit in range(MAX_DEPTH):
        out |= ((cx >> bit) & 1) << (2 * bit)
        out |= ((cy >> bit) & 1) << (2 * bit + 1)
    return out


def deinterleave(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells of Z-order codes."""
    cx, cy = np.zeros_like(code), np.zeros_like(code)
    for bit in range(MAX_DEPTH):
        cx |= ((code >> (2 * bit)) & 1) << bit
        cy |= ((code >> (2 * bit + 1)) & 1) << bit
    return cx, cy


def grow(x: np.ndarray, y: np.ndarray, weight: float, radius: float, leaf_rows: int, max_leaves: int = MAX_LEAVES) -> Quadtree:
    """Quadtree of sampled points, each standing for ``weight`` points."""
    if not len(x):
        return Quadtree(0.0, 0.0, 1.0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    x0, y0 = float(x.min()), float(y.min())
    size = max(float(x.max()) - x0, float(y.max()) - y0, 1e-9) * (1 + 1e-9)
    depth = 0
    while depth < MAX_DEPTH and size / (1 << (depth + 1)) >= 4 * radius and size / (1 << (depth + 1)) > 0:
        depth += 1
    tree = Quadtree(x0, y0, size, depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64))
    codes = np.sort(interleave(*tree.cells(x, y)))
    leaves: list[tuple[int, int, int]] = []
    # the heaviest cell first, so that a bound on the number of leaves costs balance only where it matters least
    import heapq

    heap = [(-len(codes), 0, 0)]
    while heap:
        n, level, prefix = heapq.heappop(heap)
        if -n * weight <= leaf_rows or level == depth or len(heap) + len(leaves) + 4 > max_leaves:
            leaves.append((prefix << (2 * (depth - level)), level, -n))
            continue
        for quarter in range(4):
            child = (prefix << 2) + quarter
            low, high = child << (2 * (depth - level - 1)), (child + 1) << (2 * (depth - level - 1))
            inside = int(np.searchsorted(codes, high) - np.searchsorted(codes, low))
            heapq.heappush(heap, (-inside, level + 1, child))
    leaves.sort()
    starts, levels, load = (np.array(v, np.int64) for v in zip(*leaves, strict=True))
    return Quadtree(x0, y0, size, depth, starts, levels, np.maximum(1, np.ceil(load * weight / leaf_rows)).astype(np.int64))


def sample_size(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """How many points to sample: so many to a leaf that no leaf holds twice what it should by chance."""
    return min(MAX_SAMPLE, max(SAMPLE_ROWS, rows * LEAF_SAMPLE // leaf_rows))


def sampled_tree(points: DataFrame, radius: float, sample_rows: int | None = None, leaf_rows: int = LEAF_ROWS) -> Quadtree:
    """Grow the tree from a sample of the located points."""
    rows = points.count()
    share = min(1.0, (sample_rows or sample_size(rows, leaf_rows)) / max(1, rows))
    took = (points if share == 1 else points.sample(share, seed=17)).select("x", "y").toPandas()
    return grow(took["x"].to_numpy(), took["y"].to_numpy(), rows / max(1, len(took)), radius, leaf_rows)


class PackedRTree:
    """Sort-tile-recursive R-tree over boxes, ``FANOUT`` entries a node, probed level by level."""

    FANOUT = 16

    def __init__(self, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray):
        n, f = len(xmin), self.FANOUT
        self.order = np.zeros(0, np.int64)
        self.levels: list[np.ndarray] = []
        if not n:
            return
        strips = max(1, int(np.ceil(np.sqrt(n / f))))
        by_x = np.argsort(xmin + xmax, kind="stable")
        strip = np.empty(n, np.int64)
        strip[by_x] = np.arange(n) // max(1, int(np.ceil(n / strips)))
        self.order = np.lexsort((ymin + ymax, strip))
        boxes = np.stack([xmin, ymin, xmax, ymax], axis=1)[self.order]
        self.levels.append(boxes)
        while len(boxes) > f:
            at = np.arange(0, len(boxes), f)
            boxes = np.concatenate([np.minimum.reduceat(boxes[:, :2], at), np.maximum.reduceat(boxes[:, 2:], at)], axis=1)
            self.levels.append(boxes)

    def probe(self, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) for all boxes that overlap, in blocks of queries with bounded candidates."""
        if not len(self.order):
            return
        todo = [np.arange(len(xmin))]
        step = max(1, min(len(xmin), 4096))
        todo = [np.arange(a, min(a + step, len(xmin))) for a in range(0, len(xmin), step)][::-1]
        while todo:
            queries = todo.pop()
            query = np.repeat(queries, len(self.levels[-1]))
            node = np.tile(np.arange(len(self.levels[-1])), len(queries))
            for depth in range(len(self.levels) - 1, -1, -1):
                box = self.levels[depth][node]
                hit = (box[:, 0] <= xmax[query]) & (box[:, 2] >= xmin[query]) & (box[:, 1] <= ymax[query]) & (box[:, 3] >= ymin[query])
                query, node = query[hit], node[hit]
                if depth:
                    if len(query) * self.FANOUT > most and len(queries) > 1:
                        todo += [queries[len(queries) // 2 :], queries[: len(queries) // 2]]
                        query = None
                        break
                    query = np.repeat(query, self.FANOUT)
                    node = np.repeat(node * self.FANOUT, self.FANOUT) + np.tile(np.arange(self.FANOUT), len(node))
                    there = node < len(self.levels[depth - 1])
                    query, node = query[there], node[there]
            if query is not None and len(query):
                yield query, self.order[node]


def even_odd(px: np.ndarray, py: np.ndarray, xs: np.ndarray, ys: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether each point lies inside a polygon of closed rings by the even-odd rule over all edges."""
    joined = ring[1:] == ring[:-1]
    ax, ay, bx, by = xs[:-1][joined], ys[:-1][joined], xs[1:][joined], ys[1:][joined]
    inside = np.zeros(len(px), bool)
    for at in range(0, len(px), max(1, (1 << 20) // max(1, len(ax)))):
        part = slice(at, at + max(1, (1 << 20) // max(1, len(ax))))
        x, y = px[part, None], py[part, None]
        across = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = x < (bx - ax) * (y - ay) / (by - ay) + ax
        inside[part] = (across & left).sum(axis=1) % 2 == 1
    return inside


_POINT = "leaf long, a int, b int, kind int, shard int, id long, x double, y double"
_BOX = "leaf long, a int, b int, id long, xs array<double>, ys array<double>, ring array<int>"


def _shared(tree: Quadtree, radius: float):
    """Send each located point to its leaf and, as a copy, to all leaves that its radius touches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            x, y, ids = p["x"].to_numpy(), p["y"].to_numpy(), p["id"].to_numpy()
            own = tree.leaf(x, y)
            # a hair more than the radius, so that rounding never loses a copy
            r = radius * (1 + 1e-9) + np.maximum(np.abs(x), np.abs(y)) * 1e-12
            who, leaf = tree.touched(x - r, y - r, x + r, y + r)
            # a shard depends on the id alone, so that copies of a point agree
            shards = tree.shards[leaf]
            shard = (np.abs(ids[who].astype(np.int64) * 0x9E3779B1 >> 7) % shards).astype(np.int64)
            # block (a, b), a <= b: every pair of shards of a leaf, and each shard with itself
            at = np.repeat(np.arange(len(who)), shards)
            other = np.arange(len(at)) - np.repeat(np.cumsum(shards) - shards, shards)
            mine = shard[at]
            yield pd.DataFrame({
                "leaf": leaf[at], "a": np.minimum(mine, other).astype(np.int32), "b": np.maximum(mine, other).astype(np.int32),
                "kind": (own[who[at]] == leaf[at]).astype(np.int32), "shard": mine.astype(np.int32), "id": ids[who[at]], "x": x[who[at]], "y": y[who[at]],
            })

    return run


def near_pairs(points: DataFrame, radius: float, tree: Quadtree | None = None) -> DataFrame:
    """Pairs of ``points`` (``id, x, y``; id unique) at most ``radius`` apart: ``id_a < id_b``."""
    points = located(points)
    tree = tree or sampled_tree(points, radius)

    def probe(group: pd.DataFrame) -> pd.DataFrame:
        a, b = int(group["a"].iloc[0]), int(group["b"].iloc[0])
        x, y, ids, native, shard = (group[c].to_numpy() for c in ("x", "y", "id", "kind", "shard"))
        left = np.flatnonzero(shard == a)
        right = left if a == b else np.flatnonzero(shard == b)
        rtree = PackedRTree(x[right], y[right], x[right], y[right])
        out_a, out_b = [], []
        pad = radius * (1 + 1e-9) + np.maximum(np.abs(x[left]), np.abs(y[left])) * 1e-12
        for q, e in rtree.probe(x[left] - pad, y[left] - pad, x[left] + pad, y[left] + pad):
            q, e = left[q], right[e]
            if a == b:
                ahead = ids[q] < ids[e]
                q, e = q[ahead], e[ahead]
            dx, dy = x[q] - x[e], y[q] - y[e]
            low, high = np.where(ids[q] < ids[e], q, e), np.where(ids[q] < ids[e], e, q)
            good = (np.sqrt(dx * dx + dy * dy) <= radius) & (native[low] == 1) & (ids[low] != ids[high])
            out_a.append(ids[low[good]])
            out_b.append(ids[high[good]])
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"id_a": np.concatenate([none, *out_a]), "id_b": np.concatenate([none, *out_b])})

    return points.mapInPandas(_shared(tree, radius), _POINT).groupBy("leaf", "a", "b").applyInPandas(probe, "id_a long, id_b long")


def flat_rings(geometry: Column) -> list[Column]:
    """A geometry as flat arrays ``xs, ys, ring`` (the ring's number of each vertex)."""
    rings = F.filter(geometry, lambda r: r.isNotNull())
    return [
        F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"]))).alias("xs"),
        F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"]))).alias("ys"),
        F.flatten(F.transform(rings, lambda r, i: F.transform(r, lambda p: i.cast("int")))).alias("ring"),
    ]


def containing(points: DataFrame, regions: DataFrame, tree: Quadtree | None = None, region_id: str = "id", geometry: str = "geometry") -> DataFrame:
    """The regions that hold each point: ``region, id``. Regions without rings hold nothing."""
    points = located(points)
    tree = tree or sampled_tree(points, 0.0)
    flat = regions.where(F.size(geometry) > 0).select(F.col(region_id).cast("bigint").alias("id"), *flat_rings(F.col(geometry))).where(F.size("xs") > 0)

    def share_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            leaf = tree.leaf(p["x"].to_numpy(), p["y"].to_numpy())
            block = (np.abs(p["id"].to_numpy().astype(np.int64) * 0x9E3779B1 >> 7) % tree.shards[leaf]).astype(np.int32)
            yield pd.DataFrame({"leaf": leaf, "block": block, "id": p["id"], "x": p["x"], "y": p["y"]})

    def share_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in batches:
            if not len(r):
                continue
            box = np.array([[f(v) for f, v in ((np.min, x), (np.min, y), (np.max, x), (np.max, y))] for x, y in zip(r["xs"], r["ys"], strict=True)])
            who, leaf = tree.touched(*box.T)
            by = np.argsort(who, kind="stable")
            who, leaf = who[by], leaf[by]
            cross, inside = np.zeros(len(who), bool), np.zeros(len(who), bool)
            for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1):
                if len(part):
                    outline = (np.asarray(r[c].iloc[who[part[0]]]) for c in ("xs", "ys", "ring"))
                    cross[part], inside[part] = tree.crossed(leaf[part], *outline)
            who, leaf, cross = (v[cross | inside] for v in (who, leaf, cross))
            shards = tree.shards[leaf]
            at = np.repeat(np.arange(len(who)), shards)
            block = (np.arange(len(at)) - np.repeat(np.cumsum(shards) - shards, shards)).astype(np.int32)
            made = {"leaf": leaf[at], "block": block, "id": r["id"].to_numpy()[who[at]]}
            # outlines in pieces, as they take room
            for piece in range(0, len(at), 4096):
                rows = slice(piece, piece + 4096)
                outlines = {c: [r[c].iloc[w] if x else np.zeros(0) for w, x in zip(who[at[rows]], cross[at[rows]], strict=True)] for c in ("xs", "ys", "ring")}
                yield pd.DataFrame({**{c: v[rows] for c, v in made.items()}, **outlines})

    def refine(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        out_r, out_p = [none], [none]
        whole = r["xs"].map(len) == 0 if len(r) else None
        if len(p) and len(r):
            for k in r.loc[whole, "id"]:
                out_p.append(p["id"].to_numpy())
                out_r.append(np.full(len(p), k))
            r = r[~whole]
        if len(p) and len(r):
            box = np.array([[f(v) for f, v in ((np.min, x), (np.min, y), (np.max, x), (np.max, y))] for x, y in zip(r["xs"], r["ys"], strict=True)])
            x, y, ids, regions_ = p["x"].to_numpy(), p["y"].to_numpy(), p["id"].to_numpy(), r["id"].to_numpy()
            for q, e in PackedRTree(*box.T).probe(x, y, x, y):
                by_region = np.argsort(e, kind="stable")
                q, e = q[by_region], e[by_region]
                for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(e)) + 1):
                    k = e[part[0]]
                    rings = (np.asarray(r[c].iloc[k]) for c in ("xs", "ys", "ring"))
                    hit = ids[q[part]][even_odd(x[q[part]], y[q[part]], *rings)]
                    out_p.append(hit)
                    out_r.append(np.full(len(hit), regions_[k]))
        return pd.DataFrame({"region": np.concatenate(out_r), "id": np.concatenate(out_p)})

    left = points.mapInPandas(share_points, "leaf long, block int, id long, x double, y double").groupBy("leaf", "block")
    right = flat.mapInPandas(share_regions, "leaf long, block int, id long, xs array<double>, ys array<double>, ring array<int>").groupBy("leaf", "block")
    return left.cogroup(right).applyInPandas(refine, "region long, id long")


def located(points: DataFrame) -> DataFrame:
    """``id, x, y`` of the points with finite coordinates."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    return points.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite[0] & finite[1] & F.col("id").isNotNull())
