"""Filling fixed-capacity containers with items by exact-complement hashing and best fit.

Only lengths matter for how containers are filled, so the plan is made from the counts of each
length, of which there are at most ``capacity``, whatever the number of items:

1. Take the longest length left, and as many of it as fit. If the gap that remains is
   *exactly* filled by one available length, a pair or a triple (found in an index of the single, pair
   and triple sums of available lengths; all thirds are tried), that combination is a pattern; it is
   used as often as the counts of its lengths allow. Otherwise the longest length that fits the gap joins,
   and the gap is tried again.
2. A pattern that ends with a gap none of these can fill leaves its items to the residue, which is
   placed by best fit, longest first: into the open container with the least room that suffices.

Items longer than the capacity are cut: full containers of their own, and the rest is an item.

Items are then numbered within their length, by a shuffle over (length, shard of the id) with
offsets from the counts per shard; a length has as many shards as its count asks for, so that none,
however common, meets in one task. The number within its length gives an item its container by the
plan's intervals. Items longer than all capacities are numbered by the length of their rest under each
profile, so that the driver never sees more lengths than the capacities add up to.

Defined cases: items of no length take no room and are spread over the containers; null lengths
count as none; equal items are interchangeable and placed each; no items, no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import materialize

#: Items of one length that one task numbers.
SHARD_ROWS = 1_000_000
PLACES = "profile string, id bigint, piece int, start int, n_tokens int, container bigint"


@dataclass(frozen=True)
class Plan:
    """``runs[length]`` lists (items before this run, items per container, first container), in order of
    the items' numbers; ``containers`` is how many there are."""

    capacity: int
    containers: int
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def place(self, length: int, number: np.ndarray) -> np.ndarray:
        """Containers of items of one length by their number (from 0) within it."""
        before, each, first = self.runs[length]
        run = np.searchsorted(before, number, side="right") - 1
        return first[run] + (number - before[run]) // each[run]


class _Available:
    """Counts of lengths with an index of the sums of pairs and triples."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] += count
        self.n[0] = 0
        self.capacity = capacity
        self._sums: tuple[np.ndarray, np.ndarray] | None = None
        self._gone = 0

    def take(self, lengths: list[int], times: int) -> None:
        for length in lengths:
            self.n[length] -= times
            self._gone += self.n[length] <= 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Which sums two, and which three, available lengths had when the index was last made; supersets of what holds now."""
        if self._sums is None or self._gone > 64:
            have, room = np.flatnonzero(self.n).tolist(), (1 << (self.capacity + 1)) - 1
            single = sum(1 << length for length in have)
            pair = triple = 0
            for length in have:
                pair |= (single << length) & room
            for length in have:
                triple |= (pair << length) & room
            self._sums, self._gone = (self._bits(pair), self._bits(triple)), 0
        return self._sums

    def _bits(self, sums: int) -> np.ndarray:
        raw = np.frombuffer(sums.to_bytes(self.capacity // 8 + 1, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.capacity + 1].astype(bool)

    def pair(self, total: int) -> list[int] | None:
        """Two available lengths of this sum, the longer first."""
        if total < 2:
            return None
        half = np.arange((total + 1) // 2, total)
        good = (self.n[half] > 0) & (self.n[total - half] > 0)
        if total % 2 == 0 and good[0] and self.n[total // 2] < 2:
            good[0] = False
        at = int(good.argmax()) if good.any() else -1
        return None if at < 0 else [int(half[at]), int(total - half[at])]

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly; of triples that with the longest third first."""
        if self.n[gap] > 0:
            return [gap]
        pairs, triples = self.sums()
        if pairs[gap] and (two := self.pair(gap)):
            return two
        if not triples[gap]:
            return None
        third = np.flatnonzero((self.n[1:gap] > 0) & pairs[1:gap][::-1]) + 1
        for length in third[::-1].tolist():
            self.n[length] -= 1
            two = self.pair(gap - length)
            self.n[length] += 1
            if two:
                return [length, *two]
        return None


def fill(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for ``counts`` of lengths from 1 to ``capacity``."""
    have = _Available(counts, capacity)
    used = dict.fromkeys(counts, 0)
    runs: dict[int, list[tuple[int, int, int]]] = {length: [] for length in counts}
    containers = 0

    def emit(lengths: list[int], times: int) -> None:
        nonlocal containers
        for length in sorted(set(lengths)):
            each = lengths.count(length)
            runs[length].append((used[length], each, containers))
            used[length] += each * times
        containers += times

    residue: dict[int, int] = {}
    while True:
        left = np.flatnonzero(have.n)
        if not len(left):
            break
        longest = int(left[-1])
        chosen: list[int] = []
        gap, exact = capacity, None
        pool = have.n.copy()
        while gap:
            exact = None
            if chosen:
                have.n, kept = pool, have.n
                exact = have.exact(gap)
                have.n = kept
                if exact:
                    break
            fitting = np.flatnonzero(pool[1 : gap + 1])
            if not len(fitting):
                break
            length = int(fitting[-1]) + 1
            copies = int(min(pool[length], gap // length))
            if not chosen and copies > 1 and gap == copies * length:
                pass
            elif copies > 1:
                # leave room for an exact complement: the last copy is decided in the next round
                copies -= 1
            chosen += [length] * copies
            pool[length] -= copies
            gap -= copies * length
        pattern = chosen + (exact or [])
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(have.n[x]) // c for x, c in need.items())
        if exact or not gap:
            emit(pattern, times)
            have.take(list(need), 0)
            for x, c in need.items():
                have.take([x], c * times)
        else:
            residue[longest] = residue.get(longest, 0) + int(have.n[longest])
            have.take([longest], int(have.n[longest]))
    containers = best_fit(residue, capacity, runs, used, containers)
    packed = {length: tuple(np.array(v, np.int64) for v in zip(*r, strict=True)) for length, r in runs.items() if r}
    return Plan(capacity, containers, packed)


def best_fit(counts: dict[int, int], capacity: int, runs: dict, used: dict, containers: int) -> int:
    """Place the residue longest first, each run of items into the open containers with the least room
    that suffices. Containers opened together and filled alike stay one class. Returns the number of containers."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def leave(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, count))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                each = min(room // length, todo)
                fill_ = min(count, todo // each)
                runs[length].append((used[length], each, first))
                leave(room - each * length, first, fill_)
                leave(room, first + fill_, count - fill_)
                used[length] += each * fill_
                todo -= each * fill_
            else:
                each = min(capacity // length, todo)
                fill_ = todo // each
                runs[length].append((used[length], each, containers))
                leave(capacity - each * length, containers, fill_)
                containers += fill_
                used[length] += each * fill_
                todo -= each * fill_
    return containers


@dataclass(frozen=True)
class Numbered:
    """``rows``: the items with ``number`` (from 0) within their class ``(p, k)`` and ``before``, the sum of ``w`` ahead of
    them over all of ``p``; ``counts[p, k]`` and ``weights[p]`` are the sums of the classes and of each ``p``."""

    rows: DataFrame
    counts: dict[tuple[int, int], int]
    weights: dict[int, int]


def numbered(items: DataFrame, shard_rows: int = SHARD_ROWS) -> Numbered:
    """Number ``items``, ``id, p, k, n, w``, within their class, each class in shards of some ``shard_rows`` items.

    The driver receives counts per class, and per shard of the classes that have several."""
    spark = items.sparkSession
    per_class = items.groupBy("p", "k").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w")).collect()
    common = [(r["p"], r["k"], -(-r["c"] // shard_rows)) for r in per_class if r["c"] > shard_rows]
    # at most one row for every shard_rows items
    split = F.broadcast(spark.createDataFrame(common, "p int, k int, shards int"))
    shard = F.coalesce(F.pmod(F.xxhash64("id"), F.col("shards")), F.lit(0)).cast("int")
    items = items.join(split, ["p", "k"], "left").withColumn("shard", shard).drop("shards")
    groups = {(r["p"], r["k"], 0): (r["c"], r["w"]) for r in per_class}
    if common:
        in_shards = items.join(split.select("p", "k"), ["p", "k"], "left_semi").groupBy("p", "k", "shard").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w")).collect()
        groups = {g: v for g, v in groups.items() if v[0] <= shard_rows} | {(r["p"], r["k"], r["shard"]): (r["c"], r["w"]) for r in in_shards}
    counts: dict[tuple[int, int], int] = {}
    weights: dict[int, int] = {}
    start: dict[tuple[int, int, int], tuple[int, int]] = {}
    for (p, k, s), (c, w) in sorted(groups.items()):
        start[p, k, s] = counts.get((p, k), 0), weights.get(p, 0)
        counts[p, k] = counts.get((p, k), 0) + c
        weights[p] = weights.get(p, 0) + w
    schema = T.StructType([*(items.schema[c] for c in ("id", "p", "n")), T.StructField("number", T.LongType()), T.StructField("before", T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a partition holds whole shards, its rows in order: counting goes on across batches
        last, reached, weighed = None, 0, 0
        for b in batches:
            if not len(b):
                continue
            group = b[["p", "k", "shard"]].to_numpy()
            w = b["w"].to_numpy().astype(np.int64)
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(b)])
            ahead = np.cumsum(w) - w
            within = np.arange(len(b)) - np.repeat(starts, sizes)
            before = ahead - np.repeat(ahead[starts], sizes)
            first = tuple(group[0].tolist())
            if last == first:
                within[: sizes[0]] += reached
                before[: sizes[0]] += weighed
            last, reached, weighed = tuple(group[-1].tolist()), int(within[-1]) + 1, int(before[-1] + w[-1])
            base = np.array([start[tuple(group[i].tolist())] for i in starts], np.int64)
            yield pd.DataFrame({"id": b["id"], "p": b["p"], "n": b["n"], "number": within + np.repeat(base[:, 0], sizes), "before": before + np.repeat(base[:, 1], sizes)})

    ordered = items.select("id", "p", "k", "n", "w", "shard").repartition("p", "k", "shard").sortWithinPartitions("p", "k", "shard", "id")
    return Numbered(ordered.mapInPandas(number, schema), counts, weights)


def cut(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], dict[int, int], dict[int, int], int]:
    """The counts of pieces no longer than ``capacity``; where each length's rests start within the
    length of the rest; the first full container of each cut length, counted from 0; how many there are."""
    pieces: dict[int, int] = {}
    starts: dict[int, int] = {}
    full: dict[int, int] = {}
    containers = 0
    for n in sorted(counts):
        rest = n if n <= capacity else n % capacity
        if n > capacity:
            full[n] = containers
            containers += counts[n] * (n // capacity)
        if rest:
            starts[n] = pieces.get(rest, 0)
            pieces[rest] = pieces.get(rest, 0) + counts[n]
    return pieces, starts, full, containers


def pack(items: DataFrame, profiles: dict[str, int], id_column: str = "doc_id", size: str = "n_tokens", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A place for every item under every profile: ``profile, id, piece, start, n_tokens, container``.

    Items are given with unique ids. ``start`` and ``n_tokens`` say which part of the item the piece is.
    """
    for profile, capacity in profiles.items():
        if capacity is None or capacity < 1:
            raise ValueError(f"capacity of {profile} must be at least 1")
    if not profiles:
        return items.sparkSession.createDataFrame([], PLACES)
    items = materialize(items.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n")), "items")
    most = max(profiles.values())
    # class p = -1: items that fit some capacity, by length; class p of a profile: longer ones, by what is left over
    short = items.where(F.col("n") <= most).select("id", F.lit(-1).alias("p"), F.col("n").alias("k"), "n", F.lit(0).alias("w"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), (F.col("n") % c).alias("k"), F.floor(F.col("n") / c).cast("int").alias("w")) for i, c in enumerate(profiles.values())]))
    long = items.where(F.col("n") > most).select("id", "n", each.alias("e")).select("id", "e.p", "e.k", "n", "e.w")
    placed = numbered(short.unionByName(long), shard_rows)
    counts = {k: c for (p, k), c in placed.counts.items() if p < 0 and k}
    plans = []
    for i, (profile, capacity) in enumerate(profiles.items()):
        pieces, starts, full, n_full = cut(counts, capacity)
        rests = {}
        for (p, k), c in sorted(placed.counts.items()):
            if p == i and k:
                rests[k] = pieces.get(k, 0)
                pieces[k] = pieces.get(k, 0) + c
        plans.append((profile, fill(pieces, capacity), starts, full, n_full, rests, n_full + placed.weights.get(i, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = [b[c].to_numpy() for c in ("id", "n", "number", "before", "p")]
            for i, (profile, plan, starts, full, n_full, rests, n_own) in enumerate(plans):
                out = {"id": [], "piece": [], "start": [], "n_tokens": [], "container": []}

                def add(*columns: np.ndarray, out: dict = out) -> None:
                    for name, column in zip(out, columns, strict=True):
                        out[name].append(column)

                own = (columns[4] < 0) | (columns[4] == i)
                ids, n, number, before, p = (c[own] for c in columns)
                # rows of one length of the short items, of one rest of the long ones
                codes = np.where(p >= 0, -1 - n % plan.capacity, n)
                for code in np.unique(codes).tolist():
                    long_, length = code < 0, -1 - code if code < 0 else code
                    rows = np.flatnonzero(codes == code)
                    who, no = ids[rows], number[rows]
                    zeros = np.zeros(len(rows), np.int64)
                    whole = (n[rows] // plan.capacity if n[rows[0]] > plan.capacity else zeros).astype(np.int64)
                    if whole.any():
                        at = np.repeat(np.arange(len(rows)), whole)
                        piece = np.arange(len(at)) - np.repeat(np.cumsum(whole) - whole, whole)
                        first = n_full + before[rows] if long_ else full[length] + no * whole
                        add(who[at], piece, piece * plan.capacity, np.full(len(piece), plan.capacity), plan.containers + first[at] + piece)
                    rest = length if long_ else length - int(whole[0]) * plan.capacity
                    if rest:
                        add(who, whole, whole * plan.capacity, zeros + rest, plan.place(rest, (rests if long_ else starts)[length] + no))
                    elif not length and not long_:
                        add(who, zeros, zeros, zeros, no % max(1, plan.containers + n_own))
                made = pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})
                made.insert(0, "profile", profile)
                yield made

    return placed.rows.mapInPandas(run, PLACES)


def report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, share of the room filled, and the least number of containers there could be."""
    used = packed.groupBy("profile").agg(F.sum("n_tokens").alias("n_tokens"), F.max("container").alias("last"), F.count(F.lit(1)).alias("n_pieces"))
    return used.join(F.broadcast(profiles), "profile").select(
        "profile",
        "capacity_tokens",
        "n_pieces",
        "n_tokens",
        (F.col("last") + 1).alias("n_containers"),
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("n_tokens") / ((F.col("last") + 1) * F.col("capacity_tokens")), 6).alias("filled"),
    )
