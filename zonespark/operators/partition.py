"""Cutting a minimum spanning forest into clusters by modularity gain under constraints.

The forest is made once: the tree of a part that a cut leaves is the forest restricted to it. A cut at
the tree edge above node v splits its cluster C into S, the subtree of v, and T, the rest. With A the
directed flow, out and deg the flows of all members, all that a candidate needs are sums over S:

    A[T,T] = A[C,C] - out_C(S) - in_C(S) + A[S,S]

where out_C and in_C count flows with both ends in C, and A[S,S] is the subtree sum of each flow
credited to the lowest common ancestor of its ends. So every candidate of a level is scored by one
pass over the flows and one over the zones.

Two ways lead to the same clusters:

* ``solve_level`` handles all open clusters at once, in rounds of Spark jobs over tables of zones, flows and
  clusters. Sums over subtrees are running sums along the trees' tours; no task holds a cluster.
* ``solve_local`` runs the same functions on a whole problem in one task, for problems checked to
  have at most ``LOCAL_ZONES`` zones and ``LOCAL_FLOWS`` pairs with flow.

Rules of the worklist, in order of arrival: a cluster within its caps with less than twice the least
population is final. Otherwise a cluster in several pieces is split into its largest piece and the
rest, whatever the constraints; a cluster in one piece is cut at the feasible edge of greatest gain,
if that gain is above 0 or the cluster exceeds a cap. What can't be split is final, even above its
caps. A part that exceeds a cap or has at least twice the least population is looked at again.

Ties go to the lesser row order; the root of a part is the lower end of the cut for the subtree, else
its first zone in row order. Clusters are numbered in the order in which they become final.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import PartitionConfig, hospital_column
from ..plans.runtime import materialize
from .flow_graph import small
from .forest import spanning_forest
from .metrics import known_flows, node_flows, total_flow
from .ordering import number_rows
from .prepare import ORDER, as_double, in_row_order, keep_first
from .tree import ONE_TASK_NODES, meets, rooted, running, subtree_sums

LOCAL_ZONES = 200_000
LOCAL_FLOWS = 3_000_000


@dataclass(frozen=True)
class Limits:
    """What a cluster must have and may have. ``least`` and ``most`` bound the extra attributes by position."""

    min_population: float
    max_population: float
    min_hospitals: float
    min_local_index: float
    least: tuple[tuple[int, float], ...]
    most: tuple[tuple[int, float], ...]

    def over(self, popu: float, extra: np.ndarray) -> bool:
        """Whether a cap is exceeded; comparisons with NaN are false."""
        return bool(popu > self.max_population) or any(bool(extra[i] > v) for i, v in self.most)

    def done(self, popu: float, extra: np.ndarray) -> bool:
        """Whether a cluster is final without a look at its shape."""
        capped = popu <= self.max_population and not any(bool(extra[i] > v) for i, v in self.most)
        return bool(capped and popu < 2 * self.min_population)

    def again(self, popu: float, extra: np.ndarray) -> bool:
        """Whether a new part is looked at again."""
        return self.over(popu, extra) or bool(popu >= 2 * self.min_population)


@dataclass
class Rooted:
    """A tree by local positions: nodes from the root outward, parents, and heads of heavy paths."""

    order: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    head: np.ndarray

    def subtree(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree, along the first axis."""
        out = np.array(values, dtype=float)
        parent = self.parent
        for v in self.order[:0:-1].tolist():
            out[parent[v]] += out[v]
        return out

    def inside(self, v: int) -> np.ndarray:
        """Which nodes lie in the subtree of v."""
        flag = np.zeros(len(self.parent), bool)
        flag[v] = True
        for x in self.order[1:].tolist():
            flag[x] |= flag[self.parent[x]]
        return flag


def pieces(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label of each node's piece: its least node."""
    up = np.arange(n)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(n)], np.int64)


def hang(n: int, u: np.ndarray, v: np.ndarray, root: int) -> Rooted:
    """Hang a tree from its root."""
    ends, others = np.concatenate([u, v]), np.concatenate([v, u])
    by = np.lexsort((others, ends))
    ends, others = ends[by], others[by]
    first = np.searchsorted(ends, np.arange(n + 1))
    parent, depth = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = [root]
    for x in order:
        for y in others[first[x] : first[x + 1]].tolist():
            if y != parent[x]:
                parent[y], depth[y] = x, depth[x] + 1
                order.append(y)
    size = np.ones(n, np.int64)
    for x in order[:0:-1]:
        size[parent[x]] += size[x]
    heavy, most = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for x in order[1:]:
        if size[x] > most[parent[x]]:
            most[parent[x]], heavy[parent[x]] = size[x], x
    head = np.arange(n)
    for x in order[1:]:
        if heavy[parent[x]] == x:
            head[x] = head[parent[x]]
    return Rooted(np.array(order, np.int64), parent, depth, head)


def ancestors(a: np.ndarray, b: np.ndarray, parent: np.ndarray, depth: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Lowest common ancestors of pairs, all climbing heavy paths together."""
    a, b = a.copy(), b.copy()
    open_ = np.flatnonzero(head[a] != head[b])
    while len(open_):
        x, y = a[open_], b[open_]
        left = depth[head[x]] >= depth[head[y]]
        a[open_[left]] = parent[head[x[left]]]
        b[open_[~left]] = parent[head[y[~left]]]
        open_ = open_[head[a[open_]] != head[b[open_]]]
    return np.where(depth[a] <= depth[b], a, b)


@dataclass(frozen=True)
class Cut:
    node: int
    gain: float


def best_cut(tree: Rooted, popu: np.ndarray, hosp: np.ndarray, extra: np.ndarray, out: np.ndarray, deg: np.ndarray, out_c: np.ndarray, in_c: np.ndarray, credit: np.ndarray, m: float, limits: Limits) -> Cut | None:
    """The feasible cut of greatest gain; of equal ones that at the first node."""
    stacked = np.column_stack([popu, hosp, out, deg, out_c, in_c, credit, extra])
    sub, whole = tree.subtree(stacked), stacked.sum(axis=0)
    rest = whole - sub
    inner_s = sub[:, 6]
    inner_t = whole[6] - sub[:, 4] - sub[:, 5] + inner_s
    # what the differences leave by rounding is no flow
    inner_t[np.abs(inner_t) <= 1e-12 * np.abs(stacked[:, 4:7]).sum()] = 0.0

    def index(inner: np.ndarray, flow: np.ndarray) -> np.ndarray:
        return np.divide(inner, flow, out=np.zeros_like(inner), where=flow > 0)

    def term(inner: np.ndarray | float, degree: np.ndarray | float) -> np.ndarray | float:
        return inner / m - (degree / (2 * m)) ** 2

    with np.errstate(invalid="ignore"):
        good = np.ones(len(sub), bool)
        good[tree.order[0]] = False
        for side in (sub, rest):
            good &= ~(side[:, 0] < limits.min_population) & ~(side[:, 1] < limits.min_hospitals)
            for i, least in limits.least:
                good &= ~(side[:, 7 + i] < least)
        good &= ~(index(inner_s, sub[:, 2]) < limits.min_local_index) & ~(index(inner_t, rest[:, 2]) < limits.min_local_index)
        gain = term(inner_s, sub[:, 3]) + term(inner_t, rest[:, 3]) - term(whole[6], whole[3])
    good &= ~np.isnan(gain)
    if not good.any():
        return None
    v = int(np.argmax(np.where(good, gain, -np.inf)))
    return Cut(v, float(gain[v]))


def solve_local(popu: np.ndarray, hosp: np.ndarray, extra: np.ndarray, out: np.ndarray, deg: np.ndarray, edges: tuple[np.ndarray, np.ndarray], flows: tuple[np.ndarray, np.ndarray, np.ndarray], m: float, limits: Limits) -> np.ndarray:
    """Cluster number of each zone; arrays are in row order, ``edges`` and ``flows`` hold positions."""
    n = len(popu)
    label = np.full(n, -1, np.int64)
    made = 0
    where = np.empty(n, np.int64)

    def finish(parts: list[Piece]) -> None:
        nonlocal made
        for part in parts:
            label[part.nodes] = made
        made += 1

    def piece(nodes: np.ndarray, root: int, edges: tuple, flows: tuple) -> Piece:
        return Piece(nodes, root, edges, flows, float(popu[nodes].sum()), extra[nodes].sum(axis=0))

    waiting = deque([in_pieces(n, edges, flows, piece)] if n else [])
    while waiting:
        parts = waiting.popleft()
        p, x = totals(parts)
        if limits.done(p, x) or sum(len(part.nodes) for part in parts) == 1:
            finish(parts)
            continue
        if len(parts) > 1:
            sides = [parts[:1], parts[1:]]
        else:
            nodes, (eu, ev), (fo, fd, fw) = parts[0].nodes, parts[0].edges, parts[0].flows
            k = len(nodes)
            where[nodes] = np.arange(k)
            u, v, o, d = where[eu], where[ev], where[fo], where[fd]
            tree = hang(k, u, v, int(where[parts[0].root]))
            sums = [np.bincount(at, fw, k) for at in (o, d, ancestors(o, d, tree.parent, tree.depth, tree.head))]
            cut = best_cut(tree, popu[nodes], hosp[nodes], extra[nodes], out[nodes], deg[nodes], *sums, m, limits)
            if cut is None or not (cut.gain > 0 or limits.over(p, x)):
                finish(parts)
                continue
            below = tree.inside(cut.node)
            sides = []
            for here, root in ((below, int(nodes[cut.node])), (~below, int(nodes[~below][0]))):
                keep_e, keep_f = here[u] & here[v], here[o] & here[d]
                sides.append([piece(nodes[here], root, (eu[keep_e], ev[keep_e]), (fo[keep_f], fd[keep_f], fw[keep_f]))])
        for side in sides:
            if limits.again(*totals(side)):
                waiting.append(side)
            else:
                finish(side)
    return label


@dataclass(frozen=True)
class Piece:
    """A connected part with what lies within it; a cluster is a list of pieces, the largest first."""

    nodes: np.ndarray
    root: int
    edges: tuple[np.ndarray, np.ndarray]
    flows: tuple[np.ndarray, np.ndarray, np.ndarray]
    popu: float
    extra: np.ndarray


def totals(parts: list[Piece]) -> tuple[float, np.ndarray]:
    """Population and extra attributes of a cluster."""
    if len(parts) == 1:
        return parts[0].popu, parts[0].extra
    return float(np.sum([p.popu for p in parts])), np.sum([p.extra for p in parts], axis=0)


def in_pieces(n: int, edges: tuple[np.ndarray, np.ndarray], flows: tuple[np.ndarray, np.ndarray, np.ndarray], piece: Callable[..., Piece]) -> list[Piece]:
    """All zones in their connected pieces, of equal ones the first first."""
    labels = pieces(n, *edges)
    within = labels[flows[0]] == labels[flows[1]]
    kinds = ((np.arange(n), labels), (np.arange(len(edges[0])), labels[edges[0]]), (np.flatnonzero(within), labels[flows[0][within]]))
    names = np.unique(labels)
    sliced = []
    for items, of in kinds:
        by = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[by], names, "left"), np.searchsorted(of[by], names, "right")
        sliced.append((items[by], *bounds))
    found = []
    for i in range(len(names)):
        nodes, own_e, own_f = (items[low[i] : high[i]] for items, low, high in sliced)
        found.append(piece(nodes, int(nodes[0]), tuple(c[own_e] for c in edges), tuple(c[own_f] for c in flows)))
    return sorted(found, key=lambda p: (-len(p.nodes), p.root))


# --- the problem as tables


@dataclass(frozen=True)
class Problem:
    """``nodes``: ``ord, zone_id, popu, hosp, e0.., out, deg``; ``edges``: forest ``u, v`` and ``flows``: ``o, d, f`` by ``ord``."""

    nodes: DataFrame
    edges: DataFrame
    flows: DataFrame
    m: float
    limits: Limits
    extras: tuple[str, ...]
    n_nodes: int
    n_flows: int


def costed_edges(adj: DataFrame, zones: DataFrame, embedding: DataFrame) -> DataFrame:
    """``u, v, w``: adjacency between known zones with the distance of their embeddings. A zone without an
    embedding counts as (0, 0); of repeated rows the last counts; NaN is an error."""
    last = keep_first(in_row_order(embedding), last=True)
    placed = zones.select("zone_id").join(last.select("zone_id", "emb_x", "emb_y"), "zone_id", "left").select("zone_id", F.coalesce("emb_x", F.lit(0.0)).alias("emb_x"), F.coalesce("emb_y", F.lit(0.0)).alias("emb_y"))
    placed = materialize(placed, "placed")
    if not placed.where(F.isnan("emb_x") | F.isnan("emb_y")).isEmpty():
        raise ValueError("an embedding is NaN")
    rows = placed.count()
    a, b = (small(placed.select(F.col("zone_id").alias(end), F.col("emb_x").alias(f"{end}_x"), F.col("emb_y").alias(f"{end}_y")), rows) for end in ("focal", "neighbor"))
    return adj.join(a, "focal").join(b, "neighbor").where("focal <> neighbor").select(F.col("focal").alias("u"), F.col("neighbor").alias("v"), F.hypot(F.col("focal_x") - F.col("neighbor_x"), F.col("focal_y") - F.col("neighbor_y")).alias("w"))


def pose(zones: DataFrame, flows: DataFrame, adj: DataFrame, embedding: DataFrame, cfg: PartitionConfig) -> Problem:
    """Check the columns a configuration needs and set up the tables of the solver.

    ``zones`` has ``zone_id`` and ``row_ord``; ``flows`` has ``origin, destin, flow``; ``adj`` has ``focal,
    neighbor``; ``embedding`` has ``zone_id, emb_x, emb_y``. Missing extra attributes count 0; a missing
    population or hospital count makes every sum it enters NaN, which meets no bound and breaks none."""
    if cfg.population_column not in zones.columns:
        raise KeyError(cfg.population_column)
    hospital = cfg.hospital_column or (hospital_column(zones) if cfg.min_hospitals and cfg.min_hospitals > 0 else None)
    extras = tuple(sorted({*cfg.min_per_child_attributes, *cfg.max_cluster_attributes}))
    for c in (*([hospital] if hospital else []), *extras):
        if c not in zones.columns:
            raise KeyError(c)
    nan = F.lit(float("nan"))
    popu = F.coalesce(as_double(zones, cfg.population_column), nan).alias("popu")
    hosp = (F.coalesce(as_double(zones, hospital), nan) if hospital else F.lit(0.0)).alias("hosp")
    extra = [F.coalesce(F.when(~F.isnan(as_double(zones, c)), as_double(zones, c)), F.lit(0.0)).alias(f"e{i}") for i, c in enumerate(extras)]
    numbered = number_rows(zones.select("zone_id", ORDER, popu, hosp, *extra), [ORDER], "ord")
    pairs = materialize(known_flows(flows, zones), "pairs")
    nodes = materialize(numbered.join(node_flows(pairs), "zone_id", "left").na.fill(0.0, ["out", "deg"]).drop("inn", ORDER), "nodes")
    n_nodes = nodes.count()
    ords = {end: small(nodes.select(F.col("zone_id").alias(end), F.col("ord").alias(f"{end}_")), n_nodes) for end in ("origin", "destin", "u", "v")}
    by_ord = materialize(pairs.join(ords["origin"], "origin").join(ords["destin"], "destin").select(F.col("origin_").alias("o"), F.col("destin_").alias("d"), F.col("flow").alias("f")), "flows")
    forest = spanning_forest(costed_edges(adj, zones, embedding))
    edges = materialize(forest.join(ords["u"], "u").join(ords["v"], "v").select(F.col("u_").alias("u"), F.col("v_").alias("v")), "forest")
    bounds = lambda given: tuple((extras.index(c), float(v)) for c, v in given.items())
    limits = Limits(cfg.min_population, cfg.max_population, cfg.min_hospitals or 0, cfg.min_local_index, bounds(cfg.min_per_child_attributes), bounds(cfg.max_cluster_attributes))
    return Problem(nodes, edges, by_ord, float(total_flow(pairs)), limits, extras, n_nodes, by_ord.count())


def _columns(frame: pd.DataFrame, extras: int) -> np.ndarray:
    return frame[[f"e{i}" for i in range(extras)]].to_numpy(float) if extras else np.zeros((len(frame), 0))


def solve(problem: Problem, local: bool | None = None) -> DataFrame:
    """``zone_id, cluster`` of a problem."""
    if local is None:
        local = problem.n_nodes <= LOCAL_ZONES and problem.n_flows <= LOCAL_FLOWS
    if not local:
        return solve_level(problem)
    extras, m, limits = len(problem.extras), problem.m, problem.limits

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kind = frame["kind"].to_numpy()
        nodes = frame[kind == 0].sort_values("a")
        a, b, f = (frame[c].to_numpy() for c in ("a", "b", "out"))
        edge, flow = kind == 1, kind == 2
        by = np.lexsort((b[edge], a[edge]))
        order = np.lexsort((b[flow], a[flow]))
        clusters = solve_local(
            nodes["popu"].to_numpy(float), nodes["hosp"].to_numpy(float), _columns(nodes, extras), nodes["out"].to_numpy(float), nodes["deg"].to_numpy(float),
            (a[edge][by], b[edge][by]), (a[flow][order], b[flow][order], f[flow][order]), m, limits,
        )
        return pd.DataFrame({"zone_id": nodes["zone_id"].to_numpy(), "cluster": clusters})

    none = F.lit(0.0)
    extra_names = [f"e{i}" for i in range(extras)]
    tags = ["kind", "a", "b", "zone_id", "popu", "hosp", "out", "deg", *extra_names]
    blank = {"zone_id": F.lit(None).cast("string"), **dict.fromkeys(("popu", "hosp", "out", "deg", *extra_names), none)}
    rows = problem.nodes.withColumns({"kind": F.lit(0), "a": F.col("ord"), "b": F.col("ord")}).select(*tags)
    tree = problem.edges.withColumns({"kind": F.lit(1), "a": F.col("u"), "b": F.col("v"), **blank}).select(*tags)
    moves = problem.flows.withColumns({"kind": F.lit(2), "a": F.col("o"), "b": F.col("d"), **blank}).withColumn("out", F.col("f")).select(*tags)
    return rows.unionByName(tree).unionByName(moves).groupBy(F.lit(0).alias("all")).applyInPandas(run, "zone_id string, cluster long")


# --- all open clusters at once

#: Stands after all pieces in the order of a level.
_REST = 1 << 60
#: What is summed over subtrees; missing values are summed as 0 and counted apart.
_SUMS = ("popu", "hosp", "no_popu", "no_hosp", "out", "deg", "out_c", "in_c", "credit", "one")


def _above(value: Column, bound: float) -> Column:
    """Greater, where comparisons with NaN are false."""
    return ~F.isnan(value) & (value > F.lit(float(bound)))


def _over(limits: Limits) -> Column:
    return reduce(lambda a, b: a | b, [_above(F.col(f"e{i}"), v) for i, v in limits.most], _above(F.col("popu"), limits.max_population))


def _done(limits: Limits) -> Column:
    over = reduce(lambda a, b: a | b, [_above(F.col(f"e{i}"), v) for i, v in limits.most], F.lit(False))
    return (F.col("popu") <= F.lit(float(limits.max_population))) & ~over & (F.col("popu") < F.lit(2.0 * limits.min_population))


def _again(limits: Limits) -> Column:
    return _over(limits) | (~F.isnan("popu") & (F.col("popu") >= F.lit(2.0 * limits.min_population)))


def peel(pieces_: DataFrame, limits: Limits, extras: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of a problem in several pieces, ``tree, n, popu, e..`` one row each: the largest piece is taken off
    level by level, until it is the last, or what is left is final. Gives ``tree, cluster`` of all pieces, the clusters to
    be looked at and those that are final."""
    pieces_ = materialize(number_rows(pieces_.withColumn("_n", -F.col("n")), ["_n", "tree"], "at").drop("_n"), "pieces")
    count = pieces_.count()
    # sums over a piece and all after it; a missing population counts apart
    missing = F.isnan("popu")
    left = pieces_.select(F.lit(0).alias("all"), "at", (count - 1 - F.col("at")).alias("back"), F.when(missing, 0.0).otherwise(F.col("popu")).alias("popu"), F.when(missing, 1.0).otherwise(0.0).alias("none"), *extras)
    left = running(left, ["all"], "back", ["popu", "none", *extras]).withColumn("popu", F.when(F.col("none") > 0, float("nan")).otherwise(F.col("popu")))
    left = left.select("at", "popu", *extras)
    ends = left.where(_done(limits)).agg(F.min("at")).first()[0]
    # the first piece after which nothing is looked at again
    quiet = left.where((F.col("at") > 0) & ~_again(limits)).agg(F.min("at") - 1).first()[0]
    stop = min(x for x in (ends, quiet, count - 1) if x is not None)
    whole = ends == stop
    alone = (F.col("at") < stop) | ((F.col("at") == stop) & F.lit(not whole))
    named = pieces_.withColumn("cluster", F.when(alone, F.concat(F.lit("p"), F.col("at").cast("string"), F.lit(":"))).otherwise("rest"))
    last = F.lit(not whole) & (F.col("at") == count - 1)
    looked = alone & (last | _again(limits))
    level = F.col("at").cast("int")
    waiting = named.where(looked).select("cluster", F.col("tree").alias("root"), "n", "popu", *extras, F.when(last, level).otherwise(level + 1).alias("level"), F.col("at").alias("place"), F.lit("").alias("sides"))
    rest = F.lit(_REST).alias("place"), F.lit("").alias("sides")
    final = named.where(alone & ~looked).select("cluster", level.alias("level"), *rest, F.lit(0).alias("side"))
    over = named.where("cluster = 'rest'").select("cluster", F.lit(stop).cast("int").alias("level"), *rest, F.lit(0 if whole else 1).alias("side")).distinct()
    return named.select("tree", "cluster"), waiting, final.unionByName(over)


def candidates(active: DataFrame, flows: DataFrame, frontier: DataFrame, m: float, limits: Limits, extras: list[str]) -> DataFrame:
    """All cuts of the open clusters, each a connected part of a tree: one row for each node but the topmost of its
    cluster, whose subtree is cut off, with ``good`` (feasible), ``gain``, the sums of the subtree and ``root_below``, whether the
    cluster's root is in it.

    ``active`` has the nodes, ``flows`` (``o, d, f, meet``) what flows within clusters, ``frontier`` has ``cluster, root``."""
    ends = F.explode(F.array(*[F.struct(F.col(at).alias("node"), *[F.when(F.lit(i == k), F.col("f")).otherwise(0.0).alias(n) for k, n in enumerate(("out_c", "in_c", "credit"))]) for i, at in enumerate(("o", "d", "meet"))]))
    credits = flows.select(ends.alias("e")).select("e.*").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("out_c", "in_c", "credit")])
    nodes = active.join(credits, "node", "left").na.fill(0.0, ["out_c", "in_c", "credit"]).withColumn("one", F.lit(1.0))
    for c in ("popu", "hosp"):
        nodes = nodes.withColumn(f"no_{c}", F.isnan(c).cast("double")).withColumn(c, F.nanvl(c, F.lit(0.0)))
    nodes = materialize(nodes, "nodes")
    values = [*_SUMS, *extras]
    noise = sum((F.abs(F.col(c)) for c in ("in_c", "credit")), F.abs(F.col("out_c")))
    rooted_ = nodes.join(frontier.select("cluster", "root"), "cluster")
    whole = rooted_.groupBy("cluster").agg(*[F.sum(v).alias(f"all_{v}") for v in values], F.sum(noise).alias("noise"), F.min("tin").alias("top"), F.max(F.when(F.col("node") == F.col("root"), F.col("tin"))).alias("tin_root"))
    each = subtree_sums(nodes, values).join(whole, "cluster").where("tin > top")
    nan = F.lit(float("nan"))

    def side(name: str, rest: bool) -> Column:
        value = F.col(f"all_{name}") - F.col(name) if rest else F.col(name)
        if name in ("popu", "hosp"):
            value = F.when(side(f"no_{name}", rest) > 0.5, nan).otherwise(value)
        return value

    # what the differences leave by rounding is no flow
    quiet = lambda flow: F.when(F.abs(flow) <= 1e-12 * F.col("noise"), 0.0).otherwise(flow)
    inner = quiet(F.col("credit")), quiet(F.col("all_credit") - F.col("out_c") - F.col("in_c") + F.col("credit"))
    term = lambda inside, degree: inside / F.lit(m) - F.pow(degree / F.lit(2 * m), F.lit(2.0))
    gain = term(inner[0], side("deg", False)) + term(inner[1], side("deg", True)) - term(F.col("all_credit"), F.col("all_deg"))
    good = ~F.isnan(gain)
    for rest in (False, True):
        out = quiet(side("out", rest))
        index = F.when(out > 0, inner[rest] / out).otherwise(0.0)
        good &= ~(side("popu", rest) < limits.min_population) & ~(side("hosp", rest) < limits.min_hospitals) & ~(index < limits.min_local_index)
        for i, least in limits.least:
            good &= ~(side(f"e{i}", rest) < least)
    root_below = (F.col("tin") <= F.col("tin_root")) & (F.col("tin_root") <= F.col("tout"))
    return each.select("cluster", "node", "parent", "tin", "tout", good.alias("good"), gain.alias("gain"), root_below.alias("root_below"), F.col("one").cast("long").alias("n"), side("popu", False).alias("popu"), side("hosp", False).alias("hosp"))


def set_up(problem: Problem, one_task: int = ONE_TASK_NODES) -> tuple[DataFrame, DataFrame]:
    """The nodes of a problem in their rooted trees, and its flows within trees with the common ancestors of their ends."""
    trees = rooted(problem.edges, problem.nodes.select(F.col("ord").alias("node")), one_task)
    nodes = materialize(problem.nodes.withColumnRenamed("ord", "node").drop("zone_id").join(trees.drop("head"), "node"), "placed")
    return nodes, materialize(meets(problem.flows, trees), "met")


def solve_level(problem: Problem, one_task: int = ONE_TASK_NODES) -> DataFrame:
    """The same by rounds of Spark jobs, each of which looks at all open clusters. Clusters are rows of tables too: the
    driver sees how many there are, and no task holds one.

    Trees stay rooted as they are at first. Which side of a cut is the lower one depends on the root of the
    cluster, which is a column. The order in which clusters become final in the worklist is kept as a key: the
    level in which a cluster is looked at, the piece it comes from, and the sides of the cuts that led to it."""
    spark = problem.nodes.sparkSession
    limits, m = problem.limits, problem.m
    extras = [f"e{i}" for i in range(len(problem.extras))]
    if not problem.n_nodes:
        return spark.createDataFrame([], "zone_id string, cluster long")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("popu", *extras)]]
    nodes, flows = set_up(problem, one_task)
    names, waiting, finals = peel(nodes.groupBy("tree").agg(*sums), limits, extras)
    names = materialize(names, "names")
    active = materialize(nodes.join(small(names), "tree"), "active")
    waiting, finals = materialize(waiting, "waiting"), [finals]
    labels: list[DataFrame] = []
    label = ["node", "cluster"]
    while True:
        closed = _done(limits) | (F.col("n") == 1)
        finals.append(waiting.where(closed).select("cluster", "level", "place", "sides", F.lit(0).alias("side")))
        frontier = materialize(waiting.where(~closed).withColumn("force", _over(limits)), "frontier")
        n_open = frontier.count()
        open_ = small(frontier.select("cluster"), n_open)
        labels.append(active.join(open_, "cluster", "left_anti").select(label))
        if not n_open:
            break
        active = materialize(active.join(open_, "cluster", "left_semi"), "active")
        here = {e: active.select(F.col("node").alias(e), F.col("cluster").alias(f"c_{e}")) for e in ("o", "d")}
        n_active = active.count()
        flows = materialize(flows.join(small(here["o"], n_active), "o").join(small(here["d"], n_active), "d").where("c_o = c_d").drop("c_o", "c_d"), "within")
        cuts = candidates(active, flows, frontier, m, limits, extras).where("good")
        lower = F.when(F.col("root_below"), F.col("parent")).otherwise(F.col("node"))
        best = cuts.withColumn("lower", lower).groupBy("cluster").agg(F.max_by(F.struct("gain", "tin", "tout", "root_below", "lower"), F.struct("gain", -F.col("lower"))).alias("b")).select("cluster", "b.*")
        chosen = best.join(frontier.select("cluster", "force", "level", "place", "sides"), "cluster").where("gain > 0 or force")
        chosen = materialize(chosen.withColumnsRenamed({"tin": "low", "tout": "high"}).drop("gain", "force"), "chosen")
        n_chosen = chosen.count()
        finals.append(frontier.join(small(chosen.select("cluster"), n_chosen), "cluster", "left_anti").select("cluster", "level", "place", "sides", F.lit(0).alias("side")))
        cut = small(chosen.select("cluster", "low", "high", "root_below"), n_chosen)
        labels.append(active.join(cut, "cluster", "left_anti").select(label))
        # the lower part is the one without the root
        below = (F.col("tin") >= F.col("low")) & (F.col("tin") <= F.col("high"))
        moved = active.join(cut, "cluster").withColumn("side", (below == F.col("root_below")).cast("int")).withColumnRenamed("cluster", "was").withColumn("cluster", F.concat("was", F.col("side").cast("string")))
        moved = materialize(moved.drop("low", "high", "root_below"), "moved")
        parts = moved.groupBy("was", "side", "cluster").agg(*sums, F.min("node").alias("first")).join(chosen.withColumnRenamed("cluster", "was"), "was")
        parts = materialize(parts.withColumn("again", _again(limits)), "parts")
        finals.append(parts.where("not again").select("cluster", "level", "place", "sides", "side"))
        root = F.when(F.col("side") == 0, F.col("lower")).otherwise(F.col("first"))
        waiting = materialize(parts.where("again").select("cluster", root.alias("root"), "n", "popu", *extras, (F.col("level") + 1).alias("level"), "place", F.concat("sides", F.col("side").cast("string")).alias("sides")), "waiting")
        active = moved.drop("was", "side")
        # plans stay short, however many levels there are
        labels, finals = ([materialize(reduce(DataFrame.unionByName, x), "settled")] for x in (labels, finals))
    numbers = number_rows(reduce(DataFrame.unionByName, finals), ["level", "place", "sides", "side"], "number").select("cluster", "number")
    numbers = materialize(numbers, "numbers")
    of_node = reduce(DataFrame.unionByName, labels).join(small(numbers), "cluster").select(F.col("node").alias("ord"), F.col("number").alias("cluster"))
    return problem.nodes.select("ord", "zone_id").join(of_node, "ord").select("zone_id", "cluster")
