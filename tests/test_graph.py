import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonespark.operators import diffuse, features, flow_graph, forest, metrics


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(f"{r.randrange(n):03d}", f"{r.randrange(n):03d}", r.random()) for _ in range(m)]


def brute_forest(edges):
    """The forest, and the least node of each node's component, by merging plain sets."""
    sets, out = {x: {x} for e in edges for x in e[:2]}, set()
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges if u != v):
        if sets[u] is not sets[v]:
            out.add((u, v, w))
            sets[u] |= sets[v]
            for x in sets[v]:
                sets[x] = sets[u]
    return out, {x: min(own) for x, own in sets.items()}


@pytest.mark.parametrize("local", [1_000_000, 5])
def test_forest_and_components(spark, local):
    edges = [*random_edges(60, 70, 2), ("000", "001", 0.5), ("000", "001", 0.5), (None, "002", 0.1)]
    df = spark.createDataFrame(edges, "u string, v string, w double")
    clean = [e for e in edges if e[0]]
    want, least = brute_forest(clean)
    assert {tuple(r) for r in forest.spanning_forest(df, local).collect()} == want
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(60)], "node string")
    want = {f"{i:03d}": least.get(f"{i:03d}", f"{i:03d}") for i in range(60)}
    assert dict(tuple(r) for r in forest.components(df.select("u", "v"), nodes, local).collect()) == want


def test_thinning_in_blocks_loses_nothing(monkeypatch):
    edges = pd.DataFrame(random_edges(80, 600, 5), columns=["u", "v", "w"])
    edges = pd.DataFrame({"u": edges[["u", "v"]].min(axis=1), "v": edges[["u", "v"]].max(axis=1), "w": edges["w"]})
    want = brute_forest(list(edges.itertuples(index=False, name=None)))[0]
    for block in (50, 200, 10_000):
        monkeypatch.setattr(forest, "BLOCK_EDGES", block)
        thin = pd.concat(list(forest._spanning(edges.iloc[i : i + 17] for i in range(0, 600, 17))))
        assert want <= set(thin.itertuples(index=False, name=None)) and len(thin) < 600


def test_empty_forest(spark):
    df = spark.createDataFrame([], "u string, v string, w double")
    assert forest.spanning_forest(df).count() == 0
    nodes = spark.createDataFrame([("a",), (None,)], "node string")
    assert [tuple(r) for r in forest.components(df.select("u", "v"), nodes).collect()] == [("a", "a")]


def test_diffusion_is_a_matrix_power(spark):
    r = np.random.default_rng(3)
    a = r.random((6, 6)) * (r.random((6, 6)) < 0.5)
    a = a + a.T + np.eye(6) * 0.3
    norm = lambda m: m / np.sqrt(np.outer(m.sum(0), m.sum(0)))
    edges = spark.createDataFrame([(str(i), str(j), float(a[i, j])) for i in range(6) for j in range(6) if a[i, j]], "src string, dst string, w double")
    operator = flow_graph.normalized(flow_graph.normalized(edges))
    x = r.random((6, 2))
    values = spark.createDataFrame([(str(i), *map(float, x[i])) for i in range(6)], "zone_id string, f0 double, f1 double")
    want = np.linalg.matrix_power(norm(norm(a)).T, 6) @ x
    got = {v["zone_id"]: (v["f0"], v["f1"]) for v in diffuse.diffuse(operator, values, ["f0", "f1"], 6).collect()}
    assert np.allclose([got[str(i)] for i in range(6)], want)


def test_fixed_head_and_glorot(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "f0 double, f1 double, f2 double, f3 double")
    x, y = diffuse.fixed_head(["f0", "f1", "f2", "f3"])
    row = one.select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(1 + 8 / math.sqrt(2)) and row["y"] == pytest.approx(2 + 8 / math.sqrt(2))
    a, b = diffuse.glorot([2, 16, 2]), diffuse.glorot([2, 16, 2])
    assert a[0][0].shape == (16, 2) and np.array_equal(a[1][0], b[1][0])


def test_features(spark):
    nan = float("nan")
    zones = spark.createDataFrame([("a", 0.0, 1.0, 3.0, 1.0), ("b", 2.0, 1.0, nan, nan), ("c", 4.0, 1.0, 5.0, 0.0)], "zone_id string, XCoord double, YCoord double, POPU double, hosp double")
    flows = spark.createDataFrame([("x", "a", 2.0), ("b", "b", 3.0), ("a", "c", 9.0), ("a", "a", -1.0)], "origin string, destin string, flow double")
    # a missing flag counts as hospital; origins need not be known
    assert dict(tuple(r) for r in features.hospital_inflow(flows, zones, "hosp").collect()) == {"a": 1.0, "b": 3.0}
    made, names = features.features(zones, flows, "coords_pop_hosp_inflow", "hosp")
    rows = {r["zone_id"]: [r[n] for n in names] for r in made.collect()}
    want = (np.array([0, 2, 4]) - 2) / np.std([0, 2, 4])
    assert np.allclose([rows[z][0] for z in "abc"], want)
    # constant and spoiled columns are 0
    assert all(rows[z][1] == 0 and rows[z][2] == 0 for z in "abc")
    inflow = np.log1p([1, 3, 0])
    assert np.allclose([rows[z][3] for z in "abc"], (inflow - inflow.mean()) / inflow.std())
    with pytest.raises(ValueError):
        features.features(zones, flows, "nope")
    with pytest.raises(KeyError):
        features.features(zones.drop("hosp"), flows, "coords_hosp_inflow", None)


def test_metrics_of_two_zones(spark):
    flows = spark.createDataFrame([("1", "1", 10.0), ("2", "2", 10.0), ("1", "2", 1.0), ("9", "1", 4.0)], "origin string, destin string, flow double")
    zones = spark.createDataFrame([("1", 3.0, None), ("2", float("nan"), None)], "zone_id string, popu double, extra double")
    pairs = metrics.known_flows(flows, zones)
    part = spark.createDataFrame([("1", 0), ("2", 1)], "zone_id string, cluster long")
    rows = {r["cluster"]: r for r in metrics.modularity_terms(pairs, part).collect()}
    assert rows[0]["li"] == pytest.approx(10 / 11) and rows[1]["li"] == 1
    assert rows[0]["term"] == pytest.approx(10 / 21 - 0.25) and metrics.total_modularity(pairs, part) == pytest.approx(20 / 21 - 0.5)
    attrs = {r["cluster"]: r for r in metrics.cluster_attributes(zones, part, ["popu", "extra"]).collect()}
    assert attrs[0]["popu_sum"] == 3 and attrs[1]["popu_sum"] == 0 and math.isnan(attrs[1]["popu_min"]) and math.isnan(attrs[0]["extra_max"])
    assert [r["cluster"] for r in metrics.over_caps(zones, part, {"popu": 2.0}).collect()] == [0]
    assert metrics.total_flow(pairs.where("false")) == 1.0
    lone = spark.createDataFrame([("7", 5)], "zone_id string, cluster long")
    assert metrics.modularity_terms(pairs.where("false"), lone).select("li", F.col("term") + 0.0).first()[0] == 0
