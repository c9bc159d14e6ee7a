import math
import random
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonespark.operators import nearby, orphans, parse_errors, skew
from zonespark.plans import problem_queries, runtime
from zonespark.streaming.flows import quarantine, windowed_totals

# --- error parse


def strict(text):
    """(quoting kept, number of fields) by reading the form character by character."""
    fields, state = 1, "start"
    for c in text:
        if state == "inside":
            state = "closed" if c == '"' else "inside"
        elif c == ",":
            fields, state = fields + 1, "start"
        elif c == '"':
            if state == "bare":
                return False, None
            state = "inside"
        elif state == "closed":
            return False, None
        else:
            state = "bare"
    return state != "inside", fields


def fewest(text, width):
    """Fewest quotes and delimiters to insert or delete, by trying all."""
    seen, todo, n = {text}, [text], 0
    while not any(strict(t) == (True, width) for t in todo):
        after = set()
        for t in todo:
            after |= {t[:i] + c + t[i:] for i in range(len(t) + 1) for c in '",'} | {t[:i] + t[i + 1 :] for i in range(len(t)) if t[i] in '",'}
        todo, n = after - seen, n + 1
        seen |= after
    return n


def check_edits(texts, width, brute):
    found = parse_errors.error_parse(texts, width)
    for text, cost, k, edits in zip(texts, found.cost.tolist(), found.fields.tolist(), found.edits, strict=True):
        kept, n = strict(text)
        # as it stands, and as the edits leave it
        assert (k if kept else -1) == (n if kept else k) and (cost == 0) == (kept and n == width)
        assert strict(parse_errors.repaired(text, edits)) == (True, width)
        assert sum(int(e.split()[2][1:]) if " x" in e else 1 for e in edits) == cost
        if brute:
            assert cost == fewest(text, width), text
        if kept:
            assert len(parse_errors.split(text)) == n


def test_edits_are_fewest_of_all_short_records():
    for length in range(7):
        check_edits(["".join(p) for p in product('a",', repeat=length)], 3, True)
    r = random.Random(1)
    check_edits(["".join(r.choice('a",') for _ in range(r.choice((7, 8)))) for _ in range(250)], 2, True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a",\n', max_size=30), min_size=1, max_size=6))
def test_edits_give_the_form(texts):
    check_edits(texts, 5, False)


def test_one_delimiter_can_save_quotes_and_two_quotes_delimiters():
    found = parse_errors.error_parse(['"abc"def,1,2,3', 'a"b",1,2,3', "1,2,3,4,5,6,7,8,9,10", "1,2,3,4,5,6,7"], 5)
    assert found.edits == [["insert delimiter at 6"], ["insert delimiter at 2"], ["insert quote at 1", "insert quote at 12"], ["delete delimiter at 2", "delete delimiter at 4"]]
    assert found.fields.tolist() == [-1, -1, 10, 7]


def test_parse(spark):
    lines = [
        "QL-04-12345,KX 81 90263-b,4.5,2024-01,x", '"QL-04-12345",KX-81-90263," 7e1\t",2024-01,"a, ""b""\n"\r', "a,b", 'QL-04-12345,KX-81-90263,1,2024-01,"open', 'QL-04-12345,KX-81-90263,1,2024-01,3" x',
        "QL-04-12345,KX-81-90263,1e999,2024-01,", "QL-04-12345,KX-81-90263,NaN,2024-01,", "QL-04-1234,KX-81-90263,5.,m,", "", None, "1,2,3,4,5,6,7", '"' * 3001, "x" * 200_000 + ",,,,",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(lines)], "line_id long, raw string, origin string")
    out = {r["line_id"]: r["parsed"] for r in parse_errors.parse(df, "raw", problem_queries.flow_fields()).collect()}
    assert [out[i]["reason"] for i in range(len(lines))] == [None, None, "columns", "quoting", "quoting", "value", "value", "value", "columns", "columns", "columns", "quoting", "value"]
    assert out[1]["value"]["flow"] == 70 and out[1]["value"]["remark"] == 'a, "b"\n' and out[0]["value"]["destin"] == "KX8190263B"
    assert out[2]["edits"] == "insert delimiter x3" and out[10]["cost"] == 2 and out[10]["fields"] == 7 and out[5]["edits"] == "replace flow" and out[3]["cost"] == 1
    assert out[3]["edits"] in ("insert quote at 40", "delete quote at 35")
    assert out[9]["cost"] == 4 and out[9]["fields"] == 0 and out[3]["fields"] is None and out[11]["cost"] == 5 and out[11]["reason"] == "quoting"
    taken = parse_errors.parse(df.withColumn("parsed", F.lit(1)), "raw", problem_queries.flow_fields())
    assert taken.columns[-1] == "parsed_" and taken.count() == len(lines)
    assert parse_errors.parse(df.where("false"), "raw", problem_queries.flow_fields()).count() == 0


def test_streams(spark, tmp_path):
    source, good, bad, mark = (str(tmp_path / n) for n in ("in", "good", "bad", "mark"))
    spark.createDataFrame([(1, "QL-04-12345,KX-81-90263,1,m,"), (2, 'x"y')], "line_id long, raw string").write.parquet(source)
    stream = spark.readStream.schema("line_id long, raw string").parquet(source)
    quarantine(stream, "raw", problem_queries.flow_fields(), good, bad, mark).awaitTermination()
    assert spark.read.parquet(good).select("line_id", "flow").first() == (1, 1.0)
    assert spark.read.parquet(bad).select("line_id", "reason").first() == (2, "quoting")
    flows = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (200_000, "a", 1.0)], "t long, destin string, flow double").withColumn("at", F.timestamp_seconds("t"))
    assert sorted(r["total_flow"] for r in windowed_totals(flows, "at").collect()) == [1.0, 5.0]


# --- skew


def skewed(spark, n=3000):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(200)}", r.choice([1.0, 2.0, None, float("nan")]), r.choice([None, *"abcdefgh"])) for _ in range(n)] + [(None, 1.0, "a")] * 5
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "key string, value double, origin string, n int, _task string")


def test_key_totals_like_plain_sums(spark):
    rows, df = skewed(spark)
    where = skew.plan(df, "key", tasks=6)
    assert where.rows == 3000 and len(where.heavy["hot"]) >= 2 and max(where.loads) < 1.3 * 3000 / 6
    got = {r["key"]: r for r in skew.key_totals(df, "key", "value", "origin", where).collect()}
    want = {}
    for k, v, o in rows:
        if k is not None:
            w = want.setdefault(k, [0, None, set()])
            w[0] += 1
            if v is not None and not math.isnan(v):
                w[1] = (w[1] or 0) + v
            w[2] |= {o} - {None}
    assert {k: (r["n_rows"], r["total"], r["n_distinct"]) for k, r in got.items()} == {k: (a, b, len(c)) for k, (a, b, c) in want.items()}
    assert [r["key"] for r in skew.dominant(skew.key_totals(df, "key", "value", "origin", where), where.rows, 0.02).collect()] == ["hot"]
    empty = df.where("false")
    assert skew.key_totals(empty, "key", "value", "origin").count() == 0


def test_bundles_keep_up_with_the_tasks(spark):
    r = random.Random(6)
    for tasks in (300, 20_000):
        bundles = max(skew.FEWEST, skew.PER_TASK * tasks)
        light = [r.randrange(80, 120) for _ in range(bundles)]
        loads = {f"h{i}": 40_000 // (i + 1) for i in range(5)}
        made = skew.pack(loads, light, tasks, sum(light) + sum(loads.values()))
        assert max(made.loads) < 1.3 * made.rows / tasks and len(made.bundle_task) == bundles
    # the tasks of bundles are one constant of the plan, not one expression each
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    where = skew.Plan(50, 2, [i % 50 for i in range(2000)], {"a": [1, 2]}, [])
    assert {x["_task"] for x in skew.fragment(df, "k", where).collect()} <= set(range(50))


def test_heavy_keys_are_found_in_full_bundles(spark):
    _, df = skewed(spark)
    where = skew.plan(df, "key", tasks=6, bundles=7)
    assert "hot" in where.heavy and where.rows == 3000 and sum(where.loads) == pytest.approx(3000, abs=6)


def test_balanced_join_like_a_plain_one(spark):
    _, df = skewed(spark)
    other = spark.createDataFrame([("hot", 1, "p"), ("hot", 2, "q"), ("k1", 3, "r"), ("k1", 3, "r"), ("zzz", 4, "s"), (None, 5, "t")], "key string, n int, extra string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.balanced_join(df, other, "key", how, skew.plan(df, "key", tasks=5))
        want = df.where("key is not null").join(other.withColumnRenamed("n", "n_right"), "key", how)
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(want.columns)
        assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))
    with pytest.raises(ValueError):
        skew.balanced_join(df, other, "key", "full")


def test_rows_lie_in_their_tasks(spark):
    _, df = skewed(spark)
    where = skew.plan(df, "key", tasks=6)
    sizes = skew.fragment(df, "key", where, "task_").groupBy("task_").count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < 1.4 * 3000 / 6


# --- orphans


def test_states(spark):
    zones = spark.createDataFrame([("a", "2023-01-01", None), ("b", "2023-01-01", "2024-01-01"), ("b", "2022-06-01", "2024-03-01"), ("c", "2023-01-01", "2023-06-01"), ("c", "2023-02-01", None), (None, "2020-01-01", None), ("e", None, None)], "k string, b string, e string").selectExpr("k", "date(b) b", "date(e) e")
    life = orphans.lives(zones, F.col("k"), F.col("b"), F.col("e"))
    cases = [("a", "2022-12-31", "late"), ("a", "2023-01-01", None), ("b", "2022-06-01", None), ("b", "2024-02-29", None), ("b", "2024-03-01", "deleted"), ("c", "2025-01-01", None), ("x", "2025-01-01", "missing"), ("x", None, "missing"), ("a", None, None), ("e", "1900-01-01", None), (None, "2020-01-01", None)]
    child = spark.createDataFrame([(i, k, d) for i, (k, d, _) in enumerate(cases)], "row_id long, f string, d string").selectExpr("*", "date(d) as dated", "'clash' as key")
    for most in (1000, 0):
        refs = orphans.references(child, "row_id", "t", [("f", F.col("f"))], F.col("dated"))
        got = {r["row_id"]: r["state"] for r in orphans.direct_orphans(refs, life, most).collect()}
        assert got == {i: s for i, (_, _, s) in enumerate(cases) if s}
    counts = orphans.per_period(orphans.direct_orphans(refs, life))
    assert {(r["month"], r["state"]): r["n_refs"] for r in counts.collect()} == {("2022-12", "late"): 1, ("2024-03", "deleted"): 1, ("2025-01", "missing"): 1, (None, "missing"): 1}


def test_cascade_like_plain_search(spark):
    r = random.Random(8)
    a = [(i, f"a{i}") for i in range(20) if i % 6]
    b = [(i, f"b{i}", f"a{r.randrange(20)}") for i in range(60)]
    # c refers to b and to itself, in a cycle too
    c = [(i, f"c{i}", r.choice([None, f"b{r.randrange(65)}"]), f"c{(i * 7 + 3) % 40}") for i in range(40)]
    nodes = {
        "a": orphans.Node(spark.createDataFrame(a, "id long, k string"), "id", F.col("k")),
        "b": orphans.Node(spark.createDataFrame(b, "id long, k string, up string"), "id", F.col("k")),
        "c": orphans.Node(spark.createDataFrame(c, "id long, k string, up string, self string"), "id", F.col("k")),
    }
    edges = [orphans.Reference("b", "up", F.col("up"), "a"), orphans.Reference("c", "up", F.col("up"), "b"), orphans.Reference("c", "self", F.col("self"), "c")]
    got = {}
    for x in orphans.cascade(nodes, edges).collect():
        got.setdefault((x["tbl"], x["row_id"]), set()).add((x["field"], x["state"], x["round"]))
    keys = {k for _, k in a}
    want = {("b", i): {("up", "missing", 0)} for i, _, up in b if up not in keys}
    bk = {k: i for i, k, _ in b}
    for i, _, up, _ in c:
        if up is not None and up not in bk:
            want.setdefault(("c", i), set()).add(("up", "missing", 0))
    reached, n = set(want), 0
    while True:
        n, step = n + 1, {}
        for i, _, up, own in c:
            if ("c", i) in reached:
                continue
            if up in bk and ("b", bk[up]) in fresh if n > 1 else up in bk and ("b", bk[up]) in reached:
                step.setdefault(("c", i), set()).add(("up", "inherited", n))
            if (("c", int(own[1:])) in fresh) if n > 1 else ("c", int(own[1:])) in reached:
                step.setdefault(("c", i), set()).add(("self", "inherited", n))
        if not step:
            break
        want |= step
        fresh = set(step)
        reached |= fresh
    assert got == want


def test_cascade_goes_to_the_end_and_tells_each_field(spark):
    # t0 names nobody on record, t1 names t0, and so on; t2 has a missing reference of its own too
    rows = [(i, f"t{i}", f"t{i - 1}" if i else "gone", "lost" if i == 2 else None) for i in range(6)]
    node = orphans.Node(spark.createDataFrame(rows, "id long, k string, up string, other string"), "id", F.col("k"))
    edges = [orphans.Reference("t", "up", F.col("up"), "t"), orphans.Reference("t", "other", F.col("other"), "t")]
    found = {(x["row_id"], x["field"], x["state"], x["round"]) for x in orphans.cascade({"t": node}, edges, every_field=True).collect()}
    assert found == {(0, "up", "missing", 0), (2, "other", "missing", 0), (1, "up", "inherited", 1), (3, "up", "inherited", 1), (4, "up", "inherited", 2), (2, "up", "inherited", 2), (5, "up", "inherited", 3)}
    with pytest.raises(RuntimeError):
        orphans.cascade({"t": node}, edges, max_rounds=2)


def test_a_key_is_orphaned_with_all_its_records(spark):
    # the key "k" has a sound record and an orphaned one, "o" two orphaned ones of different rounds
    rows = [(0, "k", "gone"), (1, "k", None), (2, "o", "gone"), (3, "o", "z"), (4, "z", "gone"), (5, "a", "k"), (6, "b", "o"), (7, "c", "b")]
    node = orphans.Node(spark.createDataFrame(rows, "id long, k string, up string").withColumn("tbl", F.lit("clash")), "id", F.col("k"))
    edges = [orphans.Reference("t", "up", F.col("up"), "t")]
    found = lambda **given: {(x["row_id"], x["round"]) for x in orphans.cascade({"t": node}, edges, **given).collect()}
    assert found() == {(0, 0), (2, 0), (4, 0), (3, 1), (6, 2), (7, 3)}
    assert found(any_record=True) == {(0, 0), (2, 0), (4, 0), (3, 1), (5, 1), (6, 1), (7, 2)}


def test_a_chain_is_followed_to_its_end(spark):
    length = 40
    node = orphans.Node(spark.createDataFrame([(i, f"t{i}", f"t{i - 1}") for i in range(length)], "id long, k string, up string"), "id", F.col("k"))
    found = {x["row_id"]: x["round"] for x in orphans.cascade({"t": node}, [orphans.Reference("t", "up", F.col("up"), "t")]).collect()}
    assert found == {i: i for i in range(length)}


# --- places


def brute_pairs(points, radius):
    return {(min(a, b), max(a, b)) for i, (a, x, y) in enumerate(points) for b, u, v in points[i + 1 :] if a != b and math.hypot(x - u, y - v) <= radius}


@pytest.mark.parametrize("leaf", [40, 100_000])
def test_near_pairs_like_brute_force(spark, leaf):
    r = random.Random(3)
    points = [(i, r.random() * 900, r.random() * 900) for i in range(500)] + [(500 + i, 200.0 + r.random(), 200.0 + r.random()) for i in range(150)] + [(700 + i, 5.0, 5.0) for i in range(20)]
    df = spark.createDataFrame([*points, (900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("inf"))], "id long, x double, y double").withColumn("leaf", F.lit("clash"))
    tree = nearby.sampled_tree(nearby.located(df), 10.0, leaf_rows=leaf)
    assert leaf > 1000 or (len(tree.starts) > 10 and tree.shards.max() > 1)
    got = [tuple(x) for x in nearby.near_pairs(df, 10.0, tree).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(points, 10.0)


def test_containing_like_brute_force(spark):
    r = random.Random(5)
    points = [(i, r.random() * 100, r.random() * 100) for i in range(800)]
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    regions = [(1, [ring(0.0, 0.0, 40.0), ring(10.0, 10.0, 20.0)]), (2, [ring(12.0, 12.0, 5.0)]), (3, [ring(50.0, 50.0, 50.0)]), (4, None), (5, [])]
    areas = spark.createDataFrame(regions, "area long, geometry array<array<struct<x: double, y: double>>>")
    df = spark.createDataFrame(points, "id long, x double, y double")
    tree = nearby.sampled_tree(df, 0.0, leaf_rows=50)
    got = {tuple(x) for x in nearby.containing(df, areas, tree, "area").collect()}
    inside = lambda x, y, a, s: a <= x < a + s and a <= y < a + s
    want = {(k, i) for i, x, y in points for k, ok in ((1, inside(x, y, 0, 40) and not inside(x, y, 10, 20)), (2, inside(x, y, 12, 5)), (3, inside(x, y, 50, 50))) if ok}
    assert got == want


def test_leaves_inside_a_region_need_no_outline(spark):
    r = random.Random(9)
    points = [(i, r.random() * 1000, r.random() * 1000) for i in range(4000)]
    # a star with a hole, and a sliver
    star = [(500 + (480 if k % 2 else 300) * math.cos(k * math.pi / 8), 500 + (480 if k % 2 else 300) * math.sin(k * math.pi / 8)) for k in range(16)]
    hole = [(450.0, 450.0), (550.0, 440.0), (560.0, 560.0), (450.0, 450.0)]
    sliver = [(0.0, 0.0), (1000.0, 900.0), (1000.0, 910.0), (0.0, 0.0)]
    regions = [(1, [[*star, star[0]], hole]), (2, [sliver])]
    areas = spark.createDataFrame(regions, "id long, geometry array<array<struct<x: double, y: double>>>")
    df = spark.createDataFrame([*points, (5000, 1500.0, 500.0)], "id long, x double, y double")
    tree = nearby.sampled_tree(df.where("id < 5000"), 0.0, leaf_rows=20)
    cross, inside = tree.crossed(np.arange(len(tree.starts)), *(np.array(v) for v in zip(*[(x, y, k) for k, ring in enumerate(regions[0][1]) for x, y in ring], strict=True)))
    assert inside.sum() > 20 and not (cross & inside).any()
    want = set()
    for k, rings in regions:
        xs, ys, ring = (np.array(v) for v in zip(*[(x, y, i) for i, own in enumerate(rings) for x, y in own], strict=True))
        hit = nearby.even_odd(np.array([p[1] for p in points]), np.array([p[2] for p in points]), xs, ys, ring)
        want |= {(k, points[i][0]) for i in np.flatnonzero(hit)}
    assert {tuple(x) for x in nearby.containing(df, areas, tree).collect()} == want


def test_sample_keeps_up_with_the_leaves():
    # half a billion points: the fullest of its leaves, as the sample has them, stays below twice what it should hold
    rows = 500_000_000
    took = nearby.sample_size(rows)
    leaves = rows // nearby.LEAF_ROWS
    drawn = np.random.default_rng(4).poisson(took / leaves, leaves)
    assert nearby.sample_size(1000) == nearby.SAMPLE_ROWS and (drawn.max() * rows / took) < 2 * nearby.LEAF_ROWS


def test_places_without_any(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    areas = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])], "id long, geometry array<array<struct<x: double, y: double>>>")
    assert nearby.near_pairs(none, 5.0).count() == 0 and nearby.containing(none, areas).count() == 0
    same = spark.createDataFrame([(1, 0.5, 0.25), (2, 0.5, 0.25)], "id long, x double, y double")
    assert nearby.near_pairs(same, 0.0).count() == 1
    assert {tuple(r) for r in nearby.containing(same, areas).collect()} == {(1, 1), (1, 2)}


def test_packed_rtree():
    r = np.random.default_rng(2)
    low = r.random((700, 2))
    high = low + r.random((700, 2)) * 0.02
    tree = nearby.PackedRTree(low[:, 0], low[:, 1], high[:, 0], high[:, 1])
    got = {(int(q), int(e)) for a, b in tree.probe(low[:, 0], low[:, 1], high[:, 0], high[:, 1], most=2000) for q, e in zip(a, b, strict=True)}
    want = {(i, j) for i in range(700) for j in range(700) if (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    assert got == want


def test_scratch_is_in_the_shared_folder(spark):
    df = runtime.materialize(spark.range(3), "three")
    assert df.count() == 3 and all(runtime.shared_folder(spark).split(":")[-1] in f for f in df.inputFiles())
