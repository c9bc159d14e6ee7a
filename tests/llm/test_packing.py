import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("zonespark.llm")
from zonespark.llm import packing


def place_all(counts, capacity):
    plan = packing.fill(counts, capacity)
    load = np.zeros(plan.containers, np.int64)
    for length, n in counts.items():
        np.add.at(load, plan.place(length, np.arange(n)), length)
    return plan, load


@pytest.mark.parametrize("seed", range(15))
def test_plan_places_every_item_within_capacity(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 64, 500, 4096])
    counts = {}
    for _ in range(r.choice([1, 20, 400])):
        counts[r.randint(1, capacity)] = r.randint(1, r.choice([1, 3, 5000]))
    plan, load = place_all(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    assert load.sum() == total and load.max() <= capacity and load.min() > 0
    # no two containers are left at most half full
    assert plan.containers <= 2 * (total // capacity + 1)


def test_exact_complements_leave_no_room():
    for counts in ({60: 5, 40: 5}, {50: 7, 30: 7, 20: 7}, {40: 4, 30: 4, 20: 4, 10: 4}, {100: 3}, {25: 8}):
        plan, load = place_all(counts, 100)
        assert (load == 100).all() and plan.containers == sum(k * n for k, n in counts.items()) // 100


def test_index_finds_singles_pairs_and_triples():
    have = packing._Available({5: 1, 7: 2, 11: 1}, 40)
    assert have.exact(11) == [11] and sorted(have.exact(14)) == [7, 7] and sorted(have.exact(23)) == [5, 7, 11] and have.exact(10) is None and have.exact(6) is None


def test_a_triple_is_found_however_many_thirds_there_are():
    # the index is as it was when all lengths were there: 99 of its thirds have no pair any more
    have = packing._Available({x: 1 for x in [*range(1801, 1900), *range(1100, 1200), 1000, 100, 1211, 2689]}, 4000)
    have.sums()
    have.n[1100:1200] = 0
    assert sorted(have.exact(4000)) == [100, 1211, 2689]
    brute = random.Random(5)
    for _ in range(60):
        capacity = brute.choice([60, 300])
        own = {brute.randint(1, capacity): brute.randint(1, 2) for _ in range(brute.randint(3, 12))}
        flat = [k for k, c in own.items() for _ in range(c)]
        sums = {sum(c) for k in (1, 2, 3) for c in combinations(flat, k)}
        have = packing._Available(own, capacity)
        for gap in range(1, capacity + 1):
            found = have.exact(gap)
            assert (found is not None) == (gap in sums) and (found is None or sum(found) == gap)


@pytest.mark.parametrize("shard_rows", [packing.SHARD_ROWS, 50])
def test_pack(spark, shard_rows):
    r = random.Random(3)
    sizes = [r.choice([3, 3, 3, r.randint(1, 90), r.randint(1, 900)]) for _ in range(1500)] + [0] * 40 + [None, 100, 200, 250, 1001, 2300, 2300, 5000, 12345]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int").withColumn("container", F.lit("clash"))
    profiles = {"small": 100, "large": 1000, "one": 1}
    got = packing.pack(items, profiles, shard_rows=shard_rows).toPandas()
    for profile, capacity in profiles.items():
        own = got[got["profile"] == profile]
        assert set(own["id"]) == set(range(len(sizes)))
        assert own.groupby("container")["n_tokens"].sum().max() <= capacity
        assert own["container"].max() + 1 == own["container"].nunique()
        for i, parts in own.sort_values("start").groupby("id"):
            n = sizes[i] or 0
            assert parts["n_tokens"].sum() == n and len(parts) == max(1, -(-n // capacity))
            assert parts["start"].tolist() == [k * capacity for k in range(len(parts))] and parts["piece"].tolist() == list(range(len(parts)))
    filled = {x["profile"]: x for x in packing.report(packing.pack(items, profiles), spark.createDataFrame(list(profiles.items()), "profile string, capacity_tokens int")).collect()}
    assert filled["one"]["filled"] == 1 and filled["small"]["n_containers"] <= filled["small"]["least_containers"] + 1


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert packing.pack(empty, {"a": 5}).count() == 0
    blank = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens int")
    assert {r["container"] for r in packing.pack(blank, {"a": 5}).collect()} == {0}
    with pytest.raises(ValueError):
        packing.pack(blank, {"a": 0})
