import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("zonespark.llm")
from zonespark.llm import ledger
from zonespark.plans.runtime import scratch_path


def rows(n=2000, seed=1):
    r = random.Random(seed)
    return [(i, None if r.random() < 0.02 else "hot" if r.random() < 0.35 else f"k{r.randrange(400)}") for i in range(n)]


def keyed(spark, data):
    return spark.createDataFrame(data, "row_id long, k string").select("row_id", F.when(F.col("k").isNotNull(), ledger.digest([F.col("k")])).alias("key"))


@pytest.mark.parametrize("parts", [1, 3])
def test_batches_add_up(spark, parts):
    data = rows()
    random.Random(2).shuffle(data)
    # buckets are split on the way
    book = ledger.Ledger(spark, scratch_path(spark, "book"), buckets=4, bucket_rows=60)
    for i in range(parts):
        book.update(keyed(spark, data[i::parts]))
    book.update(keyed(spark, []))
    want = {}
    for i, k in data:
        if k is not None:
            n, first = want.get(k, (0, i))
            want[k] = (n + 1, min(first, i))
    again = ledger.Ledger(spark, book.folder)
    assert again.version == book.version == parts and again.buckets == {1: 8, 3: 16}[parts]
    assert (again.keys, again.copies) == (len(want), sum(n for n, _ in want.values()))
    assert sorted((r["n"], r["first_id"]) for r in again.counts().collect()) == sorted(want.values())
    members = {(want[k][1], i) for i, k in data if k is not None and want[k][1] != i}
    assert {(r["row_a"], r["row_b"]) for r in ledger.members(keyed(spark, data), again).collect()} == members
    assert again.vacuum() > 0 if parts > 1 else again.vacuum() == 0
    assert {(r["row_a"], r["row_b"]) for r in ledger.members(keyed(spark, data), again).collect()} == members


def test_one_small_batch_touches_one_bucket(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "book"), buckets=8)
    book.update(keyed(spark, [(i, f"k{i}") for i in range(200)]))
    before = dict(book.files)
    book.update(keyed(spark, [(500, "k3")]))
    assert len(before) == 8 and sum(before[b] != v for b, v in book.files.items()) == 1
    assert book.counts().agg(F.sum("n")).first()[0] == 201
    # of the version the one bucket's file was written, and it is the bucket of the key
    changed = next(b for b, v in book.files.items() if v != before[b])
    assert keyed(spark, [(500, "k3")]).select(book.bucket_of()).first()[0] == changed and book.files[changed][0].startswith("000000002-")
    assert all(name.startswith("000000001-") for b, own in book.files.items() if b != changed for name in own)


def test_the_ledgers_side_is_not_shuffled(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "book"), buckets=8)
    book.update(keyed(spark, [(i, f"k{i % 50}") for i in range(100)]))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = book.counts().join(keyed(spark, [(1, "k1")]).repartition(8, "key"), "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_an_update_that_fails_changes_nothing(spark, monkeypatch):
    book = ledger.Ledger(spark, scratch_path(spark, "book"), buckets=2)
    book.update(keyed(spark, [(1, "a"), (2, "a"), (3, "b")]))
    write = ledger.write_bucketed

    def fail(*given):
        write(*given)
        raise OSError

    monkeypatch.setattr(ledger, "write_bucketed", fail)
    with pytest.raises(OSError):
        book.update(keyed(spark, [(4, "a")]))
    monkeypatch.undo()
    assert sorted(r["n"] for r in ledger.Ledger(spark, book.folder).counts().collect()) == [1, 2]
    # what was left behind is written over
    again = ledger.Ledger(spark, book.folder)
    again.update(keyed(spark, [(5, "b"), (None, "a")]))
    assert sorted((r["n"], r["first_id"]) for r in again.counts().collect()) == [(2, 3), (3, 1)]


def test_digest(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "a", nan, [[(1.0, 2.0)]]), (2, "a", nan, [[(1.0, 2.0)]]), (3, "a", None, [[(1.0, 2.0)]]), (4, "a", 0.0, None), (5, "a", -0.0, None), (6, None, 0.0, None), (7, "", 0.0, None)], "i int, s string, d double, g array<array<struct<x: double, y: double>>>")
    got = {r["i"]: r["k"] for r in df.select("i", ledger.digest([F.col("s"), ledger.same_number(F.col("d")), F.col("g")]).alias("k")).collect()}
    assert got[1] == got[2] and got[4] == got[5] and len(set(got.values())) == 5
