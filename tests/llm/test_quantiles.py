import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("zonespark.llm")
from zonespark.llm import quantiles


def rank_of(sorted_values, value):
    """The interval of ranks, as shares, that a value can claim."""
    n = len(sorted_values)
    return np.searchsorted(sorted_values, value, "left") / n, np.searchsorted(sorted_values, value, "right") / n


def test_merged_days_stay_within_the_bound(spark):
    r = np.random.default_rng(7)
    n, k = 60_000, 200
    values = np.concatenate([r.lognormal(2, 2, n // 2), r.integers(0, 5, n // 2).astype(float)])
    df = spark.createDataFrame([(int(i % 13), "a" if i % 3 else "b", float(v)) for i, v in enumerate(r.permutation(values))], "day int, g string, v double")
    days = quantiles.sketches(df, ["g", "day"], "v", k)
    found = {x["g"]: x for x in quantiles.percentiles(quantiles.merged(days, ["g"], k)).collect()}
    for g, row in found.items():
        own = np.sort(np.array([x["v"] for x in df.where(F.col("g") == g).select("v").collect()]))
        assert row["n_values"] == len(own)
        for rank in quantiles.RANKS:
            low, high = rank_of(own, row[quantiles.name_of(rank)])
            assert low - quantiles.rank_error(k) <= rank <= high + quantiles.rank_error(k)


def test_small_groups_are_exact_and_odd_values_defined(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", float(v)) for v in range(1, 102)] + [("b", nan), ("b", None), ("c", 5.0), ("c", 5.0), ("c", nan), ("d", -inf), ("d", inf), ("d", 0.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("sketch_", F.lit("clash"))
    got = {x["g"]: x for x in quantiles.percentiles(quantiles.sketches(df, ["g"], "v"), (0.0, 0.5, 1.0)).collect()}
    assert set(got) == {"a", "c", "d", None}
    assert (got["a"]["p00"], got["a"]["p50"], got["a"]["p100"]) == (1.0, 51.0, 101.0)
    assert got["c"]["n_values"] == 2 and got["c"]["p50"] == 5.0 and got["d"]["p50"] == 0.0 and got[None]["p50"] == 7.0
    assert quantiles.sketches(df.where("false"), ["g"], "v").count() == 0


def test_names():
    assert [quantiles.name_of(r) for r in (0.05, 0.5, 0.999, 1.0)] == ["p05", "p50", "p99_9", "p100"]
    assert quantiles.rank_error(200) == pytest.approx(0.0133, abs=1e-4)


def test_any_union_of_days_of_a_destin(spark, tmp_path):
    from datetime import date, timedelta

    from zonespark.llm import queries

    r = np.random.default_rng(3)
    first = date(2023, 1, 1)
    # a hot zone written in two ways, small ones, a blank one
    rows = [(("ql-04 12345", "QL0412345")[i % 2], "bus", first + timedelta(days=int(r.integers(0, 200))), float(v)) for i, v in enumerate(r.lognormal(2, 1, 9000))]
    rows += [(f"QL04{i % 40:05d}", ("bus", None)[i % 2], first + timedelta(days=i % 7), float(i)) for i in range(800)]
    rows += [("--", "bus", first, 1.0), ("QL0400001", "bus", None, 1.0), ("QL0400001", "bus", first, None)]
    spark.createDataFrame(rows, "Destin string, Service string, FlowDate date, Flow double").write.parquet(str(tmp_path / "df_flow.parquet"))
    days = queries.day_sketches(spark, str(tmp_path))
    chosen = {"odd": {first + timedelta(days=d) for d in (0, 3, 5, 17, 99, 180)}, "late": {first + timedelta(days=d) for d in range(40, 200)}}
    unions = spark.createDataFrame([(name, d) for name, own in chosen.items() for d in own] + [("odd", first)], "days string, day date")
    found = {(x["destin"], x["service"], x["days"]): x for x in quantiles.percentiles(quantiles.over_days(days, unions, ["destin", "service"])).collect()}
    want = {}
    for destin, service, day, flow in rows:
        for name in chosen:
            if destin != "--" and flow is not None and day in chosen[name]:
                want.setdefault((destin.replace("-", "").replace(" ", "").upper(), service, name), []).append(flow)
    assert set(found) == set(want) and ("QL0412345", "bus", "late") in want
    for group, values in want.items():
        assert found[group]["n_values"] == len(values)
        error = quantiles.rank_error() if len(values) > quantiles.K else 1 / len(values)
        for rank in quantiles.RANKS:
            low, high = rank_of(np.sort(values), found[group][quantiles.name_of(rank)])
            assert low - error <= rank <= high + error
    got = queries.p1_day_unions(spark, str(tmp_path))
    assert got.columns[:3] == ["destin", "service", "days"] and {x["days"] for x in got.where("destin = 'QL0412345'").collect()} >= {"2023Q1", "2023Q2", "Mon"}
