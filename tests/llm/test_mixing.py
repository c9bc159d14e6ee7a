import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("zonespark.llm")
from zonespark.llm import mixing, tokens


def test_rates_reach_the_targets_within_the_caps():
    have = {"a": (10, 1000), "b": (10, 100), "c": (1, 50)}
    targets = [("a", 0.5, 1), ("b", 0.25, 4), ("c", 0.0, 9), ("d", 0.25, 3)]
    made = {r.source: r for r in mixing.rates(have, targets)}
    # the target of a source without documents is shared out; b at its cap bounds the total
    assert made["b"].rate == 4 and made["a"].rate == pytest.approx(0.8) and made["c"].rate == 0 and made["d"].rate == 0
    big = {r.source: r.rate for r in mixing.rates(have, targets, 1e9)}
    assert big["a"] == 1 and big["b"] == 4
    some = {r.source: r.rate * have[r.source][1] for r in mixing.rates(have, targets[:3], 900)}
    assert some["b"] == pytest.approx(300) and some["a"] == pytest.approx(600)
    capped = {r.source: r.rate * have[r.source][1] for r in mixing.rates(have, targets[:3], 1300)}
    assert capped["b"] == pytest.approx(400) and capped["a"] == pytest.approx(900)
    assert mixing.rates({}, targets)[0].rate == 0


def test_mix(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["big"] * 8 + ["mid", None, "other"]), r.randint(0, 60)) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int").withColumn("rate", F.lit("clash")).withColumn("copy", F.lit(9))
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    picked, made = mixing.mix(df, targets)
    again = mixing.mix(df.repartition(7), targets)[0]
    rows = sorted(tuple(x) for x in picked.collect())
    assert rows == sorted(tuple(x) for x in again.collect())
    rate = {x.source: x.rate for x in made}
    uses = {}
    for i, s, _, k in rows:
        uses.setdefault(i, []).append(k)
        assert s in ("big", "mid")
    source = {i: s for i, s, _ in docs}
    for i, ks in uses.items():
        assert sorted(ks) == list(range(1, len(ks) + 1)) and len(ks) in (int(rate[source[i]]), int(rate[source[i]]) + 1) and len(ks) <= (1 if source[i] == "big" else 3)
    got = {x["source"]: x for x in mixing.shares(picked, made).collect()}
    assert got["big"]["reached_share"] == pytest.approx(2 / 3, abs=0.02) and got["mid"]["reached_share"] == pytest.approx(1 / 3, abs=0.02) and got["none"]["used_tokens"] == 0
    assert mixing.mix(df.where("false"), targets)[0].count() == 0


def test_token_counts_like_the_stated_pattern(spark):
    import base64

    import tiktoken

    public = pytest.importorskip("public_tokenizers")
    with open(f"{tokens.FOLDER}/{tokens.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "It's 12 o'clock, we'll go.", "\n\n  a\tb   ", "Größe – naïve 𝒳 <|endoftext|>", "x" * 30_000, "word " * 20_000]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(other.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
