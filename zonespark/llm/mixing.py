"""Mixing sources to target weights.

The tokens per source are aggregated; each source's repetition rate is its share of the total
wanted, divided by what it has, and never above its cap. A document is then emitted floor(rate)
times, plus once more with the probability of the fraction, drawn from a hash of seed and id:
no shuffle of documents, and the same draw on every run and after every loss of an executor.

Without a total given, it is the largest at which no source needs more than its cap, so that the
shares come out as wanted among the sources that have documents; the targets of sources that
have none are shared out among the others in proportion. With a total given, sources at
their cap stay there and their shortfall is shared out among the rest, until all is placed or all are capped.

Defined cases: documents of a null or unlisted source, or of a source with target 0, are not used;
a null cap means one use; documents without tokens are emitted at their source's rate and add
nothing; repeated ids are emitted each; no documents, no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20240917
#: Targets are a table of the user's; it is broadcast after a check that it has no more rows than this.
MOST_SOURCES = 100_000


@dataclass(frozen=True)
class Rate:
    source: str
    target: float
    cap: int
    tokens: int
    docs: int
    rate: float


def rates(have: dict[str, tuple[int, int]], targets: list[tuple[str, float, int | None]], total: float | None = None) -> list[Rate]:
    """Repetition rates from (docs, tokens) per source and (source, target share, most uses)."""
    wanted = {s: (max(0.0, t or 0.0), 1 if c is None else max(0, c)) for s, t, c in targets}
    usable = {s for s, (t, c) in wanted.items() if t > 0 and c > 0 and have.get(s, (0, 0))[1] > 0}
    weight = sum(wanted[s][0] for s in usable)
    most = {s: wanted[s][1] * have[s][1] for s in usable}
    if total is None:
        total = min((most[s] * weight / wanted[s][0] for s in usable), default=0.0)
    give: dict[str, float] = {}
    open_, left = set(usable), min(float(total), float(sum(most.values())))
    while open_:
        share = sum(wanted[s][0] for s in open_)
        capped = {s for s in open_ if left * wanted[s][0] / share > most[s]}
        if not capped:
            give |= {s: left * wanted[s][0] / share for s in open_}
            break
        give |= {s: float(most[s]) for s in capped}
        left -= sum(most[s] for s in capped)
        open_ -= capped
    return [Rate(s, t, c, have.get(s, (0, 0))[1], have.get(s, (0, 0))[0], give.get(s, 0.0) / have[s][1] if s in usable else 0.0) for s, (t, c) in wanted.items()]


def draw(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to below 1 from the hash of seed and key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / F.lit(float(1 << 53))


def source_sizes(docs: DataFrame) -> dict[str, tuple[int, int]]:
    """(documents, tokens) per source that is listed in the targets; partial before the shuffle."""
    rows = docs.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("d"), F.sum("n_tokens").alias("t"))
    return {r["source"]: (r["d"], r["t"] or 0) for r in rows.collect()}


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> tuple[DataFrame, list[Rate]]:
    """The picked documents, ``doc_id, source, n_tokens, copy`` with one row for each use, and the rates.

    ``docs`` has ``doc_id, source, n_tokens``; ``targets`` has ``source, target_share, max_repeats``.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", "n_tokens")
    if targets.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    listed = [tuple(r) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()]
    listed_names = F.broadcast(targets.select("source").distinct())
    made = rates(source_sizes(docs.join(listed_names, "source", "left_semi")), listed, total)
    table = spark.createDataFrame([(r.source, r.rate, r.cap) for r in made], "source string, rate double, cap int")
    uses = F.least(F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0), F.col("cap")).cast("int")
    picked = docs.join(F.broadcast(table), "source").withColumn("uses", uses).where("uses > 0")
    return picked.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy")), made


def shares(picked: DataFrame, made: list[Rate]) -> DataFrame:
    """Per listed source what was wanted and what was reached."""
    spark = picked.sparkSession
    plan = spark.createDataFrame([(r.source, r.target, r.cap, r.docs, r.tokens, r.rate) for r in made], "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, rate double")
    got = picked.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("copy").alias("most_uses"))
    joined = plan.join(got, "source", "left")
    whole = got.agg(F.sum("used_tokens").alias("whole"))
    return joined.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.round("rate", 9).alias("rate"),
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.round(F.coalesce("used_tokens", F.lit(0)) / F.greatest("whole", F.lit(1)), 9).alias("reached_share"),
    )
