"""Queries p1, p3, p7, p8 and p9 over the data tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import letters_and_digits, zone_key
from ..plans.runtime import materialize, scratch_path
from ..sources.tables import table
from . import ledger, mixing, packing, quantiles, residue, tokens
from .sql import SQL  # noqa: F401

# --- p1: percentiles of very large numeric columns


def _flows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "df_flow").select(zone_key(F.col("Destin")).alias("destin"), F.col("Service").alias("service"), F.col("FlowDate").alias("day"), F.col("Flow").alias("flow"))


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of Flow per Destin zone, Service and month; blank Destin references left out."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    groups = _flows(spark, folder).where("destin is not null").select("destin", "service", month, "flow")
    return quantiles.percentiles(quantiles.sketches(groups, ["destin", "service", "month"], "flow")).withColumn("rank_error", F.when(F.col("n_values") > quantiles.K, quantiles.rank_error()).otherwise(0.0))


def day_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Stored sketches of Flow per Destin zone, Service and day, to be merged over any union of days; blank Destin references left out."""
    return materialize(quantiles.sketches(_flows(spark, folder).where("destin is not null"), ["destin", "service", "day"], "flow"), "days")


def p1_day_unions(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of Flow per Destin zone and Service over unions of days, from stored sketches of single days: all days of each quarter, and all of each weekday."""
    days = day_sketches(spark, folder)
    names = F.array(F.concat(F.year("day").cast("string"), F.lit("Q"), F.quarter("day").cast("string")), F.date_format("day", "EEE"))
    unions = days.select("day").distinct().select("day", F.explode(names).alias("days"))
    found = quantiles.percentiles(quantiles.over_days(days, unions, ["destin", "service"]))
    return found.withColumn("rank_error", F.when(F.col("n_values") > quantiles.K, quantiles.rank_error()).otherwise(0.0))


def p1_outside(spark: SparkSession, folder: str) -> DataFrame:
    """For each percentile the groups of ``p1_percentiles`` whose answer is off by more than the stated error (or one
    value, whatever is more), by the exact ranks of all values: none, or one in a hundred of the groups above K values at most."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    flows = _flows(spark, folder).where("destin is not null and flow is not null and not isnan(flow)").select("destin", "service", month, "flow")
    keys = ["destin", "service", "month"]
    # values that repeat are counted before they meet their group's answers
    values = flows.groupBy(*keys, "flow").agg(F.count(F.lit(1)).alias("c"))
    found = materialize(p1_percentiles(spark, folder), "percentiles")
    same = [values[k].eqNullSafe(found[k]) for k in keys]
    names = {r: quantiles.name_of(r) for r in quantiles.RANKS}
    ranks = [F.sum(F.when(test(F.col(n)), F.col("c")).otherwise(0)).alias(f"{side}_{n}") for n in names.values() for side, test in (("below", lambda v: F.col("flow") < v), ("upto", lambda v: F.col("flow") <= v))]
    met = values.join(found, same).groupBy(*[found[k] for k in keys]).agg(F.max("n_values").alias("n"), F.max("rank_error").alias("e"), *ranks)
    off = F.greatest(F.col("e"), 1 / F.col("n"))
    outside = [F.struct(F.lit(r).alias("share"), ((F.col(f"below_{n}") / F.col("n") - off > r) | (F.col(f"upto_{n}") / F.col("n") + off < r)).cast("bigint").alias("out")) for r, n in names.items()]
    return met.select(F.explode(F.array(*outside)).alias("o")).groupBy("o.share").agg(F.sum("o.out").alias("n_outside"))


# --- p3: duplicates hidden by formatting differences


def zone_records(spark: SparkSession, folder: str) -> DataFrame:
    """``tbl, row_id, key, loaded_at`` of the zone records; null key for a blank reference."""
    coords, n, tbl = table(spark, folder, "coords_df"), ledger.same_number, F.lit("coords_df")
    key = zone_key(F.col("ZoneID"))
    fields = [tbl, key, letters_and_digits(F.col("ZoneName")), *[n(F.col(c)) for c in ("XCoord", "YCoord", "POPU", "hosp")], F.col("AddedOn"), F.col("RemovedOn"), F.col("geometry")]
    return coords.select(tbl.alias("tbl"), "row_id", F.when(key.isNotNull(), ledger.digest(fields)).alias("key"), "loaded_at")


def neighbour_records(spark: SparkSession, folder: str) -> DataFrame:
    """``tbl, row_id, key, loaded_at`` of the adjacency records; the order of the two zones doesn't matter."""
    adj, tbl = table(spark, folder, "df_adj"), F.lit("df_adj")
    a, b = zone_key(F.col("focal")), zone_key(F.col("neighbor"))
    fields = [tbl, F.least(a, b), F.greatest(a, b), F.col("SnapshotOn"), ledger.same_number(F.col("BorderKm"))]
    return adj.select(tbl.alias("tbl"), "row_id", F.when(a.isNotNull() & b.isNotNull(), ledger.digest(fields)).alias("key"), "loaded_at")


def filled_ledger(spark: SparkSession, folder: str) -> tuple[ledger.Ledger, DataFrame]:
    """A ledger that took the records of both tables year by year as they were loaded, those without a load time
    first; and the records with their keys, which are digested once."""
    rows = zone_records(spark, folder).unionByName(neighbour_records(spark, folder)).where("key is not null")
    keyed = materialize(rows.select("tbl", "row_id", "key", F.coalesce(F.year("loaded_at"), F.lit(0)).alias("year")), "keyed", ["year"])
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"))
    # one folder for each year
    for year in sorted(r[0] for r in keyed.select("year").distinct().collect()):
        book.update(keyed.where(F.col("year") == year))
    return book, keyed


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The copies of repeated records with their representatives."""
    book, keyed = filled_ledger(spark, folder)
    return ledger.members(keyed, book)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each record once, by its representative, with its number of copies."""
    book, _ = filled_ledger(spark, folder)
    return book.counts().select("tbl", F.col("first_id").alias("row_id"), F.col("n").alias("n_copies"))


# --- p7: filling fixed-capacity containers


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    profiles = table(spark, folder, "pack_profiles")
    # a table of profiles is a handful of rows; the plan of each is made on the driver
    capacities = {r["profile"]: r["capacity_tokens"] for r in profiles.collect()}
    return packing.pack(tokens.token_counts(table(spark, folder, "documents")), capacities), profiles


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """A place for every post under every profile."""
    return _packed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each profile are."""
    return packing.report(*_packed(spark, folder))


# --- p8: mixing sources to target weights


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, list[mixing.Rate]]:
    sized = materialize(tokens.token_counts(table(spark, folder, "documents"), keep=("doc_id", "source")), "sized")
    return mixing.mix(sized, table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The picked posts, one row for each use."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of each source."""
    return mixing.shares(*_mixed(spark, folder))


# --- p9: template residue and error-page text


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts that are left-over template, filler, error page or script notice."""
    return residue.residue(table(spark, folder, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The posts that are kept: all others."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source", "kind").join(residue.residue(docs).select("doc_id"), "doc_id", "left_anti")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Residue by source and reason."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source").join(residue.residue(docs), "doc_id").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_posts"))


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_day_unions": p1_day_unions,
    "p1_outside": p1_outside,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p7_packing": p7_packing,
    "p7_report": p7_report,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_kept": p9_kept,
    "p9_report": p9_report,
}
