"""Duplicates hidden by formatting differences, counted in an incremental ledger.

Each record has a canonical key: its fields as their letters and digits say them, fields whose order
does not matter sorted, everything else as it is, digested to 128 bits. The ledger holds per key the
number of copies and the earliest representative, in buckets of the key. A batch is aggregated
first; its keys are full-outer-joined with the matching buckets alone, counts are added and the
earlier representative is kept. Untouched buckets are neither read nor written.

Buckets are files in a shared folder, as Spark's own bucketed tables have them, so that the join shuffles
the batch alone: the ledger's side lies where the join needs it. Their number follows the size of
the ledger: when a bucket would hold more than ``bucket_rows`` keys on average the buckets are split, each into
equally many, which rewrites the ledger as often as it doubles. A version of the ledger lists the files of
its buckets, so that an update that fails leaves the last version as it was.

Defined cases: records with a null key are no cases and enter no bucket; null equals null and NaN
equals NaN in every field; an empty batch leaves the ledger as it is; repeated records of one
batch count each. A group that holds a third of all rows is one row per task after aggregation. Records of
several tables may share a ledger, with the table's name in the digest and in ``tbl``; null is a name too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import list_files, materialize, read_bucketed, write_bucketed

#: Keys a bucket holds on average before buckets are split: some 60 MB.
BUCKET_ROWS = 1_000_000
SCHEMA = "key binary, tbl string, n bigint, first_id bigint"


def digest(fields: list[Column]) -> Column:
    """128 bits of the fields' values; nulls and NaN are values, names and types of columns don't matter."""
    record = F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)])
    return F.unhex(F.md5(F.to_json(record, {"ignoreNullFields": "false"})))


def same_number(column: Column) -> Column:
    """A number with both zeros as one."""
    return column + F.lit(0.0)


class Ledger:
    """Counts of canonical keys; ``update`` takes batches of ``key, row_id`` and maybe ``tbl``.

    ``keys`` and ``copies`` are how many there are; ``files[bucket]`` are a bucket's files by their path in the folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.folder, self.bucket_rows = spark, folder.rstrip("/"), bucket_rows
        # never fewer than tasks of a shuffle, or Spark would rather shuffle both sides of the join
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.keys, self.copies, self.files = 0, 0, 0, {}
        self._open()

    def _manifests(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return sorted(str(s.getPath().getName()) for s in files.listStatus(path) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def _open(self) -> None:
        """The last complete version."""
        done = self._manifests()
        if done:
            said = json.loads(self.spark.read.text(f"{self.folder}/manifest/{done[-1]}", wholetext=True).first()[0])
            self.version, self.buckets, self.keys, self.copies = (said[k] for k in ("version", "buckets", "keys", "copies"))
            self.files = {int(b): v for b, v in said["files"].items()}

    def _read(self, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{f}" for b, own in sorted(self.files.items()) if buckets is None or b in buckets for f in own]
        return read_bucketed(self.spark, paths, SCHEMA, self.buckets, "key")

    def counts(self) -> DataFrame:
        """``key, tbl, n, first_id`` of the whole ledger."""
        return self._read()

    def bucket_of(self, key: str = "key") -> Column:
        """The bucket of a key, as Spark's bucketed tables number them."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def update(self, batch: DataFrame) -> None:
        """Add a batch of ``key, row_id`` and maybe ``tbl``."""
        tbl = F.min("tbl") if "tbl" in batch.columns else F.lit(None).cast("string")
        new = batch.where("key is not null").groupBy("key").agg(tbl.alias("new_tbl"), F.count(F.lit(1)).alias("new_n"), F.min("row_id").alias("new_first"))
        new = materialize(new, "batch")
        keys, copies = new.agg(F.count(F.lit(1)), F.sum("new_n")).first()
        if not keys:
            return
        buckets = self.buckets
        while self.keys + keys > buckets * self.bucket_rows:
            buckets *= 2
        placed = new.repartition(self.buckets, "key")
        if self.files:
            # few keys touch few buckets, whose numbers are counted out; many touch all
            few = buckets == self.buckets and keys < self.buckets
            touched = {r[0] for r in new.select(self.bucket_of()).distinct().collect()} if few else None
            both = self._read(touched).join(placed, "key", "full_outer")
            merged = both.select("key", F.coalesce("tbl", "new_tbl").alias("tbl"), (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"), F.least("first_id", "new_first").alias("first_id"))
        else:
            merged = placed.select("key", F.col("new_tbl").alias("tbl"), F.col("new_n").alias("n"), F.col("new_first").alias("first_id"))
        if buckets != self.buckets:
            merged = merged.repartition(buckets, "key")
        version = self.version + 1
        # a folder of its own for each try, whatever one that failed left behind
        home = f"{version:09d}-{uuid.uuid4().hex[:8]}"
        written = {b: [f"{home}/{f}" for f in own] for b, own in write_bucketed(merged, f"{self.folder}/data/{home}", buckets, "key").items()}
        files = written if buckets != self.buckets else self.files | written
        total = self._read_of(files, buckets).count()
        said = {"version": version, "buckets": buckets, "keys": total, "copies": self.copies + copies, "files": files}
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{version:09d}")
        self.version, self.buckets, self.keys, self.copies, self.files = version, buckets, total, self.copies + copies, files

    def _read_of(self, files: dict[int, list[str]], buckets: int) -> DataFrame:
        """A count of its rows reads the files' footers alone."""
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/data/{f}" for own in files.values() for f in own])

    def vacuum(self) -> int:
        """Delete the files that the last version doesn't list; how many they were. No reader may be at an older version."""
        kept = {f for own in self.files.values() for f in own}
        jvm, gone = self.spark.sparkContext._jvm, 0
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for home in [str(s.getPath().getName()) for s in files.listStatus(path)] if files.exists(path) else []:
            for name in list_files(self.spark, f"{self.folder}/data/{home}"):
                if f"{home}/{name}" not in kept:
                    gone += files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{home}/{name}"), False)
        return gone


#: Keys that hold at least this share of all rows are joined by broadcast: at most 1 / share of them.
HOT_SHARE = 1 / 1000


def members(rows: DataFrame, book: Ledger) -> DataFrame:
    """``tbl, row_a, row_b``: the copies (``row_b``) of each repeated record of ``rows`` and its representative.

    The rows are shuffled to the ledger's buckets, which stay where they are; keys with many copies, of which
    there can only be few, are joined by broadcast, so that no group of copies gathers in one task."""
    repeated = book.counts().where("n > 1").select("key", "tbl", "n", "first_id")
    hot_from = max(2, book.copies * HOT_SHARE)
    hot, cold = repeated.where(F.col("n") >= hot_from), repeated.where(F.col("n") < hot_from)
    keyed = rows.select("key", "row_id").where("key is not null")

    def copies(found: DataFrame) -> DataFrame:
        return found.where("row_id <> first_id").select("tbl", F.col("first_id").alias("row_a"), F.col("row_id").alias("row_b"))

    # at most 1 / HOT_SHARE rows
    most = hot.collect()
    if not most:
        return copies(keyed.repartition(book.buckets, "key").join(cold, "key"))
    hot = F.broadcast(book.spark.createDataFrame(most, hot.schema))
    rest = keyed.join(hot.select("key"), "key", "left_anti").repartition(book.buckets, "key")
    return copies(keyed.join(hot, "key")).unionByName(copies(rest.join(cold, "key")))
