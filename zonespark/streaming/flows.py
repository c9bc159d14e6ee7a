"""Streams of raw flow lines: the error parse applied as they arrive, valid and failed records apart.

The parse works record by record, so it needs no state and no watermark; totals per key and period do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse_errors import Field, parse


def quarantine(lines: DataFrame, raw: str, fields: list[Field], valid_path: str, failed_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the valid records of a stream to one Parquet folder and the failed ones, with reason and edits, to another."""
    parsed = parse(lines, raw, fields)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("parsed.reason is null").select("*", "parsed.value.*").drop("parsed", raw).withColumn("batch", F.lit(number)).write.mode("append").parquet(valid_path)
        batch.where("parsed.reason is not null").select(*lines.columns, "parsed.reason", "parsed.edits").withColumn("batch", F.lit(number)).write.mode("append").parquet(failed_path)
        batch.unpersist()

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_totals(flows: DataFrame, at: str, length: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows and flow per destination and window of event time; records later than ``late`` are left out."""
    return flows.withWatermark(at, late).groupBy(F.window(at, length).alias("window"), "destin").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("flow").alias("total_flow"))
