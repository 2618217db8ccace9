"""Incremental forms of existing batch operators over a growing rates folder.

The original jobs are batch only; when new rate files keep arriving, the same
two operators can run as Structured Streaming queries instead of rescanning:

* ``app_counts_stream``: app usage counts (explode -> groupBy -> count); the
  state is one row per app, updated with partial aggregation per batch, and
  each batch's counts are a table of their own under the output folder.
* ``recent_rates_stream``: the recency filter, appended to month-partitioned
  parquet (same layout as ``io.write_recent_rates``).

The checkpoint lies in the output folder (``_checkpoint``, which readers skip)
unless the caller names another, so a query that is started again on the same
folders goes on after the last batch it finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drainrules import schemas
from drainrules.operators import apps as ap
from drainrules.operators import prepare as prep


def read_rates_stream(spark: SparkSession, rates_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.RATE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(rates_dir)


def app_counts_stream(spark: SparkSession, rates_dir: str, out_dir: str, *, checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Running ``(app, n)``: a table per batch under ``out_dir``; a repeated batch overwrites its own."""
    counts = ap.app_usage_counts(read_rates_stream(spark, rates_dir))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    writer = (counts.writeStream.outputMode("complete").foreachBatch(store)
              .option("checkpointLocation", checkpoint or f"{out_dir}/_checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_app_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counts after the last finished batch."""
    stored = spark.read.schema("app string, n bigint, batch bigint").parquet(out_dir)
    last = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == F.lit(last)).select("app", "n")


def recent_rates_stream(spark: SparkSession, rates_dir: str, since: str | float, out_dir: str, *,
                        checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append discharging rates after ``since`` to month-partitioned parquet."""
    recent = prep.filter_recent(read_rates_stream(spark, rates_dir), since)
    month = F.date_format(F.timestamp_seconds(F.col("sp.cur.time").cast("long")), "yyyy-MM")
    writer = (recent.withColumn("month", month).writeStream.outputMode("append").format("parquet")
              .partitionBy("month").option("path", out_dir)
              .option("checkpointLocation", checkpoint or f"{out_dir}/_checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
