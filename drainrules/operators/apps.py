"""App usage statistics over rate records.

Counting is ``explode -> groupBy -> count``: partial aggregation happens
before the shuffle, so even an app present in a third of all rates costs
one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drainrules.session import materialize

# --- fixed values: app picker of the search form -----------------------------
POPULAR_MIN_COUNT = 1000   # apps shown must have more rates than this
PICKER_MAX_OPTIONS = 100   # the picker lists at most this many apps


def app_usage_counts(rates: DataFrame) -> DataFrame:
    """``(app, n)``: number of rates whose app set contains the app."""
    apps = rates.select(F.explode(F.array_distinct("all_apps")).alias("app"))
    return apps.groupBy("app").agg(F.count(F.lit(1)).alias("n"))


def popular_apps(counts: DataFrame, min_count: int = POPULAR_MIN_COUNT) -> DataFrame:
    """Apps with strictly more than ``min_count`` rates."""
    return counts.where(F.col("n") > F.lit(int(min_count)))


def top_apps(counts: DataFrame, k: int = PICKER_MAX_OPTIONS) -> DataFrame:
    """The ``k`` most used apps (ties by name), with their rank 1..k.

    ``orderBy().limit(k)`` plans as a per-partition top-k plus one merge of
    at most ``k`` rows per partition; the rank window then sees k rows only.
    """
    top = counts.orderBy(F.desc("n"), F.asc("app")).limit(int(k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("app"))).cast("long"))


def by_name_desc(counts: DataFrame) -> DataFrame:
    """App counts ordered by app name, descending (range-partitioned sort)."""
    return counts.orderBy(F.desc("app"))


def with_global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based position in a total order, without moving all rows to one task.

    Rows are range-partitioned by the order and stored once with the number of
    their partition, so that numbering and counting see the same partitions
    (two plans of one sort would each sample bounds of their own).  Each
    partition numbers its rows locally, and the per-partition row counts (one
    small row per partition) give the offsets.
    """
    stored = materialize(df.orderBy(*order).withColumn("__pid", F.spark_partition_id()), "ranked")
    local = stored.withColumn(
        "__local", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))
    sizes = stored.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    out = local.join(F.broadcast(offsets), "__pid")  # one row per partition
    return out.withColumn(name, (F.coalesce(F.col("__off"), F.lit(0)) + F.col("__local")).cast("long")).drop(
        "__pid", "__local", "__off")
