"""App statistics: counts, popularity, top-k, global rank across partitions."""

from pyspark.sql import functions as F

from drainrules.operators import apps as ap


def test_counts_popular_topk(spark):
    rows = [(["a", "b"],), (["a"],), (["a", "a", "c"],), ([],)]
    rates = spark.createDataFrame(rows, "all_apps array<string>")
    counts = ap.app_usage_counts(rates)
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 3), ("b", 1), ("c", 1)]
    assert [r["app"] for r in ap.popular_apps(counts, 1).collect()] == ["a"]
    top = [tuple(r) for r in ap.top_apps(counts, 2).collect()]
    assert top == [("a", 3, 1), ("b", 1, 2)]


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("app"), F.col("id").cast("string")).alias("app"),
                                     (F.col("id") % 7).alias("n")).repartition(13)
    ranked = ap.with_global_rank(df, [F.desc("app")]).collect()
    by_rank = sorted(ranked, key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 5001))
    assert [r["app"] for r in by_rank] == sorted((r["app"] for r in ranked), reverse=True)


def test_global_rank_of_millions_under_aqe(spark):
    n = 4_000_000
    counts = (spark.range(0, 2 * n, numPartitions=8).select(F.concat(F.lit("app"), F.lpad((F.col("id") % n).cast("string"), 9, "0")).alias("app"),
                                           F.repeat(F.lit("x"), (F.col("id") % 13).cast("int")).alias("wide"))
              .groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.max("wide").alias("wide")))
    ranked = ap.with_global_rank(ap.by_name_desc(counts), [F.desc("app")])
    position = n - F.substring("app", 4, 9).cast("long")
    row = ranked.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("rank") != position).cast("int")).alias("off")).first()
    assert (row["rows"], row["off"]) == (n, 0)
