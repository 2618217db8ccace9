"""Streaming forms give the batch results, also after a restart with new files."""

from drainrules.operators import apps as ap
from drainrules.operators import prepare as prep
from drainrules.session import scratch_path
from drainrules.sources import fixtures as fx
from drainrules.sources import io
from drainrules.streaming import incremental as inc

from conftest import SF001


def _halves(spark):
    rates = fx.sample_rates(spark, SF001)
    first = rates.where("sp.cur.reading_id % 2 = 0")
    return rates, first, rates.where("sp.cur.reading_id % 2 = 1")


def test_app_counts_stream_equals_batch_after_restart(spark):
    rates, first, second = _halves(spark)
    d, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-counts")
    first.repartition(3).write.parquet(d)
    inc.app_counts_stream(spark, d, out).awaitTermination()
    assert sorted(map(tuple, inc.read_app_counts(spark, out).collect())) == sorted(map(tuple, ap.app_usage_counts(first).collect()))
    second.repartition(2).write.mode("append").parquet(d)
    inc.app_counts_stream(spark, d, out).awaitTermination()
    assert sorted(map(tuple, inc.read_app_counts(spark, out).collect())) == sorted(map(tuple, ap.app_usage_counts(rates).collect()))


def test_recent_rates_stream_equals_batch_after_restart(spark):
    rates, first, second = _halves(spark)
    d, out = scratch_path(spark, "stream-in2"), scratch_path(spark, "stream-out")
    for part in (first, second):
        part.repartition(2).write.mode("append").parquet(d)
        inc.recent_rates_stream(spark, d, "1996-06-22", out).awaitTermination()
    got = io.read_recent_rates(spark, out).select("sp.cur.reading_id").collect()
    want = prep.filter_recent(rates, "1996-06-22").select("sp.cur.reading_id").collect()
    assert sorted(got) == sorted(want)
