"""Bins: one pass, empty domains, exact selection against brute force."""

import math
import random

from pyspark.sql import functions as F

from drainrules.operators import features as feat
from drainrules.schemas import SAMPLE


def _frame(spark, col, values):
    rows = []
    for v in values:
        r = {c: None for c in SAMPLE.fieldNames()}
        r[col] = v
        rows.append(tuple(r[c] for c in SAMPLE.fieldNames()))
    return spark.createDataFrame(rows, SAMPLE)


def _brute(values, ps):
    s = sorted(values)
    n = len(s)
    return [s[max(1, min(n, math.ceil(p * n))) - 1] for p in ps]


def test_empty_domain_gives_zero_bins(spark):
    df = _frame(spark, "cpu", [5.0, -1.0, float("nan")])  # all outside [0, 1]
    bins = feat.compute_bins(df, exact=True)
    assert bins["cpu"] == [0.0, 0.0]
    assert bins["rate"] == [0.0, 0.0]


def test_exact_small_matches_brute_force(spark):
    random.seed(7)
    vals = [random.choice([0.1, 0.2, 0.3]) if i % 3 else random.random() for i in range(997)]
    df = _frame(spark, "cpu", vals).repartition(5)
    bins = feat.compute_bins(df, exact=True)
    assert bins["cpu"][1:-1] == _brute(vals, [0.25, 0.5, 0.75])
    assert bins["cpu"][0] == min(vals) and bins["cpu"][-1] == max(vals)


def test_exact_refinement_rounds_match_brute_force(spark):
    # a tiny threshold forces the distributed selection rounds
    random.seed(11)
    vals = [float(random.randint(-100, 0)) for _ in range(3000)] + [-50.0] * 700
    df = _frame(spark, "wifiStrength", vals).repartition(7)
    bins = feat.compute_bins(df, exact=True, exact_threshold=40, accuracy=50)
    assert bins["wifiStrength"][1:-1] == _brute(vals, [0.25, 0.5, 0.75])


def test_voltage_nan_left_out_of_bounds(spark):
    df = _frame(spark, "voltage", [3.0, float("nan"), 4.0, 5.0])
    bins = feat.compute_bins(df, exact=True)
    assert bins["voltage"] == [3.0, 3.0, 4.0, 5.0]


def test_excluded_features_have_no_bins(spark):
    df = _frame(spark, "cpu", [0.5])
    bins = feat.compute_bins(df, frozenset({"cpu", "voltage"}))
    assert "cpu" not in bins and "voltage" not in bins and "rate" in bins


def test_all_features_share_each_pass(spark):
    df = _frame(spark, "cpu", [0.1, 0.2, 0.3])
    sc = spark.sparkContext
    sc.setJobGroup("bins-one-pass", "bins")
    feat.compute_bins(df, exact=True)
    jobs = sc.statusTracker().getJobIdsForGroup("bins-one-pass")
    sc.setJobGroup("other", "other")
    # counts, then the exact pass (over a kept copy of the input); with AQE each
    # aggregate runs as two jobs, plus one for the kept copy: not one per feature
    assert len(jobs) <= 6


def test_sketched_bins_stay_within_the_rank_error(spark):
    random.seed(3)
    vals = [random.random() ** 3 for _ in range(40_000)]
    df = _frame(spark, "cpu", vals).repartition(9)
    ordered = sorted(vals)
    for salts in (1, 4, 64):
        low, *quantiles, high = feat.compute_bins(df, accuracy=200, salts=salts)["cpu"]
        assert (low, high) == (ordered[0], ordered[-1])
        for p, q in zip([0.25, 0.5, 0.75], quantiles):
            assert abs(ordered.index(q) / len(vals) - p) <= 2 / 200
    some = vals[:20_000]  # the default sketch holds more values than these
    assert feat.compute_bins(_frame(spark, "cpu", some))["cpu"][1:-1] == _brute(some, [0.25, 0.5, 0.75])


def test_sketches_are_merged_in_two_levels(spark):
    df = _frame(spark, "cpu", [0.1] * 50).repartition(20)
    specs = feat.binned_specs(frozenset())
    salted = feat.sketched_bins(df, specs, 100, 3)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "kll_merge_agg_double" in plan and "__salt" in plan
    executed = salted._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(__salt") == 1 and executed.count("Exchange SinglePartition") == 1
    assert 2.296 / feat.sketch_size(10_000) ** 0.9723 <= 1e-4


def test_stored_samples_observe_rows_and_ends(spark):
    df = _frame(spark, "cpu", [0.5, 0.25, None, float("nan"), 7.0])
    stored = feat.store_samples(df)
    assert stored.n_rows == 5 and stored.ends["cpu"] == (0.25, 0.5, 2) and stored.ends["rate"] == (None, None, 0)
    assert feat.compute_bins(stored.samples, exact=True, ends=stored.ends) == feat.compute_bins(df, exact=True)
    empty = feat.store_samples(df.limit(0))
    assert empty.n_rows == 0 and feat.compute_bins(empty.samples, ends=empty.ends)["cpu"] == [0.0, 0.0]
    assert feat.compute_bins(empty.samples)["cpu"] == [0.0, 0.0]


def test_transactions_join_their_tables_once(spark):
    from conftest import SF001
    from drainrules.plans import catalog

    sc = spark.sparkContext
    sc.setJobGroup("transactions-once", "transactions")
    df = catalog.q_transactions(spark, SF001)
    jobs = len(sc.statusTracker().getJobIdsForGroup("transactions-once"))
    sc.setJobGroup("other", "other")
    assert jobs <= 6  # two of them read the schemas of the tables
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_orderkey" not in plan
