"""As-of join and pairing against brute force, for several bucket widths."""

import random

import pytest
from pyspark.sql import functions as F

from drainrules.operators import prepare as prep
from drainrules.sources import fixtures as fx

from conftest import SF001


def _brute_pairs(readings):
    by = {}
    for r in readings:
        by.setdefault(r[1], []).append(r)
    out = set()
    for u, rs in by.items():
        rs.sort(key=lambda r: (r[2], r[0]))
        for a, b in zip(rs, rs[1:]):
            if b[2] > a[2]:
                out.add((u, a[0], b[0]))
    return out


@pytest.mark.parametrize("width", [0.5, 3.0, 1e9, "auto"])
def test_pairing_matches_brute_force(spark, width):
    random.seed(3)
    rows = []
    for i in range(400):
        uuid = "hot" if i % 3 == 0 else f"d{i % 17}"   # one device holds a third of the rows
        rows.append((i, uuid, float(random.randint(0, 60)), float(random.randint(0, 100))))
    df = spark.createDataFrame(rows, "reading_id long, uuid string, time double, battery_level double")
    for c, t in [("distanceTraveled", "double"), ("apps", "array<string>")]:
        df = df.withColumn(c, F.lit(None).cast(t))
    from drainrules.schemas import ANDROID_FIELDS
    df = df.withColumn("androidFields", F.lit(None).cast(ANDROID_FIELDS))
    pairs = prep.pair_readings(df, bucket_width=width)
    got = {(r["uuid"], r["prev"]["reading_id"], r["cur"]["reading_id"]) for r in pairs.collect()}
    assert got == _brute_pairs(rows)


@pytest.mark.parametrize("width", [0.7, 5.0, 1e9, "auto"])
def test_asof_registration_matches_brute_force(spark, width):
    random.seed(5)
    regs = [(f"d{random.randint(0, 4)}", float(random.randint(0, 40)), str(random.randint(0, 3))) for _ in range(30)]
    rows = [(i, f"d{random.randint(0, 5)}", float(random.randint(0, 50))) for i in range(200)]
    rdf = spark.createDataFrame(regs, "uuid string, reg_time double, os string")
    ldf = spark.createDataFrame(rows, "rid long, uuid string, time double")
    out = prep.asof_registration(ldf, rdf, "uuid", "time", "rid", bucket_width=width)
    got = {r["rid"]: (r["registration"]["reg_time"], r["registration"]["os"]) if r["registration"] else None
           for r in out.collect()}
    for rid, uuid, t in rows:
        cands = [(g[1], g[2]) for g in regs if g[0] == uuid and g[1] <= t]
        assert got[rid] == (max(cands) if cands else None)


def test_fixture_pairs_and_rates(spark):
    readings = prep.filter_android(fx.device_readings(spark, SF001))
    pairs = prep.pair_readings(readings, bucket_width=100.0)
    rates = prep.rates_from_pairs(pairs, fx.registrations(spark, SF001), bucket_width=100.0)
    assert rates.count() == pairs.count() > 0
    bad = rates.where(F.col("sp.cur.time") <= F.col("sp.prev.time")).count()
    assert bad == 0


def test_recent_filter_rejects_nan_and_negative(spark):
    from drainrules.schemas import RATE
    rows = [(float("nan"), 10.0), (-0.1, 10.0), (0.0, 10.0), (0.5, 5.0), (0.5, 11.0)]
    df = spark.createDataFrame([(r, t) for r, t in rows], "rate double, t double").select(
        "rate", F.struct(F.lit(None).cast(RATE["sp"].dataType["prev"].dataType).alias("prev"),
                         F.struct(F.col("t").alias("time")).alias("cur")).alias("sp"))
    got = sorted((r["rate"], r["sp"]["cur"]["time"]) for r in prep.filter_recent(df, 5.0).collect())
    assert got == [(0.0, 10.0), (0.5, 11.0)]
    assert prep.unix_seconds("2016-06-22") == 1466553600.0


def _hot_rows(n=900):
    random.seed(9)
    rows = [(i, "hot", random.choice([float(i), 100.0 + i / 1000.0, 50.0]), 1.0) for i in range(n)]  # a burst, and many at one time
    rows += [(n + i, f"d{i % 40}", float(random.randint(0, 60)), 2.0) for i in range(300)]
    rows += [(5000 + i, "warm", float(i), 2.0) for i in range(150)]
    return rows


@pytest.mark.parametrize("slice_rows", [7, 40, 100, 10_000])
def test_hot_devices_are_cut_at_their_own_times(spark, slice_rows):
    from drainrules.operators.asof import asof_join, previous_row, split_points

    rows = _hot_rows()
    df = spark.createDataFrame(rows, "reading_id long, uuid string, time double, battery_level double").repartition(5)
    cut = split_points([(df, "uuid", "time")], slice_rows)
    counts = {u: sum(r[1] == u for r in rows) for u in {r[1] for r in rows}}
    hot = {u for u, n in counts.items() if n > slice_rows}
    assert {r["__k"] for r in cut.collect()} == hot if hot else cut is None
    paired = previous_row(df, "uuid", "time", [F.col("time"), F.col("reading_id")], bucket_width="auto", slice_rows=slice_rows)
    got = {(r["uuid"], r["prev"]["reading_id"], r["reading_id"]) for r in paired.collect() if r["prev"] and r["time"] > r["prev"]["time"]}
    assert got == _brute_pairs(rows)
    regs = [(random.choice(["hot", "warm", "d1", "none"]), random.uniform(0, 900), str(i)) for i in range(200)]
    rdf = spark.createDataFrame(regs, "u string, reg_time double, os string")
    out = asof_join(df, rdf, "uuid", "time", "reg_time", [F.col("time"), F.lit(1), F.col("reading_id").cast("string")],
                    [F.col("reg_time"), F.lit(0), F.col("os")], bucket_width="auto", right_key="u", slice_rows=slice_rows)
    found = {r["reading_id"]: r["match"]["os"] if r["match"] else None for r in out.collect()}
    assert len(found) == len(rows)
    for rid, u, t, _ in rows:
        before = [(g[1], g[2]) for g in regs if g[0] == u and g[1] <= t]
        assert found[rid] == (max(before)[1] if before else None)


def test_a_burst_leaves_cold_devices_in_one_slice(spark):
    from drainrules.operators.asof import _sliced, split_points

    calm = [(f"d{i % 40}", float(i)) for i in range(400)]
    burst = [("hot", 100.0 + i * 1e-6) for i in range(2000)]
    df = spark.createDataFrame(calm + burst, "uuid string, time double")
    cut = split_points([(df, "uuid", "time")], 100)
    sliced = _sliced(df.selectExpr("uuid AS __k", "time AS __t"), cut)
    per = {(r["__k"], r["__b"]): r["count"] for r in sliced.groupBy("__k", "__b").count().collect()}
    assert {k: n for k, n in per.items() if k[0] != "hot"} == {(f"d{i}", 0): 10 for i in range(40)}
    slices = [n for (k, _), n in per.items() if k == "hot"]
    assert len(slices) >= 20 and max(slices) <= 150
    assert not sliced.where("__hot and __k <> 'hot'").count()


def test_one_shared_time_is_said(spark, caplog):
    from drainrules.operators.asof import split_points

    same = spark.createDataFrame([("hot", 5.0)] * 50, "uuid string, time double")
    assert split_points([(same, "uuid", "time")], 20).collect()[0]["__at"] == [5.0]
    assert "share one" in caplog.text


def test_no_hot_device_means_one_shuffle(spark):
    readings = prep.filter_android(fx.device_readings(spark, SF001))
    plan = prep.pair_readings(readings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


NAN = float("nan")


@pytest.mark.parametrize("width", [0.7, 2.0, 100.0, 1e6, "auto"])
def test_times_without_order_match_nothing(spark, width):
    rows = [(1, "a", 1.0), (2, "a", NAN), (3, "a", 2.5), (4, "a", None), (5, "a", 9.0), (6, None, 3.0), (7, "b", NAN), (8, "b", None), (9, "a", -3.0)]
    regs = [("a", None, "none"), ("a", NAN, "nan"), ("a", 1.0, "x"), ("a", 2.0, "y"), (None, 1.0, "z"), ("b", None, "w")]
    rdf = spark.createDataFrame(regs, "uuid string, reg_time double, os string")
    ldf = spark.createDataFrame(rows, "reading_id long, uuid string, time double")
    out = prep.asof_registration(ldf, rdf, "uuid", "time", "reading_id", bucket_width=width).collect()
    got = {r["reading_id"]: r["registration"]["os"] if r["registration"] else None for r in out}
    assert got == {1: "x", 2: None, 3: "y", 4: None, 5: "y", 6: None, 7: None, 8: None, 9: None} and len(out) == 9
    from drainrules.schemas import ANDROID_FIELDS
    df = ldf.withColumn("battery_level", F.lit(1.0)).withColumn("distanceTraveled", F.lit(None).cast("double")).withColumn(
        "apps", F.lit(None).cast("array<string>")).withColumn("androidFields", F.lit(None).cast(ANDROID_FIELDS))
    pairs = {(r["prev"]["reading_id"], r["cur"]["reading_id"]) for r in prep.pair_readings(df, bucket_width=width).collect()}
    assert pairs == {(9, 1), (1, 3), (3, 5)}


def test_plan_has_one_wide_shuffle_and_no_sort_aggregate(spark):
    out = prep.asof_registration(fx.device_readings(spark, SF001).select("reading_id", "uuid", "time"), fx.registrations(spark, SF001),
                                 "uuid", "time", "reading_id", bucket_width=100.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
