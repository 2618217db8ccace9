"""Sources and sinks: round trips through parquet, CSV/TSV and JSON."""

import json
import os

import pytest
from pyspark.sql import functions as F

from drainrules.operators import apps as ap
from drainrules.schemas import SAMPLE_COLUMNS
from drainrules.session import scratch_path
from drainrules.sources import fixtures as fx
from drainrules.sources import io

from conftest import SF001


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def _rows(df):
    return sorted((tuple("nan" if isinstance(v, float) and v != v else v for v in r) for r in df.collect()), key=str)


def test_tsv_and_csv_roundtrip(spark):
    s = fx.device_samples(spark, SF001).select(*SAMPLE_COLUMNS)
    p = scratch_path(spark, "t-tsv")
    io.write_samples_tsv(s, p)
    header = [f for f in os.listdir(_local(p)) if f.endswith(".csv")]
    with open(os.path.join(_local(p), header[0])) as fh:
        assert fh.readline().rstrip("\n").split("\t") == SAMPLE_COLUMNS
    assert _rows(io.read_samples_csv(spark, p, sep="\t", header=True)) == _rows(s)
    p2 = scratch_path(spark, "t-csv")
    io.write_samples_csv(s, p2)
    assert _rows(io.read_samples_csv(spark, p2)) == _rows(s)


def test_csv_bad_number_fails(spark):
    p = scratch_path(spark, "t-bad")
    os.makedirs(_local(p))
    with open(os.path.join(_local(p), "x.csv"), "w") as fh:
        fh.write("0.1,x,1,1,1,1,1,wifi,1,1\n")
    import pytest
    with pytest.raises(Exception):
        io.read_samples_csv(spark, p).collect()


def test_app_counts_json_and_tsv(spark):
    rates = fx.sample_rates(spark, SF001)
    counts = ap.app_usage_counts(rates).repartition(3)
    p = scratch_path(spark, "t-json")
    io.write_app_counts_json(counts, p)
    assert _rows(io.read_app_counts_json(spark, p)) == _rows(counts.select("app", "n"))
    # one pretty-printed object per file is read too
    p1 = scratch_path(spark, "t-json1")
    os.makedirs(_local(p1))
    with open(os.path.join(_local(p1), "counts.json"), "w") as fh:
        json.dump({"a": 3, "b": 1001}, fh, indent=2)
    assert sorted(io.read_app_counts_json(spark, p1, whole_files=True).collect()) == [("a", 3), ("b", 1001)]
    p2 = scratch_path(spark, "t-tsv2")
    io.write_app_counts_tsv(counts, p2)
    assert _rows(io.read_app_counts_tsv(spark, p2)) == _rows(counts.select("app", "n"))


def test_parquet_rates_roundtrip_prunes_columns(spark):
    p = scratch_path(spark, "t-rates")
    io.write_parquet(fx.sample_rates(spark, SF001), p)
    back = io.read_rates(spark, p).select("rate", F.col("sp.cur.androidFields.cpuUsage").alias("cpu"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "cpuUsage" in plan and "screenBrightness" not in plan
    assert back.count() == fx.sample_rates(spark, SF001).count()


def test_recent_rates_layout_prunes_months(spark):
    from drainrules.operators import prepare as prep

    p = scratch_path(spark, "t-recent")
    io.write_recent_rates(prep.filter_recent(fx.sample_rates(spark, SF001), "1996-06-22"), p)
    back = io.read_recent_rates(spark, p).where(F.col("month") >= "1998-01")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    months = {r["month"] for r in back.select("month").distinct().collect()}
    assert months and all(m >= "1998-01" for m in months)


def test_text_has_no_quoting(spark):
    from drainrules import schemas
    rows = [(0.5, 0.1, 1.0, 20.0, 3.5, 10.0, '"lte', 'wi"fi"', -50.0, 10.0), (0.1, 0.2, 2.0, 21.0, 3.6, 11.0, "lte", "'x'", -51.0, 11.0)]
    df = spark.createDataFrame(rows, schemas.SAMPLE)
    for sep in (",", "\t", ";"):
        path = scratch_path(spark, "quotes")
        io.write_samples_csv(df, path, sep=sep)
        assert sorted(map(tuple, io.read_samples_csv(spark, path, sep=sep).collect())) == sorted(rows)
        bad = spark.createDataFrame([(*rows[0][:6], f"a{sep}b", *rows[0][7:])], schemas.SAMPLE)
        with pytest.raises(Exception, match="separator"):
            io.write_samples_csv(bad, scratch_path(spark, "quotes"), sep=sep)


def test_rates_by_app_prune_to_one_folder(spark):
    from conftest import SF001
    from drainrules.sources import fixtures as fx
    rates = fx.sample_rates(spark, SF001)
    path = scratch_path(spark, "by-app")
    io.write_rates_by_app(rates, path)
    got = io.read_rates_of_app(spark, path, "ECONOMY")
    want = rates.where(F.array_contains("all_apps", "ECONOMY"))
    assert got.columns == want.columns
    key = "sp.cur.reading_id"
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.select(key).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(app_bucket" in plan and "EqualTo(app,ECONOMY)" in plan


def _write_text(path, name, text):
    os.makedirs(_local(path), exist_ok=True)
    with open(os.path.join(_local(path), name), "w", newline="") as fh:
        fh.write(text)


def test_strict_text_reader(spark):
    p = scratch_path(spark, "strict")
    _write_text(p, "x.csv", " \t0.1,0.2,3,4,5,6, lte x ,,7, 8.5 ,ignored\r\n0.1,NaN,3,4,5,6,a,\"b,7,8\n")
    rows = sorted(map(tuple, io.read_samples_csv(spark, p).collect()), key=str)
    assert [r[6:8] for r in rows] == [(" lte x ", ""), ("a", '"b')] and rows[0][9] == 8.5
    for name, line in (("empty", "0.1,,3,4,5,6,a,b,7,8"), ("word", "0.1,x,3,4,5,6,a,b,7,8"), ("short", "0.1,0.2,3,4,5,6,a,b,7"), ("blank", "")):
        p = scratch_path(spark, f"strict-{name}")
        _write_text(p, "bad-file.csv", f"0.1,0.2,3,4,5,6,a,b,7,8\n{line}\n")
        with pytest.raises(Exception, match="bad value of .*bad-file.csv"):
            io.read_samples_csv(spark, p).collect()


def test_odd_text_values_roundtrip(spark):
    from drainrules import schemas
    texts = [" x ", "", "\\", "a\\b", '"', "'", "null", " ", "é 漢"]
    rows = [(0.5, 0.1, 1e-9, 1e300, 3.5, -1.0, a, b, -50.0, 10.0) for a in texts for b in texts]
    for sep, header in ((",", False), ("\t", True), ("|", True)):
        path = scratch_path(spark, "odd-text")
        df = spark.createDataFrame(rows, schemas.SAMPLE)
        (io.write_samples_tsv(df, path) if header and sep == "\t" else io._write_plain(df, path, sep, header))
        assert sorted(map(tuple, io.read_samples_csv(spark, path, sep=sep, header=header).collect())) == sorted(rows)
    none = spark.createDataFrame([(*rows[0][:6], None, None, *rows[0][8:])], schemas.SAMPLE)
    path = scratch_path(spark, "odd-text")
    io.write_samples_csv(none, path)
    assert tuple(io.read_samples_csv(spark, path).first()[6:8]) == ("null", "null")
    with pytest.raises(Exception, match="is null"):
        io.write_samples_csv(spark.createDataFrame([(None, *rows[0][1:])], schemas.SAMPLE), scratch_path(spark, "odd-text"))


def test_app_count_lines_are_plain(spark):
    rows = [('a"b', 1), (" e ", 2), ("", 3), ("\\", 4), ("x,y", 5)]
    path = scratch_path(spark, "plain-counts")
    io.write_app_counts_tsv(spark.createDataFrame(rows, "app string, n bigint").coalesce(1), path)
    with open(os.path.join(_local(path), [f for f in os.listdir(_local(path)) if f.endswith(".txt")][0]), newline="") as fh:
        assert sorted(fh.read().splitlines()) == sorted(f"{a}\t{n}" for a, n in rows)
    assert sorted(map(tuple, io.read_app_counts_tsv(spark, path).collect())) == sorted(rows)
    with pytest.raises(Exception, match="tab or a line end"):
        io.write_app_counts_tsv(spark.createDataFrame([("a\tb", 1)], "app string, n bigint"), scratch_path(spark, "plain-counts"))
    for bad in ("a\tx\n", "no tab\n", "5\n"):
        p = scratch_path(spark, "plain-bad")
        _write_text(p, "counts.txt", bad)
        with pytest.raises(Exception, match="bad line in"):
            io.read_app_counts_tsv(spark, p).collect()


def test_one_large_json_object_is_read_by_several_tasks(spark):
    odd = {'a, "b": 3': 1, ",": 2, "": 3, "x,y,z": 4, "\\": 5, '\\",': 6, "{": 7, "}": 8, "é\n": 9, '":1,': 10, ", ": 11}
    big = {f"com.app, of maker {i}": i for i in range(30_000)} | odd
    for indent in (None, 2):
        p = scratch_path(spark, "one-object")
        _write_text(p, "counts.json", json.dumps(big, indent=indent, ensure_ascii=bool(indent)))
        _write_text(p, "more.json", json.dumps(odd, indent=indent))
        _write_text(p, "none.json", " {} \n")
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
        try:
            df = io.read_app_counts_json(spark, p, whole_files=True)
            tasks = df.rdd.getNumPartitions()
            found = [tuple(r) for r in df.collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        assert tasks > 5 and sorted(found) == sorted([*big.items(), *odd.items()])
    p = scratch_path(spark, "bad-object")
    _write_text(p, "counts.json", '{"a": 1, "b": x}')
    with pytest.raises(Exception, match="no entry"):
        io.read_app_counts_json(spark, p, whole_files=True).collect()


def _rows_read(df):
    """Rows that the scan of a query read, from its metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    scans = plan.collectLeaves()
    return sum(scans.apply(i).metrics().get("numOutputRows").get().value() for i in range(scans.size()))


def test_search_of_stored_rates_reads_only_the_app(spark):
    from drainrules.plans import rule_search as rs
    rates = fx.sample_rates(spark, SF001)
    by_app, plain = scratch_path(spark, "stored-by-app"), scratch_path(spark, "stored-plain")
    io.write_rates_by_app(rates, by_app)
    io.write_parquet(rates, plain)
    pruned, full = (io.read_rates_for(spark, p, "ECONOMY").select("rate") for p in (by_app, plain))
    assert pruned.count() == full.count() > 0
    assert _rows_read(full) == rates.count() > 3 * _rows_read(pruned)
    found = [{(tuple(r["antecedent"]), r["confidence"]) for r in rs.mine_stored_rules(spark, p, "ECONOMY", 0.02, 0.3, exact=True).rules.collect()} for p in (by_app, plain)]
    assert found[0] == found[1] and found[0]


def test_tables_by_device_are_paired_without_exchange(spark):
    from drainrules.operators import prepare as prep
    from drainrules.plans import batch

    readings, regs = fx.device_readings(spark, SF001), fx.registrations(spark, SF001)
    path = scratch_path(spark, "readings-by-device")
    stored = batch.store_readings(readings, path, buckets=4)
    stored_regs = batch.store_registrations(regs, scratch_path(spark, "regs-by-device"), buckets=4)
    pairs = prep.pair_readings(prep.filter_android(stored))
    matched = prep.asof_registration(stored.select("reading_id", "uuid", "time"), stored_regs, "uuid", "time", "reading_id")
    for df in (pairs, matched):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan
    key = lambda df: sorted((r["uuid"], r["prev"]["reading_id"], r["cur"]["reading_id"]) for r in df.collect())
    assert key(pairs) == key(prep.pair_readings(prep.filter_android(readings)))
    again = io.open_by_device(spark, path, stored.schema, ["uuid", "time", "reading_id"], buckets=4)  # as another session would
    assert "Exchange" not in prep.pair_readings(again)._jdf.queryExecution().executedPlan().toString() and again.count() == readings.count()
    rates = batch.build_rates_by_device(stored, stored_regs, buckets=4)
    assert "Exchange" not in rates._jdf.queryExecution().executedPlan().toString()
    assert rates.count() == pairs.count()


def test_rules_document_is_written_in_parts(spark):
    from drainrules.operators import report
    rules = spark.range(5000).selectExpr("array(concat('cpu=', id), 'x=\"y') AS antecedent", "array('rate=q1') AS consequent", "(id % 100) / 100.0D AS confidence")
    for some, parts in ((rules, 2), (rules.limit(1), 1), (rules.limit(0), 1)):
        some = spark.createDataFrame(some.collect(), rules.schema)
        lines = report.rules_document(spark, 'a"]}', 0.1, 0.2, {"rate": [0.0, 1.0]}, some, 3, 4)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "rangepartitioning(place" in plan
        was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = scratch_path(spark, "rules-parts")
        try:
            io.write_rules_json(lines, path)
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        files = sorted(f for f in os.listdir(_local(path)) if f.startswith("part-"))
        assert len(files) >= parts
        doc = json.loads("".join(open(os.path.join(_local(path), f)).read() for f in files))
        assert doc["applicationName"] == 'a"]}' and doc["bins"] == {"rate": [0.0, 1.0]} and doc["executionTime"] == 4
        want = sorted(((r["antecedent"], r["confidence"]) for r in some.collect()), key=lambda r: (-r[1], ";".join(sorted(r[0]))))
        assert [(r["antecedents"], r["confidence"]) for r in doc["rules"]] == want
        back = io.read_rules_json(spark, path).orderBy("position").collect()
        assert [(r["rule"]["antecedents"], r["rule"]["confidence"]) for r in back] == want
        assert all(r["applicationName"] == 'a"]}' and r["minSupport"] == 0.1 for r in back)
