"""Registered queries: one per operator of the inventory, over whole tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame with flat,
explicitly named columns (the DuckDB oracle in ``plans.oracle`` produces the
same names).  Sink operators are checked as round trips: write with the
sink, read back with the source, compare.  Round-trip files go to the
session's shared checkpoint folder.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainrules.functions import discretize as dz
from drainrules.operators import apps as ap
from drainrules.operators import features as feat
from drainrules.operators import mining
from drainrules.operators import prepare as prep
from drainrules.operators import report
from drainrules.plans import batch
from drainrules.plans import rule_search as rs
from drainrules.session import scratch_path
from drainrules.sources import fixtures as fx
from drainrules.sources import io

# --- fixed parameters of the registered queries --------------------------------
APP = "ECONOMY"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.3
SINCE = "1996-06-22"
EXCLUDED = "cpu,temp,mobileNetType"
BUCKET_WIDTH = 100.0      # fixture clock: one unit = 1000 s, so ~1 day (scan_pairs; the others take the default)
READINGS_APP = "click"
READINGS_SUPPORT = 0.02
SHOWN_TAB = 3             # the last rate tab is the one shown first


def _apps_str(col) -> F.Column:
    return F.array_join(F.array_sort(F.array_distinct(col)), ",")


def _mined(spark: SparkSession, sf_dir: str) -> rs.RuleResult:
    return rs.mine_rules(fx.sample_rates(spark, sf_dir), APP, MIN_SUPPORT, MIN_CONFIDENCE, exact=True)


def _bins(spark: SparkSession, sf_dir: str, excluded: frozenset = frozenset()) -> dict:
    """Exact bins of the app."""
    stored = feat.store_samples(prep.flatten_rates(prep.filter_app(fx.sample_rates(spark, sf_dir), APP)), excluded)
    return feat.compute_bins(stored.samples, excluded, exact=True, ends=stored.ends)


def _app_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.flatten_rates(prep.filter_app(fx.sample_rates(spark, sf_dir), APP), keep_id=True)


def _android_pairs(spark: SparkSession, sf_dir: str, width: float | str = prep.DEFAULT_BUCKET_WIDTH) -> DataFrame:
    readings = prep.filter_android(fx.device_readings(spark, sf_dir))
    return prep.pair_readings(readings, bucket_width=width)


def _event_rates(spark: SparkSession, sf_dir: str, with_regs: bool) -> DataFrame:
    regs = fx.registrations(spark, sf_dir) if with_regs else None
    return batch.build_rates(fx.device_readings(spark, sf_dir), regs)


def _rates_flat(rates: DataFrame) -> DataFrame:
    """Flat sample of each rate with its id, apps and time (one projection)."""
    return prep.flatten_rates(rates, keep_id=True, extra=[_apps_str(F.col("all_apps")).alias("apps"),
                                                          F.col("sp.cur.time").alias("time")])


# ----------------------------------------------------------------- sources / sinks
def q_scan_rates(spark, sf_dir):
    path = scratch_path(spark, "rates")
    io.write_parquet(fx.sample_rates(spark, sf_dir), path)
    back = io.read_rates(spark, path)
    return _rates_flat(back)


def q_scan_readings(spark, sf_dir):
    path = scratch_path(spark, "readings")
    io.write_parquet(fx.device_readings(spark, sf_dir), path)
    r = io.read_readings(spark, path)
    a = "androidFields"
    return r.select(
        "reading_id", "uuid", "time", "battery_level", _apps_str(F.col("apps")).alias("apps"),
        F.col(f"{a}.cpuUsage").alias("cpu"), F.col("distanceTraveled").alias("distance"),
        F.col(f"{a}.battery.temperature").alias("temp"), F.col(f"{a}.battery.voltage").alias("voltage"),
        F.col(f"{a}.screenBrightness").alias("screen"), F.col(f"{a}.networkInfo.mobileNetworkType").alias("mobileNetwork"),
        F.col(f"{a}.networkInfo.networkType").alias("network"),
        F.col(f"{a}.networkInfo.wifiSignalStrength").cast("double").alias("wifiStrength"),
        F.col(f"{a}.networkInfo.wifiLinkSpeed").cast("double").alias("wifiSpeed"))


def _pair_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select("uuid", F.col("prev.reading_id").alias("prev_id"), F.col("cur.reading_id").alias("cur_id"),
                        F.col("prev.time").alias("prev_time"), F.col("cur.time").alias("cur_time"),
                        F.col("prev.battery_level").alias("prev_level"), F.col("cur.battery_level").alias("cur_level"))


def q_scan_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    io.write_parquet(_android_pairs(spark, sf_dir, BUCKET_WIDTH), path)
    return _pair_rows(io.read_pairs(spark, path))


def q_scan_registrations(spark, sf_dir):
    path = scratch_path(spark, "registrations")
    io.write_parquet(fx.registrations(spark, sf_dir), path)
    return io.read_registrations(spark, path).select("uuid", "reg_time", "os")


def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "samples-csv")
    io.write_samples_csv(fx.device_samples(spark, sf_dir), path)
    return io.read_samples_csv(spark, path)


def q_tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "samples-tsv")
    io.write_samples_tsv(fx.device_samples(spark, sf_dir), path)
    return io.read_samples_csv(spark, path, sep="\t", header=True)


def q_csv_odd_roundtrip(spark, sf_dir):
    """Padded, empty, quoted and null text values through the comma form."""
    s = fx.device_samples(spark, sf_dir)
    kind = F.col("line_no") % 4
    odd = s.withColumn("mobileNetwork", F.when(kind == 0, F.concat(F.lit(" "), "mobileNetwork", F.lit(" "))).when(kind == 1, F.lit(""))
                       .when(kind == 2, F.concat(F.lit('"'), "mobileNetwork")).otherwise(F.lit(None)))
    path = scratch_path(spark, "samples-odd-csv")
    io.write_samples_csv(odd, path)
    return io.read_samples_csv(spark, path)


def _app_counts(spark, sf_dir):
    return ap.app_usage_counts(_event_rates(spark, sf_dir, with_regs=False))


def q_app_counts_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "app-counts-json")
    io.write_app_counts_json(_app_counts(spark, sf_dir), path)
    return io.read_app_counts_json(spark, path).select("app", "n")


def q_app_counts_tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "app-counts-tsv")
    io.write_app_counts_tsv(_app_counts(spark, sf_dir), path)
    return io.read_app_counts_tsv(spark, path).select("app", "n")


def q_app_counts_odd_names_roundtrip(spark, sf_dir):
    """Quoted, padded and empty names as plain lines, then as one JSON object that several tasks read."""
    kind = F.col("n") % 3
    odd = _app_counts(spark, sf_dir).withColumn("app", F.when(kind == 0, F.concat(F.lit(' "'), "app", F.lit('\\ '))).when(kind == 1, F.concat("app", F.lit(', "x":1,'))).otherwise(F.col("app")))
    path = scratch_path(spark, "app-counts-odd-tsv")
    io.write_app_counts_tsv(odd, path)
    plain = io.read_app_counts_tsv(spark, path)
    path = scratch_path(spark, "app-counts-odd-json")
    io.write_app_counts_json(plain.coalesce(1), path)
    return io.read_app_counts_json(spark, path, whole_files=True).select("app", "n")


def q_rules_json(spark, sf_dir):
    path = scratch_path(spark, "rules-json")
    io.write_rules_json(_mined(spark, sf_dir).document(), path)
    back = io.read_rules_json(spark, path)
    return back.select(
        "applicationName", "minSupport", "minConfidence",
        mining.itemset_key(F.col("rule.antecedents")).alias("antecedent"),
        mining.itemset_key(F.col("rule.consequents")).alias("consequent"),
        F.col("rule.confidence").alias("confidence"))


# ----------------------------------------------------------------- projections / filters
def q_flatten_rate(spark, sf_dir):
    rates = fx.sample_rates(spark, sf_dir)
    return _rates_flat(rates)


def q_filter_app(spark, sf_dir):
    rates = prep.filter_app(fx.sample_rates(spark, sf_dir), APP)
    return rates.select(F.col("sp.cur.reading_id").alias("reading_id"), "rate", _apps_str(F.col("all_apps")).alias("apps"))


def q_filter_app_stored(spark, sf_dir):
    path = scratch_path(spark, "rates-by-app")
    io.write_rates_by_app(fx.sample_rates(spark, sf_dir), path)
    rates = io.read_rates_of_app(spark, path, APP)
    return rates.select(F.col("sp.cur.reading_id").alias("reading_id"), "rate", _apps_str(F.col("all_apps")).alias("apps"))


def q_filter_android(spark, sf_dir):
    return prep.filter_android(fx.device_readings(spark, sf_dir)).select("reading_id", "uuid")


def q_filter_recent_rates(spark, sf_dir):
    rates = prep.filter_recent(fx.sample_rates(spark, sf_dir), SINCE)
    path = scratch_path(spark, "recent-rates")
    io.write_recent_rates(rates, path)
    back = io.read_recent_rates(spark, path)
    return back.select(F.col("sp.cur.reading_id").alias("reading_id"), "rate", F.col("sp.cur.time").alias("time"))


def _bins_long(spark, bins):
    return feat.bins_table(spark, bins).select("feature", F.col("idx").cast("int").alias("idx"), "bound")


def q_feature_bins(spark, sf_dir):
    return _bins_long(spark, _bins(spark, sf_dir))


def q_feature_bins_approx(spark, sf_dir):
    """Whether the rank of each default (approximate) bound lies within the stated error of the wanted one."""
    samples = prep.flatten_rates(prep.filter_app(fx.sample_rates(spark, sf_dir), APP))
    return feat.rank_errors(samples, feat.compute_bins(samples, exact=False))


def q_feature_min_max(spark, sf_dir):
    """Min, max and count of in-domain values per feature: one aggregate, then unpivot."""
    samples = prep.flatten_rates(prep.filter_app(fx.sample_rates(spark, sf_dir), APP))
    specs = feat.binned_specs(frozenset())
    aggs = []
    for i, s in enumerate(specs):
        v = F.when(s.in_domain(F.col(s.column)), F.col(s.column))
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.count(v).alias(f"n{i}")]
    stack = ", ".join(f"'{s.bin_name}', mn{i}, mx{i}, n{i}" for i, s in enumerate(specs))
    return samples.agg(*aggs).selectExpr(f"stack({len(specs)}, {stack}) AS (feature, min_value, max_value, n_values)")


def _items_with_id(spark, sf_dir, excluded=frozenset()):
    stored = feat.store_samples(_app_samples(spark, sf_dir), excluded)
    bins = feat.compute_bins(stored.samples, excluded, exact=True, ends=stored.ends)
    return feat.item_table(stored.samples, bins, excluded, keep=("reading_id",))


def _tx_rows(items: DataFrame) -> DataFrame:
    arr = F.array_compact(F.array(*dz.ITEM_ORDER))
    return items.select("reading_id", F.array_join(arr, ";").alias("items"), F.size(arr).cast("int").alias("n_items"))


def q_transactions(spark, sf_dir):
    return _tx_rows(_items_with_id(spark, sf_dir))


def q_transactions_excluded(spark, sf_dir):
    return _tx_rows(_items_with_id(spark, sf_dir, dz.parse_excluded(EXCLUDED)))


def _disc(item):
    def q(spark, sf_dir):
        return _items_with_id(spark, sf_dir).select("reading_id", F.col(item).alias("item"))
    q.__name__ = f"q_disc_{item}"
    return q


# ----------------------------------------------------------------- preparation
def q_pair_samples(spark, sf_dir):
    return _pair_rows(_android_pairs(spark, sf_dir))


def q_pairs_to_rates(spark, sf_dir):
    return _rate_rows(_event_rates(spark, sf_dir, with_regs=True))


def _stored_by_device(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return (batch.store_readings(fx.device_readings(spark, sf_dir), scratch_path(spark, "readings-by-device")),
            batch.store_registrations(fx.registrations(spark, sf_dir), scratch_path(spark, "registrations-by-device")))


def q_pair_samples_stored(spark, sf_dir):
    readings, _ = _stored_by_device(spark, sf_dir)
    return _pair_rows(prep.pair_readings(prep.filter_android(readings)))


def q_pairs_to_rates_stored(spark, sf_dir):
    r = batch.build_rates_by_device(*_stored_by_device(spark, sf_dir))
    return _rate_rows(r)


def _rate_rows(r: DataFrame) -> DataFrame:
    return r.select(F.col("sp.cur.uuid").alias("uuid"), F.col("sp.cur.reading_id").alias("cur_id"), "rate",
                    _apps_str(F.col("all_apps")).alias("apps"),
                    F.col("registration.reg_time").alias("reg_time"), F.col("registration.os").alias("os"))


def q_asof_registration(spark, sf_dir):
    rows = fx.device_readings(spark, sf_dir, F.col("event_type") != "signup").select("reading_id", "uuid", "time")
    out = prep.asof_registration(rows, fx.registrations(spark, sf_dir), "uuid", "time", "reading_id")
    return out.select(F.col("reading_id").alias("event_id"), "uuid", "time",
                      F.col("registration.reg_time").alias("reg_time"), F.col("registration.os").alias("os"))


# ----------------------------------------------------------------- mining / rules
def _rules_out(df):
    return mining.rule_rows(df)


def q_frequent_itemsets(spark, sf_dir):
    m = _mined(spark, sf_dir)
    return m.itemsets.select(mining.itemset_key(F.col("items")).alias("items"), "freq",
                             F.size("items").cast("int").alias("n_items"))


def q_association_rules(spark, sf_dir):
    return _rules_out(_mined(spark, sf_dir).rules)


def q_rate_rules(spark, sf_dir):
    return _rules_out(_mined(spark, sf_dir).rate_rules)


def q_pruned_rules(spark, sf_dir):
    return _rules_out(_mined(spark, sf_dir).pruned)


def q_sorted_rules(spark, sf_dir):
    rows = _rules_out(_mined(spark, sf_dir).ordered)
    return ap.with_global_rank(rows, [F.desc("confidence"), F.asc("antecedent"), F.asc("consequent")])


def q_rule_groups(spark, sf_dir):
    return report.rule_groups(_mined(spark, sf_dir).rate_rules)


def q_rule_counts(spark, sf_dir):
    return report.rule_counts(_mined(spark, sf_dir).pruned)


def q_rules_by_rate_bin(spark, sf_dir):
    return _rules_out(report.rules_by_rate_bin(_mined(spark, sf_dir).pruned, SHOWN_TAB))


def q_rule_labels(spark, sf_dir):
    m = _mined(spark, sf_dir)
    items = m.pruned.select(F.explode(F.concat("antecedent", "consequent")).alias("item")).distinct()
    return report.item_labels(items, feat.bins_table(spark, m.bins)).select("item", "label")


def q_rate_bin_labels(spark, sf_dir):
    return report.rate_bin_labels(feat.bins_table(spark, _mined(spark, sf_dir).bins))


def q_stored_rules(spark, sf_dir):
    """Pruned rules from rates stored by app: the search reads the app's row groups."""
    path = scratch_path(spark, "rates-by-app")
    io.write_rates_by_app(fx.sample_rates(spark, sf_dir), path)
    return _rules_out(rs.mine_stored_rules(spark, path, APP, MIN_SUPPORT, MIN_CONFIDENCE, exact=True).pruned)


def q_search_from_readings(spark, sf_dir):
    """The whole chain: readings, pairs, rates with registrations, rules of one app."""
    rates = _event_rates(spark, sf_dir, with_regs=True)
    return _rules_out(rs.mine_rules(rates, READINGS_APP, READINGS_SUPPORT, MIN_CONFIDENCE, exact=True).pruned)


# ----------------------------------------------------------------- app statistics
def q_app_usage_counts(spark, sf_dir):
    return _app_counts(spark, sf_dir).select("app", "n")


def q_popular_apps(spark, sf_dir):
    return ap.popular_apps(_app_counts(spark, sf_dir)).select("app", "n")


def q_top_apps(spark, sf_dir):
    return ap.top_apps(ap.popular_apps(_app_counts(spark, sf_dir))).select("app", "n", "rank")


def q_app_counts_by_name(spark, sf_dir):
    return ap.with_global_rank(ap.by_name_desc(_app_counts(spark, sf_dir)), [F.desc("app")]).select("app", "n", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned rate rules of the app, ordered by confidence."""
    return mining.rule_rows(_mined(spark, sf_dir).ordered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_rates": q_scan_rates,
    "scan_readings": q_scan_readings,
    "scan_pairs": q_scan_pairs,
    "scan_registrations": q_scan_registrations,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_odd_roundtrip": q_csv_odd_roundtrip,
    "tsv_roundtrip": q_tsv_roundtrip,
    "app_counts_json_roundtrip": q_app_counts_json_roundtrip,
    "app_counts_tsv_roundtrip": q_app_counts_tsv_roundtrip,
    "app_counts_odd_names_roundtrip": q_app_counts_odd_names_roundtrip,
    "rules_json": q_rules_json,
    "flatten_rate": q_flatten_rate,
    "feature_bins": q_feature_bins,
    "feature_bins_approx": q_feature_bins_approx,
    "feature_min_max": q_feature_min_max,
    "transactions": q_transactions,
    "transactions_excluded": q_transactions_excluded,
    "filter_app": q_filter_app,
    "filter_app_stored": q_filter_app_stored,
    "filter_android": q_filter_android,
    "filter_recent_rates": q_filter_recent_rates,
    "pair_samples": q_pair_samples,
    "pair_samples_stored": q_pair_samples_stored,
    "pairs_to_rates": q_pairs_to_rates,
    "pairs_to_rates_stored": q_pairs_to_rates_stored,
    "asof_registration": q_asof_registration,
    "search_from_readings": q_search_from_readings,
    "frequent_itemsets": q_frequent_itemsets,
    "association_rules": q_association_rules,
    "rate_rules": q_rate_rules,
    "pruned_rules": q_pruned_rules,
    "stored_rules": q_stored_rules,
    "sorted_rules": q_sorted_rules,
    "rule_groups": q_rule_groups,
    "rule_counts": q_rule_counts,
    "rules_by_rate_bin": q_rules_by_rate_bin,
    "rule_labels": q_rule_labels,
    "rate_bin_labels": q_rate_bin_labels,
    "app_usage_counts": q_app_usage_counts,
    "popular_apps": q_popular_apps,
    "top_apps": q_top_apps,
    "app_counts_by_name": q_app_counts_by_name,
    "disc_rate": _disc("rate"),
    "disc_cpu": _disc("cpu"),
    "disc_distance": _disc("distance"),
    "disc_temperature": _disc("temperature"),
    "disc_voltage": _disc("voltage"),
    "disc_screen": _disc("screen"),
    "disc_mobile_network": _disc("mobileNetType"),
    "disc_network": _disc("netType"),
    "disc_wifi_strength": _disc("wifiStrength"),
    "disc_wifi_speed": _disc("wifiSpeed"),
}
