"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total sec), "unit", "queries", "sf"}.
Each query is fully executed with a ``noop`` write (no collect); the rule
search is timed end to end (bins, mining, rules, pruning, order).  One untimed
rule search for another app warms the JVM first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drainrules.operators import mining  # noqa: E402
from drainrules.plans import catalog  # noqa: E402
from drainrules.plans import rule_search as rs  # noqa: E402
from drainrules.session import local_session, scratch_path  # noqa: E402
from drainrules.sources import fixtures as fx  # noqa: E402
from drainrules.sources import io  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def prepare_rates(spark, sf_dir, parts: int) -> str:
    """Untimed setup, like the preparation jobs of the service: rate records
    stored as parquet (several files, as a distributed job writes them)."""
    path = scratch_path(spark, "bench-rates")
    io.write_parquet(fx.sample_rates(spark, sf_dir).repartition(parts), path)
    return path


STAGES: dict = {}
WARMUP_APP = "STANDARD"


def rule_search(spark, rates_path, exact: bool):
    rates = io.read_rates(spark, rates_path)
    t0 = time.perf_counter()
    res = rs.mine_rules(rates, catalog.APP, catalog.MIN_SUPPORT, catalog.MIN_CONFIDENCE, exact=exact)
    tag = "exact" if exact else "approx"
    STAGES[f"{tag}_bins_and_mining"] = round(time.perf_counter() - t0, 3)
    STAGES[f"{tag}_fp_growth_and_rules"] = round(res.fp_growth_ms / 1000.0, 3)
    return mining.rule_rows(res.ordered)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="drainrules-bench")
    rates_path = prepare_rates(spark, sf_dir, int(cpus) * 2 if cpus.isdigit() else 16)
    headline = {
        "rule_search": lambda s, d: rule_search(s, rates_path, exact=False),
        "rule_search_exact": lambda s, d: rule_search(s, rates_path, exact=True),
        "rule_search_from_tables": lambda s, d: mining.rule_rows(rs.mine_rules(
            fx.sample_rates(s, d), catalog.APP, catalog.MIN_SUPPORT, catalog.MIN_CONFIDENCE).ordered),
        "pair_samples": catalog.q_pair_samples,
        "pairs_to_rates": catalog.q_pairs_to_rates,
        "asof_registration": catalog.q_asof_registration,
        "app_usage_counts": catalog.q_app_usage_counts,
        "top_apps": catalog.q_top_apps,
        "transactions": catalog.q_transactions,
        "feature_min_max": catalog.q_feature_min_max,
        "filter_recent_rates": catalog.q_filter_recent_rates,
        "tsv_roundtrip": catalog.q_tsv_roundtrip,
    }
    # warm-up, not timed: JVM start and JIT of the hot paths, with a rule search
    # for a different app (nothing of it is reused)
    _run(fx.device_samples(spark, sf_dir).limit(1))
    _run(mining.rule_rows(rs.mine_rules(io.read_rates(spark, rates_path), WARMUP_APP,
                                        catalog.MIN_SUPPORT, catalog.MIN_CONFIDENCE).ordered))
    times = {}
    for name, fn in headline.items():
        t0 = time.perf_counter()
        _run(fn(spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "stages": STAGES,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
