"""Miners, rules, pruning: FP-growth vs CUBE, brute-force pruning, properties."""

from collections import defaultdict
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drainrules.operators import mining
from drainrules.plans import rule_search as rs
from drainrules.sources import fixtures as fx

from conftest import SF001


def _brute_prune(rules):
    groups = defaultdict(list)
    for a, c, conf in rules:
        groups[(c, conf)].append(a)
    keep = set()
    for (c, conf), ants in groups.items():
        for a in ants:
            if not any(set(b) < set(a) for b in ants):
                keep.add((a, c, conf))
    return keep


def _rules_set(df):
    return {(tuple(sorted(r["antecedent"])), tuple(r["consequent"]), r["confidence"]) for r in df.collect()}


def test_flagship_sf0001_miners_agree_and_prune_is_exact(spark):
    rates = fx.sample_rates(spark, SF001)
    fp = rs.mine_rules(rates, "ECONOMY", 0.01, 0.3, exact=True)
    cube = rs.mine_rules(rates, "ECONOMY", 0.01, 0.3, exact=True, miner="cube")
    assert _rules_set(fp.rules) == _rules_set(cube.rules)
    rate_rules = _rules_set(fp.rate_rules)
    assert all(c[0].startswith("rate=") for _, c, _ in rate_rules)
    pruned = _rules_set(fp.pruned)
    assert pruned == _brute_prune(rate_rules)
    assert pruned <= rate_rules
    assert all(0.3 <= conf <= 1.0 for _, _, conf in pruned)


def test_empty_app_gives_no_rules(spark):
    rates = fx.sample_rates(spark, SF001)
    res = rs.mine_rules(rates, "NO-SUCH-APP", 0.01, 0.3, exact=True)
    assert res.bins["rate"] == [0.0, 0.0]
    assert res.pruned.count() == 0


def test_missing_app_name_is_rejected(spark):
    import pytest

    with pytest.raises(ValueError):
        rs.validate("", None, None)
    assert rs.validate("x", None, None) == (0.01, 0.5)


def test_empty_transactions_count_in_support(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (["a"],)], "items array<string>")
    its, _ = mining.fpgrowth(df, 0.5, 0.5)
    got = {(tuple(sorted(r["items"])), r["freq"]) for r in its.collect()}
    assert got == {(("a",), 2)}


FEATURES = ["rate", "cpu", "distance"]
item_values = st.sampled_from(["x", "y", None])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(item_values, item_values, item_values), min_size=1, max_size=30))
def test_cube_equals_fpgrowth_and_brute_counts(spark, rows):
    cols = ["rate", "cpu", "distance", "temperature", "voltage", "screen", "mobileNetType", "netType",
            "wifiStrength", "wifiSpeed"]
    data = [tuple([f"rate={r}" if r else None, f"cpu={c}" if c else None, f"distance={d}" if d else None]
                  + [None] * 7) for r, c, d in rows]
    items = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    a, _ = mining.mine(items, 0.2, 0.1, miner="fpgrowth", num_partitions=2)
    b, _ = mining.mine(items, 0.2, 0.1, miner="cube")
    c, _ = mining.mine(items, 0.2, 0.1, miner="packed")
    assert sorted((tuple(sorted(r["items"])), r["freq"]) for r in c.collect()) == sorted(
        (tuple(sorted(r["items"])), r["freq"]) for r in b.collect())
    sa = {(tuple(sorted(r["items"])), r["freq"]) for r in a.collect()}
    sb = {(tuple(sorted(r["items"])), r["freq"]) for r in b.collect()}
    assert sa == sb
    # brute-force support of every subset
    txs = [set(x for x in t[:3] if x) for t in data]
    universe = sorted(set().union(*txs)) if txs else []
    import math
    min_count = math.ceil(0.2 * len(txs))
    brute = set()
    for k in range(1, len(universe) + 1):
        for combo in combinations(universe, k):
            n = sum(1 for t in txs if set(combo) <= t)
            if n >= min_count and n > 0:
                brute.add((tuple(sorted(combo)), n))
    assert sa == brute


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.frozensets(st.sampled_from("abcde"), min_size=1, max_size=4),
                          st.sampled_from(["rate=q1", "rate=q2"]), st.sampled_from([0.5, 0.75])),
                min_size=1, max_size=25, unique_by=lambda t: (t[0], t[1])))
def test_prune_matches_brute_force(spark, rules):
    rows = [(sorted(a), [c], conf) for a, c, conf in rules]
    df = spark.createDataFrame(rows, "antecedent array<string>, consequent array<string>, confidence double")
    got = _rules_set(mining.prune_rules(df))
    want = {(a, (c,), conf) for a, c, conf in _brute_prune([(tuple(sorted(a)), c, conf) for a, c, conf in rules])}
    assert got == want
    # no survivor is dominated by another survivor of its group
    for a, c, conf in got:
        assert not any(set(b) < set(a) for b, c2, conf2 in got if (c2, conf2) == (c, conf))


def test_order_by_confidence_desc(spark):
    rows = [(["a"], ["rate=q1"], 0.5), (["b"], ["rate=q1"], 0.9), (["a", "b"], ["rate=q2"], 0.9)]
    df = spark.createDataFrame(rows, "antecedent array<string>, consequent array<string>, confidence double")
    out = [(r["antecedent"], r["confidence"]) for r in mining.order_rules(df).collect()]
    assert out == [(["a", "b"], 0.9), (["b"], 0.9), (["a"], 0.5)]


def test_rules_document_envelope(spark):
    import json

    rates = fx.sample_rates(spark, SF001)
    res = rs.mine_rules(rates, "ECONOMY", 0.01, 0.3, exact=True)
    doc = json.loads("\n".join(r["line"] for r in res.document(execution_ms=5).collect()))
    assert list(doc) == ["applicationName", "minSupport", "minConfidence", "FPGrowthRunTime", "executionTime",
                         "bins", "rules"]
    assert doc["applicationName"] == "ECONOMY" and doc["executionTime"] == 5 and doc["FPGrowthRunTime"] > 0
    assert set(doc["bins"]) == {"rate", "cpu", "temperature", "voltage", "screen", "wifiStrength", "wifiSpeed"}
    confs = [r["confidence"] for r in doc["rules"]]
    assert confs == sorted(confs, reverse=True) and len(confs) == res.pruned.count()
    assert set(doc["rules"][0]) == {"antecedents", "consequents", "confidence"}


def test_transaction_shape_and_support_monotone(spark):
    from drainrules.operators import features as feat
    from drainrules.operators import prepare as prep

    rates = fx.sample_rates(spark, SF001)
    samples = prep.flatten_rates(prep.filter_app(rates, "ECONOMY"))
    bins = feat.compute_bins(samples, exact=True)
    txs = [r["items"] for r in feat.transactions(samples, bins).collect()]
    for t in txs:
        names = [i.split("=", 1)[0] for i in t]
        assert len(t) <= 10 and len(set(names)) == len(names)
        assert names[0] == "rate"  # every transaction carries a rate item
    res = rs.mine_samples(samples, "ECONOMY", 0.01, 0.3, exact=True)
    freq = {tuple(sorted(r["items"])): r["freq"] for r in res.itemsets.collect()}
    for items, f in freq.items():
        for k in range(1, len(items)):
            for sub in combinations(items, k):
                assert freq[tuple(sorted(sub))] >= f   # every subset is frequent and at least as supported
    # support counted against the brute-force transactions
    sample = sorted(freq.items(), key=lambda kv: -len(kv[0]))[:20]
    for items, f in sample:
        assert f == sum(1 for t in txs if set(items) <= set(t))


def test_excluded_features_leave_transactions(spark):
    rates = fx.sample_rates(spark, SF001)
    res = rs.mine_rules(rates, "ECONOMY", 0.01, 0.3, "cpu,temp", exact=True)
    items = {i for r in res.itemsets.collect() for i in r["items"]}
    assert not any(i.startswith(("cpu=", "temperature=")) for i in items)
    assert "cpu" not in res.bins and "temperature" not in res.bins


def test_codes_stand_for_the_items_of_the_item_table(spark):
    from drainrules.functions import discretize as dz
    from drainrules.operators import features as feat
    from drainrules.operators import prepare as prep

    samples = prep.flatten_rates(prep.filter_app(fx.sample_rates(spark, SF001), "ECONOMY"))
    odd = samples.limit(3).selectExpr("rate", "CAST('NaN' AS double) AS cpu", "CAST(null AS double) AS distance", "-1.0D AS temp", "CAST('NaN' AS double) AS voltage",
                                      "-1.0D AS screen", "CAST(null AS string) AS mobileNetwork", "'null' AS network", "-100.0D AS wifiStrength", "wifiSpeed")
    for excluded in (frozenset(), frozenset({"voltage", "netType"})):
        stored = feat.store_samples(samples.unionByName(odd), excluded)
        bins = feat.compute_bins(stored.samples, excluded, ends=stored.ends)
        coded = feat.coded_items(stored, bins, excluded, 1)
        names = F.create_map(*[x for f, items in coded.names.items() for i, item in enumerate(items, 1) for x in (F.lit(f"{f} {i}"), F.lit(item))])
        back = coded.codes.select(*[names[F.concat(F.lit(f"{f} "), F.col(f))].alias(f) for f in dz.ITEM_ORDER])
        count = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
        assert count(back) == count(feat.item_table(stored.samples, bins, excluded))


def test_many_text_items_and_infrequent_ones(spark):
    rows = [("rate=q1", f"netType=n{i % 100}", f"mobileNetType=m{i}" if i % 2 else None) for i in range(400)]
    cols = {"rate": 0, "netType": 1, "mobileNetType": 2}
    from drainrules.functions import discretize as dz

    data = [tuple(r[cols[f]] if f in cols else None for f in dz.ITEM_ORDER) for r in rows]
    items = spark.createDataFrame(data, ", ".join(f"{c} string" for c in dz.ITEM_ORDER))
    packed, _ = mining.mine(items, 0.01, 0.1)
    found = {tuple(sorted(r["items"])): r["freq"] for r in packed.collect()}
    assert found[("rate=q1",)] == 400 and found[("netType=n7", "rate=q1")] == 4 and len(found) == 1 + 100 + 100
    import pytest

    wide = mining.CodedItems(items.selectExpr(*[f"0 AS {f}" for f in dz.ITEM_ORDER]), {f: ["x"] * 100 for f in dz.ITEM_ORDER})
    with pytest.raises(ValueError):
        mining.packed_itemsets(wide, 0.01, 1)


def test_itemsets_of_all_sizes(spark):
    """All ten features always together: sizes beyond those of the first aggregate."""
    from drainrules.functions import discretize as dz

    data = [tuple(f"{f}=a" for f in dz.ITEM_ORDER)] * 8 + [tuple(f"{f}=b" if f == "cpu" else None for f in dz.ITEM_ORDER)] * 2
    packed, _ = mining.mine(spark.createDataFrame(data, ", ".join(f"{c} string" for c in dz.ITEM_ORDER)), 0.5, 0.99)
    assert packed.count() == 1023 and packed.where("freq <> 8").count() == 0
