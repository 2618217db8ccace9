"""Reporting of mined rules: envelope JSON, rate-bin tabs, readable items.

The bins table has at most 7 features x 6 bounds, so it is broadcast with
a proven size bound.  The JSON document of all rules is written in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drainrules.functions.format import is_fractional, js_number, to_precision2
from drainrules.operators import mining


# --- fixed values: forms of bucketed items, by which they are shown ------------
RATE_ITEM = r"rate=q(\d)"
BUCKET_ITEM = r"([^=]*)=q(\d)"


def rate_bin_of(consequent_col) -> F.Column:
    """1-based rate bin of a rule from its ``rate=q<d>`` consequent (null if none)."""
    rate_item = F.element_at(F.filter(consequent_col, lambda x: x.startswith("rate")), 1)
    digit = F.regexp_extract(rate_item, RATE_ITEM, 1)
    return F.when(digit != "", digit.cast("int"))


def rules_by_rate_bin(rules: DataFrame, bin_index: int) -> DataFrame:
    """Rules of one rate tab (0-based tab index, tab i shows ``rate=q{i+1}``)."""
    return rules.where(rate_bin_of(F.col("consequent")) == F.lit(int(bin_index) + 1))


def rule_counts(rules: DataFrame) -> DataFrame:
    """``(rate_bin, n_rules)`` per rate tab plus ``rate_bin = 0`` for all rules."""
    per_bin = rules.groupBy(F.coalesce(rate_bin_of(F.col("consequent")), F.lit(-1)).alias("rate_bin")).agg(
        F.count(F.lit(1)).alias("n_rules"))
    total = rules.agg(F.lit(0).alias("rate_bin"), F.count(F.lit(1)).alias("n_rules"))
    return per_bin.unionByName(total)


def rule_groups(rules: DataFrame) -> DataFrame:
    """Size of each ``(consequent, confidence)`` group that pruning works on."""
    return rules.groupBy(mining.itemset_key(F.col("consequent")).alias("consequent"), "confidence").agg(
        F.count(F.lit(1)).alias("n_rules"))


def item_labels(items: DataFrame, bins: DataFrame) -> DataFrame:
    """Readable text per item: ``cpu=q3`` -> ``cpu is 0.50 - 0.75``.

    ``items`` has a column ``item``; ``bins`` is the long bins table
    ``(feature, idx, bound)``.  Items without ``=q<d>`` or without bins are
    printed as they are.  Bounds print as JavaScript numbers, or both with
    two significant digits when either is fractional.
    """
    feature = F.regexp_extract("item", BUCKET_ITEM, 1)
    qidx = F.regexp_extract("item", BUCKET_ITEM, 2)
    parsed = items.select("*", F.when(qidx != "", feature).alias("__f"), F.when(qidx != "", qidx.cast("int")).alias("__q"))
    lo = F.broadcast(bins.select(F.col("feature").alias("__f"), (F.col("idx") + 1).alias("__q"), F.col("bound").alias("__lo")))
    hi = F.broadcast(bins.select(F.col("feature").alias("__f"), F.col("idx").alias("__q"), F.col("bound").alias("__hi")))
    has = F.broadcast(bins.select(F.col("feature").alias("__f")).distinct().withColumn("__has", F.lit(True)))
    j = parsed.join(has, "__f", "left").join(lo, ["__f", "__q"], "left").join(hi, ["__f", "__q"], "left")
    frac = is_fractional(F.col("__lo")) | is_fractional(F.col("__hi"))
    lo_txt = F.when(frac, to_precision2(F.col("__lo"))).otherwise(js_number(F.col("__lo")))
    hi_txt = F.when(frac, to_precision2(F.col("__hi"))).otherwise(js_number(F.col("__hi")))
    missing_lo = F.when(F.col("__lo").isNull(), F.lit("NaN")).otherwise(lo_txt)
    missing_hi = F.when(F.col("__hi").isNull(), F.lit("NaN")).otherwise(hi_txt)
    label = F.when(F.col("__has").isNull(), F.col("item")).otherwise(
        F.concat(F.col("__f"), F.lit(" is "), missing_lo, F.lit(" - "), missing_hi))
    return j.select(*[c for c in items.columns], label.alias("label"))


def rate_bin_labels(bins: DataFrame) -> DataFrame:
    """One tab per rate interval: ``(tab, label)``; the last tab is shown first."""
    rate = bins.where(F.col("feature") == "rate").select("idx", "bound")
    w = Window.orderBy("idx")  # at most 6 rows
    pairs = rate.select(F.col("idx").alias("tab"), F.col("bound").alias("lo"), F.lead("bound").over(w).alias("hi"))
    label = F.concat(F.lit(" Rate is "), to_precision2(F.col("lo")), F.lit(" - "), to_precision2(F.col("hi")), F.lit(" % / s"))
    return pairs.where(F.col("hi").isNotNull()).select(F.col("tab").cast("int").alias("tab"), label.alias("label"))


def rules_document(spark: SparkSession, app: str, min_support: float, min_confidence: float,
                   bins: dict[str, list[float]], rules: DataFrame,
                   fp_growth_ms: int = 0, execution_ms: int = 0) -> DataFrame:
    """The JSON envelope as ordered text lines (column ``line``): a head, one rule per line, a foot.

    One range-partitioned sort puts them in order, so no task holds all rules; written as text, the
    part files in order of their names are one JSON document.  All rules but the first begin with a comma; the first
    is found as the least by the same order.
    """
    order = [F.desc("confidence"), mining.itemset_key(F.col("antecedent")), mining.itemset_key(F.col("consequent"))]
    lead = rules.orderBy(*order).limit(1).select("antecedent", "consequent", F.lit(True).alias("leads"))
    bins_map = F.create_map(*[x for k, v in bins.items() for x in (F.lit(k), F.array(*[F.lit(float(b)) for b in v]))]) \
        if bins else F.create_map().cast("map<string,array<double>>")
    envelope = F.to_json(F.struct(
        F.lit(app).alias("applicationName"),
        F.lit(float(min_support)).alias("minSupport"),
        F.lit(float(min_confidence)).alias("minConfidence"),
        F.lit(int(fp_growth_ms)).cast("long").alias("FPGrowthRunTime"),
        F.lit(int(execution_ms)).cast("long").alias("executionTime"),
        bins_map.alias("bins")))
    none = F.array().cast("array<string>")
    ends = spark.range(2).select(
        F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(2)).alias("place"), F.lit(0.0).alias("confidence"), none.alias("antecedent"), none.alias("consequent"),
        F.when(F.col("id") == 0, F.regexp_replace(envelope, r"\}$", F.lit(',"rules":['))).otherwise(F.lit("]}")).alias("line"))
    rule = F.to_json(F.struct(F.col("antecedent").alias("antecedents"), F.col("consequent").alias("consequents"), "confidence"))
    body = rules.join(F.broadcast(lead), ["antecedent", "consequent"], "left").select(
        F.lit(1).alias("place"), "confidence", "antecedent", "consequent", F.when(F.col("leads"), rule).otherwise(F.concat(F.lit(","), rule)).alias("line"))
    return ends.unionByName(body).orderBy("place", *order).select("line")
