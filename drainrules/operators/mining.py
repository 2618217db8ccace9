"""Frequent itemsets, association rules, rate-rule filter, pruning, order.

Three miners give the same rules:

* ``packed`` (default): a transaction is one long, a few bits per feature
  (``CodedItems``), and equal ones are collapsed to one row with a weight
  (map-side combine).  What is left is bounded by the number of items, not by
  the data.  The itemsets over a feature set are the values of the long under
  that set's bit mask.  One aggregate (generated code over two integers)
  counts all itemsets of up to three items; of each larger size only the
  candidates whose smaller subsets are all frequent, for which the masked
  longs are looked up in the (bounded, broadcast) candidates first.
* ``fpgrowth``: Spark ML FP-growth.  Item counts use map-side
  combine; conditional FP-trees are merged map-side before the shuffle, so a
  hot item ships trees, never rows.
* ``cube``: a transaction holds at most one item per feature, so the support
  of every itemset is one cell of ``GROUP BY CUBE(features)``.  Identical
  transactions are pre-aggregated first (partial + final aggregation), then
  the ``2^features`` grouping sets run over the distinct transactions only.

Bound on the result size: itemsets over the same feature set partition the
transactions, so at most ``1/min_support`` of them are frequent per feature
set; there are ``2^10`` feature sets, hence <= ``1024 / min_support``
frequent itemsets and <= 10x that many rules, whatever the data size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations, groupby

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drainrules.functions import discretize as dz
from drainrules.session import ensure_checkpoint_dir, materialize

KEY_SEP = ";"
SMALL_SIZES = 3  # itemsets up to this size are counted by one aggregate over all feature sets
BROADCAST_CANDIDATES = 100_000
MAX_BITS = 62  # of a packed transaction
CHAIN_ITEMS = 64  # codes of text items come from a CASE chain up to this many, then from a join


def itemset_key(arr: Column) -> Column:
    """Canonical string of an itemset (sorted, ';'-joined)."""
    return F.array_join(F.array_sort(arr), KEY_SEP)


# --------------------------------------------------------------------------- FP-growth
def fpgrowth(tx: DataFrame, min_support: float, min_confidence: float,
             num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(freq_itemsets[items, freq], rules[antecedent, consequent, confidence]).

    FP-growth partitions its conditional trees by item, independent of the
    input splits, so ``num_partitions`` (default: the session's shuffle
    partitions) sets the mining parallelism.  The frequent itemsets (bounded,
    see above) and the rules derived from them with one join are each written
    once as parquet to the shared checkpoint folder and read back, so later
    actions neither re-mine nor depend on lost executors.
    """
    spark = tx.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    tx = tx.select("items")
    # FP-growth builds its conditional trees in the input tasks (RDD code,
    # outside AQE): deal the transactions evenly to the mining tasks.
    tx = tx.repartition(parts)
    # Spark ML persists the transactions only while fitting, but the itemsets
    # are mined lazily afterwards; keep them (spilling to disk) until the
    # itemsets are stored, so the transactions are built once.
    tx = tx.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        est = FPGrowth(itemsCol="items", minSupport=float(min_support), minConfidence=float(min_confidence),
                       numPartitions=parts)
        model = est.fit(tx)
        itemsets = materialize(model.freqItemsets.select("items", F.col("freq").cast("long").alias("freq")),
                               "itemsets")
    finally:
        tx.unpersist()
    return itemsets, materialize(rules_from_itemsets(itemsets, min_confidence), "rules")


# --------------------------------------------------------------------------- packed miner
Itemset = tuple[tuple[int, int], ...]  # (feature, code) in order of features


@dataclass
class CodedItems:
    """Transactions as one code column per feature (0 or null: no item) and the items the codes stand for, from 1."""

    codes: DataFrame
    names: dict[str, list[str]]


def code_of(text: Column, names: list[str]) -> Column:
    """The place of a text among ``names``, from 1 (0: not there)."""
    if not names:
        return F.lit(0)
    if len(names) > CHAIN_ITEMS:
        return F.coalesce(F.array_position(F.array(*map(F.lit, names)), text), F.lit(0)).cast("int")
    expr = F.when(text == F.lit(names[0]), F.lit(1))
    for i, name in enumerate(names[1:], 2):
        expr = expr.when(text == F.lit(name), F.lit(i))
    return expr.otherwise(F.lit(0))


def code_items(tx_items: DataFrame, features: list[str], min_support: float) -> tuple[CodedItems, int]:
    """Codes for a table of nullable item columns, and its row count: items below the support get none."""
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("item")) for f in features],
                              F.struct(F.lit("").alias("f"), F.lit("").alias("item"))))
    per_item = materialize(
        tx_items.select(every.alias("e")).where("e.item is not null").groupBy("e.f", "e.item").agg(F.count(F.lit(1)).alias("n")), "item-counts")
    n_tx = (per_item.where("f = ''").collect() or [{"n": 0}])[0]["n"]
    names: dict[str, list[str]] = {f: [] for f in features}
    for r in per_item.where((F.col("f") != "") & (F.col("n") >= _min_count(min_support, n_tx))).collect():
        names[r["f"]].append(r["item"])
    names = {f: sorted(v) for f, v in names.items()}
    return CodedItems(tx_items.select(*[code_of(F.col(f), names[f]).alias(f) for f in features]), names), n_tx


def _min_count(min_support: float, n_tx: int) -> int:
    return max(1, math.ceil(float(min_support) * n_tx))


def packed_itemsets(coded: CodedItems, min_support: float, n_tx: int | None = None) -> DataFrame:
    """Frequent itemsets ``(items, freq)`` of coded transactions.

    The driver holds the frequent itemsets, which are bounded (see above), and the candidates of one size.
    """
    features = [f for f, names in coded.names.items() if names]
    spark = coded.codes.sparkSession
    shifts, at = [], 0
    for f in features:
        shifts.append(at)
        at += len(coded.names[f]).bit_length()
    if at > MAX_BITS:
        raise ValueError("the items of all features do not fit one long: ask for a higher support, or use the fpgrowth miner")
    packed = F.lit(0).cast("long")
    for f, shift in zip(features, shifts):
        packed = packed + F.shiftleft(F.coalesce(F.col(f), F.lit(0)).cast("long"), shift)
    # Few bytes, but much work per row: dealt evenly to all tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(coded.codes.select(packed.alias("tx")).groupBy("tx").agg(F.count(F.lit(1)).alias("w")).repartition(parts), "packed-tx")
    if n_tx is None:
        n_tx = table.agg(F.sum("w").alias("n")).first()["n"] or 0
    min_count = _min_count(min_support, n_tx)
    fields = [((1 << len(coded.names[f]).bit_length()) - 1) << shift for f, shift in zip(features, shifts)]

    def cells(sets: list[tuple[int, ...]]) -> DataFrame:
        """``(n, v, w)``: for each transaction and feature set (number n) the transaction under the set's mask."""
        masks = ", ".join(f"{sum(fields[i] for i in s)}L" for s in sets)
        return table.selectExpr("w", "tx", f"posexplode(array({masks})) AS (n, mask)").selectExpr("n", "tx & mask AS v", "w")

    def frequent(rows: DataFrame, sets: list[tuple[int, ...]]) -> dict[Itemset, int]:
        counted = rows.groupBy("n", "v").agg(F.sum("w").alias("w")).where(F.col("w") >= min_count).collect()
        # Cells in which a feature has no item are counted like the others, and are as bounded.
        return {tuple((i, (r["v"] & fields[i]) >> shifts[i]) for i in sets[r["n"]]): r["w"] for r in counted
                if all(r["v"] & fields[i] for i in sets[r["n"]])}

    small = [s for k in range(1, min(SMALL_SIZES, len(features)) + 1) for s in combinations(range(len(features)), k)]
    found = frequent(cells(small), small) if small else {}
    level = sorted(s for s in found if len(s) == SMALL_SIZES)
    while level:
        wanted = _candidates(level)
        if not wanted:
            break
        sets = sorted({tuple(i for i, _ in c) for c in wanted})
        number = {s: n for n, s in enumerate(sets)}
        asked = spark.createDataFrame([(number[tuple(i for i, _ in c)], sum(code << shifts[i] for i, code in c)) for c in wanted], "n int, v bigint")
        hits = cells(sets).join(F.broadcast(asked) if len(wanted) <= BROADCAST_CANDIDATES else asked, ["n", "v"])
        more = frequent(hits, sets)
        found |= more
        level = sorted(more)
    rows = [([coded.names[features[i]][code - 1] for i, code in s], n) for s, n in found.items()]
    return materialize(spark.createDataFrame(rows, "items array<string>, freq bigint"), "itemsets")


def _candidates(level: list[Itemset]) -> list[Itemset]:
    """Itemsets one larger whose subsets of this size are all in ``level`` (sorted): two that differ in the last item are joined."""
    known, out = set(level), []
    for _, group in groupby(level, key=lambda s: s[:-1]):
        for a, b in combinations(group, 2):
            if a[-1][0] != b[-1][0]:
                c = (*a, b[-1])
                if all((*c[:j], *c[j + 1:]) in known for j in range(len(c) - 2)):
                    out.append(c)
    return out


# --------------------------------------------------------------------------- CUBE miner
def _subsets(arr: Column, proper: bool) -> Column:
    """All non-empty subsets of a sorted array (proper ones only if asked).

    Bit ``i`` of a mask picks element ``i``; arrays here hold at most ten
    items, so at most 2^10 - 1 subsets.
    """
    k = F.size(arr)
    top = F.pow(F.lit(2), k).cast("int") - (2 if proper else 1)
    masks = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    return F.transform(masks, lambda m: F.filter(arr, lambda x, i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0))


def cube_itemsets(items: DataFrame, features: list[str], min_support: float) -> DataFrame:
    """Frequent itemsets from a table of nullable per-feature item columns.

    Every itemset count is a cell of ``GROUP BY CUBE(features)``.  Identical
    transactions are pre-aggregated first (partial + final aggregation); each
    distinct transaction then emits its non-empty subsets with its weight and
    one more aggregation sums them.  Returns ``items array<string>, freq
    bigint`` like FP-growth; the transaction count (one number) fixes the
    minimum count ``ceil(min_support * n)`` as FP-growth does.
    """
    n_tx = items.count()
    min_count = int(math.ceil(float(min_support) * n_tx))
    tx = items.select(F.array_sort(F.array_compact(F.array(*features))).alias("tx"))
    distinct_tx = tx.groupBy("tx").agg(F.count(F.lit(1)).alias("w"))
    cells = distinct_tx.select(F.explode(_subsets(F.col("tx"), proper=False)).alias("items"), "w")
    return (cells.groupBy("items").agg(F.sum("w").cast("long").alias("freq"))
            .where(F.col("freq") >= F.lit(min_count)))


def rules_from_itemsets(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Single-consequent rules ``A -> c`` with ``freq(A+c)/freq(A) >= min_confidence``."""
    keyed = itemsets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("freq_a"))
    cand = itemsets.where(F.size("items") >= 2).select(
        F.col("freq").alias("freq_u"), F.explode("items").alias("consequent_item"), F.col("items"))
    cand = cand.select(
        "freq_u", "consequent_item",
        F.array_sort(F.filter("items", lambda x: x != F.col("consequent_item"))).alias("antecedent"))
    joined = cand.join(keyed, "antecedent")
    conf = F.col("freq_u").cast("double") / F.col("freq_a").cast("double")
    return joined.where(conf >= F.lit(float(min_confidence))).select(
        "antecedent", F.array("consequent_item").alias("consequent"), conf.alias("confidence"))


# --------------------------------------------------------------------------- rules
def rate_rules(rules: DataFrame) -> DataFrame:
    """Rules with a drain-rate item among the consequents."""
    return rules.where(F.exists("consequent", lambda x: x.startswith("rate=")))


def prune_rules(rules: DataFrame) -> DataFrame:
    """Keep the most general rules of each (consequent, confidence) group.

    A rule goes when another rule of its group has a strictly smaller
    antecedent contained in its own.  Instead of comparing rule pairs, each
    rule lists its proper antecedent subsets (at most 2^9 - 2) and one equi
    semi-join on ``(consequent, confidence, subset)`` finds the dominated
    rules: linear in rules, no pair explosion even for a huge group.
    """
    base = rules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.array_sort("consequent").alias("consequent"),
        F.col("confidence"),
    )
    # only rules with company in their group can be dominated
    group = Window.partitionBy("consequent", "confidence")
    several = base.withColumn("__n", F.count(F.lit(1)).over(group)).where("__n > 1")
    subs = several.select("consequent", "confidence", F.col("antecedent").alias("dominated"),
                       F.explode(_subsets(F.col("antecedent"), proper=True)).alias("antecedent"))
    hit = subs.join(base.select("consequent", "confidence", "antecedent"),
                    ["consequent", "confidence", "antecedent"], "left_semi")
    dominated = hit.select("consequent", "confidence", F.col("dominated").alias("antecedent")).distinct()
    return base.join(dominated, ["consequent", "confidence", "antecedent"], "left_anti").select(
        "antecedent", "consequent", "confidence")


def order_rules(rules: DataFrame) -> DataFrame:
    """By confidence descending; ties by antecedent key, then consequent."""
    return rules.orderBy(F.desc("confidence"), itemset_key(F.col("antecedent")), itemset_key(F.col("consequent")))


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules as flat comparable strings: antecedent, consequent, confidence, n_items."""
    return rules.select(
        itemset_key(F.col("antecedent")).alias("antecedent"),
        itemset_key(F.col("consequent")).alias("consequent"),
        F.col("confidence"),
        F.size("antecedent").cast("int").alias("n_antecedent"),
    )


def mine(tx_items: DataFrame, min_support: float, min_confidence: float, *, miner: str = "packed",
         num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets and all rules from an item table (ten item columns).

    ``tx_items`` has one nullable string column per feature (``ITEM_ORDER``).
    """
    features = list(dz.ITEM_ORDER)
    if miner == "packed":
        coded, n_tx = code_items(tx_items, features, min_support)
        itemsets = packed_itemsets(coded, min_support, n_tx)
    elif miner == "fpgrowth":
        tx = tx_items.select(F.array_compact(F.array(*features)).alias("items"))
        return fpgrowth(tx, min_support, min_confidence, num_partitions)
    elif miner == "cube":
        itemsets = materialize(cube_itemsets(tx_items, features, min_support), "itemsets")
    else:
        raise ValueError(f"unknown miner {miner!r}")
    return itemsets, materialize(rules_from_itemsets(itemsets, min_confidence), "rules")


def mine_coded(coded: CodedItems, min_support: float, min_confidence: float, n_tx: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets and all rules from coded transactions."""
    itemsets = packed_itemsets(coded, min_support, n_tx)
    return itemsets, materialize(rules_from_itemsets(itemsets, min_confidence), "rules")
