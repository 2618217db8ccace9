"""Flagship plan: which device conditions go with high or low drain for an app.

``mine_rules(rates, app, ...)`` = app filter -> flatten -> bins (one
aggregate; the only driver round trip: a few bounds per feature) -> item
columns (CASE chains over literal bounds, whole-stage codegen) -> frequent
itemsets -> rules -> rate-consequent filter -> pruning -> order.
Everything except the bounds stays distributed and lazy.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainrules.functions import discretize as dz
from drainrules.operators import features as feat
from drainrules.operators import mining
from drainrules.operators import prepare
from drainrules.sources import io

# --- fixed values: defaults of the search service ---------------------------
DEFAULT_MIN_SUPPORT = 0.01
DEFAULT_MIN_CONFIDENCE = 0.5


@dataclass
class RuleResult:
    app: str
    min_support: float
    min_confidence: float
    bins: dict[str, list[float]]
    samples: DataFrame          # flat samples of the app
    items: DataFrame            # ten nullable item columns per sample
    itemsets: DataFrame         # items array, freq
    rules: DataFrame            # all rules (antecedent, consequent, confidence)
    excluded: frozenset = field(default_factory=frozenset)
    fp_growth_ms: int = 0       # wall time of mining (itemsets + rules), as in the envelope

    def document(self, execution_ms: int = 0) -> DataFrame:
        """The JSON document of the ordered rules as ordered text lines (column ``line``)."""
        from drainrules.operators import report
        spark = self.rules.sparkSession
        return report.rules_document(spark, self.app, self.min_support, self.min_confidence, self.bins,
                                     self.pruned, self.fp_growth_ms, execution_ms)

    @property
    def rate_rules(self) -> DataFrame:
        return mining.rate_rules(self.rules)

    @property
    def pruned(self) -> DataFrame:
        return mining.prune_rules(self.rate_rules)

    @property
    def ordered(self) -> DataFrame:
        return mining.order_rules(self.pruned)


def validate(app: str, min_support: float | None, min_confidence: float | None) -> tuple[float, float]:
    if not app:
        raise ValueError("Missing 'applicationName'")
    s = DEFAULT_MIN_SUPPORT if min_support is None else float(min_support)
    c = DEFAULT_MIN_CONFIDENCE if min_confidence is None else float(min_confidence)
    if not (0.0 < s <= 1.0 and 0.0 <= c <= 1.0):  # at support 0 the number of itemsets has no bound
        raise ValueError("minSupport must lie in (0, 1] and minConfidence in [0, 1]")
    return s, c


def mine_samples(samples: DataFrame, app: str, min_support: float | None = None,
                 min_confidence: float | None = None, excluded: str | Sequence[str] | None = None, *,
                 exact: bool = False, miner: str = "packed", num_partitions: int | None = None,
                 accuracy: int = feat.DEFAULT_ACCURACY) -> RuleResult:
    """Mine flat samples (already restricted to one app).

    One job computes the app's flat samples (ten columns) and stores them; bins and miner read the stored ones.
    """
    s, c = validate(app, min_support, min_confidence)
    ex = dz.parse_excluded(excluded)
    stored = feat.store_samples(samples, ex)
    bins = feat.compute_bins(stored.samples, ex, exact=exact, accuracy=accuracy, ends=stored.ends)
    items = feat.item_table(stored.samples, bins, ex)
    t0 = time.perf_counter()
    if miner == "packed":
        coded = feat.coded_items(stored, bins, ex, max(1, math.ceil(s * stored.n_rows)))
        itemsets, rules = mining.mine_coded(coded, s, c, stored.n_rows)
    else:
        itemsets, rules = mining.mine(items, s, c, miner=miner, num_partitions=num_partitions)
    fp_ms = int((time.perf_counter() - t0) * 1000)
    return RuleResult(app, s, c, bins, stored.samples, items, itemsets, rules, ex, fp_ms)


def mine_rules(rates: DataFrame, app: str, min_support: float | None = None,
               min_confidence: float | None = None, excluded: str | Sequence[str] | None = None, *,
               exact: bool = False, miner: str = "packed", num_partitions: int | None = None,
               accuracy: int = feat.DEFAULT_ACCURACY) -> RuleResult:
    """Rule search over nested rate records for one app."""
    samples = prepare.flatten_rates(prepare.filter_app(rates, app))
    return mine_samples(samples, app, min_support, min_confidence, excluded, exact=exact, miner=miner,
                        num_partitions=num_partitions, accuracy=accuracy)


def mine_stored_rules(spark: SparkSession, rates_path: str, app: str, min_support: float | None = None,
                      min_confidence: float | None = None, excluded: str | Sequence[str] | None = None, **options) -> RuleResult:
    """Rule search over stored rates; of rates stored by app only the app's row groups are read."""
    samples = prepare.flatten_rates(io.read_rates_for(spark, rates_path, app))
    return mine_samples(samples, app, min_support, min_confidence, excluded, **options)
