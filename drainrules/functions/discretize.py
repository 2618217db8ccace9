"""Feature discretisers as built-in Column expressions (no UDFs).

Every feature of a flat sample becomes at most one item ``name=value``.  A
numeric feature has a *domain rule*: a short list of ``(predicate, label)``
cases checked in order (label ``None`` = no item).  Values no case claims go
to a right-closed quantile bucket: ``q1`` for ``x <= b1``, ``q2`` for
``b1 < x <= b2``, ..., ``q{k+1}`` above the last bound (first match wins, so
tied bounds leave later buckets empty).

NaN is tested before any comparison: Spark orders NaN above every number,
while the domain rules expect every comparison with NaN to be false.  A null
number gives no item.  Note that the rate item is bucketed *without* its
domain rule (the rule only selects the values its bounds are computed from),
so every transaction carries a rate item; NaN or very high rates fall in the
top bucket, negative ones in ``q1``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Case = tuple[Callable[[Column], Column], "str | None"]


@dataclass(frozen=True)
class FeatureSpec:
    """One feature of the flat sample.

    item:      item name in transactions (``cpu``, ``temperature`` ...)
    column:    column of the flat sample it reads
    buckets:   number of quantile buckets (0 = not bucketed)
    cases:     domain rule, checked in order after the NaN case
    nan_case:  whether NaN is claimed by the rule (gives no item)
    bin_name:  key of its bounds in the bins table (None = no bins)
    item_uses_rule: whether the item applies the rule (False only for rate)
    """

    item: str
    column: str
    buckets: int
    cases: tuple = field(default_factory=tuple)
    nan_case: bool = True
    bin_name: str | None = None
    item_uses_rule: bool = True

    def probabilities(self) -> list[float]:
        # (1 / buckets) * i for i = 1 .. buckets - 1, computed as the reference does
        return [(1.0 / self.buckets) * i for i in range(1, self.buckets)]

    def claimed(self, x: Column) -> Column:
        """True where the domain rule claims x (x is then not bucketed)."""
        cond = F.isnan(x) if self.nan_case else F.lit(False)
        for pred, _ in self.cases:
            cond = cond | pred(x)
        return x.isNotNull() & cond

    def in_domain(self, x: Column) -> Column:
        """True where x feeds the bounds (not null, not NaN, not claimed)."""
        return x.isNotNull() & ~F.isnan(x) & ~self.claimed(x)

    def rule_label(self, x: Column) -> Column:
        """Label chosen by the domain rule (null = no item or not claimed)."""
        expr = None
        if self.nan_case:
            expr = F.when(F.isnan(x), F.lit(None).cast("string"))
        for pred, label in self.cases:
            value = F.lit(label) if label is not None else F.lit(None).cast("string")
            expr = F.when(pred(x), value) if expr is None else expr.when(pred(x), value)
        return expr if expr is not None else F.lit(None).cast("string")


def bucket_index(x: Column, bounds: Sequence[float]) -> Column:
    """1-based right-closed bucket of x for ascending ``bounds`` (k bounds -> 1..k+1)."""
    if not bounds:
        return F.lit(1)
    expr = F.when(x <= F.lit(float(bounds[0])), F.lit(1))
    for i, b in enumerate(bounds[1:], start=2):
        expr = expr.when(x <= F.lit(float(b)), F.lit(i))
    return expr.otherwise(F.lit(len(bounds) + 1))


def numeric_item(spec: FeatureSpec, x: Column, bounds: Sequence[float]) -> Column:
    """Nullable item string for a numeric feature."""
    bucket = F.concat(F.lit(f"{spec.item}=q"), bucket_index(x, bounds).cast("string"))
    if not spec.item_uses_rule:
        return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(bucket)
    labelled = F.concat(F.lit(f"{spec.item}="), spec.rule_label(x))
    if spec.buckets == 0:
        return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(labelled)
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(spec.claimed(x), labelled)
        .otherwise(bucket)
    )


def _item_labels(spec: FeatureSpec) -> list[str]:
    return [label for _, label in spec.cases if label is not None] if spec.item_uses_rule else []


def numeric_items(spec: FeatureSpec, bounds: Sequence[float]) -> list[str]:
    """The items a numeric feature can have; the code of an item is its place here, from 1."""
    buckets = len(bounds) + 1 if spec.buckets else 0
    return [f"{spec.item}={label}" for label in [*_item_labels(spec), *(f"q{i + 1}" for i in range(buckets))]]


def numeric_code(spec: FeatureSpec, x: Column, bounds: Sequence[float]) -> Column:
    """Code of ``numeric_item`` among ``numeric_items``; 0 where there is no item."""
    labels = _item_labels(spec)
    expr = F.when(x.isNull(), F.lit(0))
    if spec.item_uses_rule:
        if spec.nan_case:
            expr = expr.when(F.isnan(x), F.lit(0))
        for pred, label in spec.cases:
            expr = expr.when(pred(x), F.lit(0 if label is None else labels.index(label) + 1))
    return expr.otherwise(bucket_index(x, bounds) + len(labels) if spec.buckets else F.lit(0))


# --- fixed values: domain rules of the numeric features, in rule order -------
RATE_CASES = ((lambda x: x < 0.0, None), (lambda x: x > 1.0, "batteryDying"))
CPU_CASES = ((lambda x: x < 0.0, None), (lambda x: x > 1.0, None))
DISTANCE_CASES = ((lambda x: x >= 100.0, "yes"), (lambda x: x < 100.0, "no"))
TEMPERATURE_CASES = ((lambda x: x < 5.0, None), (lambda x: x > 100.0, None))
SCREEN_CASES = ((lambda x: x == -1.0, "auto"), (lambda x: x < -1.0, None), (lambda x: x > 255.0, None))
WIFI_STRENGTH_CASES = ((lambda x: x < -100.0, None), (lambda x: x > 0.0, None))
WIFI_SPEED_CASES = ((lambda x: x < 0.0, None),)

# --- fixed values: mobile network type codes (telephony constants) -----------
MOBILE_NETWORK_CODES = {
    "1": "gprs", "2": "edge", "3": "umts", "4": "cdma", "5": "evdo_0", "6": "evdo_a",
    "7": "1xrtt", "8": "hsdpa", "9": "hsupa", "10": "hspa", "11": "iden", "12": "evdo_b",
    "13": "lte", "14": "ehrpd", "15": "hspap", "16": "gsm", "17": "td_scdma", "18": "iwlan",
}
UNKNOWN_MARKERS = ("unknown", "null")

NUMERIC_FEATURES: tuple[FeatureSpec, ...] = (
    FeatureSpec("rate", "rate", 4, RATE_CASES, True, "rate", item_uses_rule=False),
    FeatureSpec("cpu", "cpu", 4, CPU_CASES, True, "cpu"),
    FeatureSpec("distance", "distance", 0, DISTANCE_CASES, True, None),
    FeatureSpec("temperature", "temp", 4, TEMPERATURE_CASES, True, "temperature"),
    FeatureSpec("voltage", "voltage", 3, (), False, "voltage"),
    FeatureSpec("screen", "screen", 4, SCREEN_CASES, True, "screen"),
    FeatureSpec("wifiStrength", "wifiStrength", 4, WIFI_STRENGTH_CASES, True, "wifiStrength"),
    FeatureSpec("wifiSpeed", "wifiSpeed", 4, WIFI_SPEED_CASES, True, "wifiSpeed"),
)

# Item order inside a transaction.
ITEM_ORDER = (
    "rate", "cpu", "distance", "temperature", "voltage", "screen",
    "mobileNetType", "netType", "wifiStrength", "wifiSpeed",
)
EXCLUDABLE = ITEM_ORDER[1:]
EXCLUDE_ALIASES = {"temp": "temperature"}


def mobile_network_item(x: Column) -> Column:
    """``mobileNetType=...``: known codes named, other all-digit codes unknown."""
    mapping = F.create_map(*[F.lit(v) for kv in MOBILE_NETWORK_CODES.items() for v in kv])
    value = (
        F.when(x.isNull() | x.isin(*UNKNOWN_MARKERS), F.lit("unknown"))
        .when(mapping[x].isNotNull(), mapping[x])
        .when(x.rlike(r"^[0-9]+\z"), F.lit("unknown"))
        .otherwise(x)
    )
    return F.concat(F.lit("mobileNetType="), value)


def network_item(x: Column) -> Column:
    value = F.when(x.isNull() | x.isin(*UNKNOWN_MARKERS), F.lit("unknown")).otherwise(x)
    return F.concat(F.lit("netType="), value)


def spec(item: str) -> FeatureSpec:
    for s in NUMERIC_FEATURES:
        if s.item == item:
            return s
    raise KeyError(item)


def parse_excluded(excluded: str | Sequence[str] | None) -> frozenset[str]:
    """Exclusion list (comma string or names) -> set of item names.

    Names are trimmed; ``temp`` (what the search form sends) means
    ``temperature``; ``rate`` cannot be excluded; unknown names raise.
    """
    if excluded is None:
        return frozenset()
    names = excluded.split(",") if isinstance(excluded, str) else list(excluded)
    out = set()
    for raw in names:
        name = raw.strip()
        if not name:
            continue
        name = EXCLUDE_ALIASES.get(name, name)
        if name not in EXCLUDABLE:
            raise ValueError(f"unknown feature to exclude: {raw!r}; legal: {', '.join(EXCLUDABLE)}")
        out.add(name)
    return frozenset(out)
