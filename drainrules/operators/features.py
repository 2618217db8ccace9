"""Bins and transactions of flat samples.

Bins: for every bucketed feature ``[min] + quantiles + [max]`` of its in-domain
values.  All features are computed in ONE aggregate pass (partial + final
aggregation, no shuffle of rows); only a few numbers per feature reach the
driver, where they become literals of the bucket ``CASE`` chains.

``exact=False`` (default, the scale path) merges quantile sketches (KLL) in two
levels: each task's sketches first meet by salt, ``SKETCH_SALTS`` tasks at a time,
and the last task merges one sketch per salt and feature.  Their size follows from
``accuracy`` (rank error 1/accuracy, as the original job asks for).  ``exact=True`` returns
the rank-``ceil(p*n)`` element exactly, by distributed selection: each round
brackets every target rank with approximate quantiles and counts, so the
candidate range shrinks ~1000x per round and memory stays bounded by
``exact_threshold`` values per target; no data passes through the driver.

Several passes over an app's samples read ``store_samples``: one job computes the
samples, stores them, and gathers row count, minimum, maximum and count per feature
on the way (observed metrics), so that filters and joins before it run once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from drainrules.functions import discretize as dz
from drainrules.operators.mining import CodedItems, code_of
from drainrules.session import materialize

DEFAULT_ACCURACY = 10000  # relative error 0.0001
EXACT_THRESHOLD = 250_000
SKETCH_SALTS = 64  # sketches that the last merge takes per feature
MAX_SKETCH = 65535  # largest sketch parameter

Ends = dict[str, tuple[float | None, float | None, int]]  # bin name -> min, max, count of in-domain values


def active_specs(excluded: frozenset[str]) -> list[dz.FeatureSpec]:
    return [s for s in dz.NUMERIC_FEATURES if s.item not in excluded]


def binned_specs(excluded: frozenset[str]) -> list[dz.FeatureSpec]:
    return [s for s in active_specs(excluded) if s.bin_name is not None]


def _domain_value(spec: dz.FeatureSpec) -> Column:
    x = F.col(spec.column)
    return F.when(spec.in_domain(x), x)


@dataclass
class _Target:
    name: str
    idx: int
    r: int  # 1-based rank wanted among the candidates
    m: int  # candidates left
    lo: float | None = None  # open interval (lo, hi) of candidates
    hi: float | None = None
    answer: float | None = None


def _interval(x: Column, lo: float | None, hi: float | None) -> Column:
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x > F.lit(lo))
    if hi is not None:
        cond = cond & (x < F.lit(hi))
    return cond


def _exact_quantiles(df: DataFrame, values: dict[str, Column], counts: dict[str, int],
                     probs: dict[str, list[float]], accuracy: int, threshold: int) -> dict[str, list[float]]:
    targets = []
    for name, ps in probs.items():
        n = counts[name]
        if n == 0:
            continue
        for i, p in enumerate(ps):
            r = max(1, min(n, math.ceil(p * n)))
            targets.append(_Target(name, i, r, n))
    while any(t.answer is None for t in targets):
        open_ = [t for t in targets if t.answer is None]
        small = [t for t in open_ if t.m <= threshold]
        big = [t for t in open_ if t.m > threshold]
        if small:
            # Summaries of <= threshold values are exact at this accuracy; targets
            # of one feature over the same candidates share one summary.
            groups: dict[tuple, list[_Target]] = {}
            for t in small:
                groups.setdefault((t.name, t.lo, t.hi, t.m), []).append(t)
            aggs = []
            for k, ((name, lo, hi, m), ts) in enumerate(groups.items()):
                x = F.when(_interval(values[name], lo, hi), values[name])
                aggs.append(F.percentile_approx(x, [(t.r - 0.5) / m for t in ts], 4 * m + 4).alias(f"g{k}"))
            row = df.agg(*aggs).collect()[0]
            for k, ts in enumerate(groups.values()):
                for t, q in zip(ts, row[f"g{k}"]):
                    t.answer = float(q)
        if not big:
            continue
        eps = 1.0 / accuracy
        groups = {}
        for t in big:
            groups.setdefault((t.name, t.lo, t.hi), []).append(t)
        aggs = []
        for k, ((name, lo, hi), ts) in enumerate(groups.items()):
            x = F.when(_interval(values[name], lo, hi), values[name])
            ps = []
            for t in ts:
                q = t.r / t.m
                ps += [max(0.0, q - 3 * eps), min(1.0, q + 3 * eps)]
            aggs.append(F.percentile_approx(x, ps, accuracy).alias(f"g{k}"))
        row = df.agg(*aggs).collect()[0]
        found = {}
        for k, ts in enumerate(groups.values()):
            qs = row[f"g{k}"]
            for j, t in enumerate(ts):
                found[id(t)] = (float(qs[2 * j]), float(qs[2 * j + 1]))
        bounds = [found[id(t)] for t in big]
        aggs = []
        for k, t in enumerate(big):
            v = values[t.name]
            inside = _interval(v, t.lo, t.hi)
            low, high = bounds[k]
            for j, cond in enumerate((v < F.lit(low), v <= F.lit(low), v < F.lit(high), v <= F.lit(high))):
                aggs.append(F.count(F.when(inside & cond, F.lit(1))).alias(f"c{k}_{j}"))
        row = df.agg(*aggs).collect()[0]
        for k, t in enumerate(big):
            low, high = bounds[k]
            c1, c2, c3, c4 = (row[f"c{k}_{j}"] for j in range(4))
            if c1 < t.r <= c2:
                t.answer = low
            elif c3 < t.r <= c4:
                t.answer = high
            elif c2 < t.r <= c3:
                t.lo, t.hi, t.r, t.m = low, high, t.r - c2, c3 - c2
            elif t.r <= c1:
                t.hi, t.m = low, c1
            else:
                t.lo, t.r, t.m = high, t.r - c4, t.m - c4
    out: dict[str, list[float]] = {name: [0.0] * len(ps) for name, ps in probs.items()}
    for t in targets:
        out[t.name][t.idx] = t.answer
    return out


@dataclass
class StoredSamples:
    """Flat samples written once, with what was observed while they were written."""

    samples: DataFrame
    n_rows: int
    ends: Ends


def _end_columns(specs: list[dz.FeatureSpec]) -> list[Column]:
    out = []
    for s in specs:
        v = _domain_value(s)
        out += [F.min(v).alias(f"{s.bin_name}__min"), F.max(v).alias(f"{s.bin_name}__max"), F.count(v).alias(f"{s.bin_name}__n")]
    return out


def _ends_of(row, specs: list[dz.FeatureSpec]) -> Ends:
    return {s.bin_name: (row[f"{s.bin_name}__min"], row[f"{s.bin_name}__max"], int(row[f"{s.bin_name}__n"])) for s in specs}


def store_samples(samples: DataFrame, excluded: frozenset[str] = frozenset()) -> StoredSamples:
    """Write the samples to the shared folder in one job that also observes row count and ends per feature.

    The metrics stand in the job's last stage, right above the write, where a task that is
    run again counts once.
    """
    specs = binned_specs(excluded)
    seen = Observation()
    stored = materialize(samples.observe(seen, F.count(F.lit(1)).alias("n_rows"), *_end_columns(specs)), "samples")
    row = seen.get
    return StoredSamples(stored, int(row["n_rows"]), _ends_of(row, specs))


def compute_bins(samples: DataFrame, excluded: frozenset[str] = frozenset(), *,
                 exact: bool = False, accuracy: int = DEFAULT_ACCURACY,
                 exact_threshold: int = EXACT_THRESHOLD, salts: int = SKETCH_SALTS,
                 ends: Ends | None = None) -> dict[str, list[float]]:
    """Bounds per bucketed feature: ``{bin_name: [min, q1, ..., max]}``.

    A feature without in-domain values gets no quantiles and bounds
    ``[0.0, 0.0]`` (its values then all fall in ``q1``).  ``ends`` are those of
    ``store_samples``, where the samples were stored.
    """
    own_copy = exact and ends is None and not samples.storageLevel.useMemory and not samples.storageLevel.useDisk
    if own_copy:  # exact mode makes several passes: keep the input for them
        samples = persist_for_reuse(samples)
    try:
        return _compute_bins(samples, excluded, exact, accuracy, exact_threshold, salts, ends)
    finally:
        if own_copy:
            samples.unpersist()


def sketch_size(accuracy: int) -> int:
    """The KLL parameter k whose rank error ``2.296 / k ** 0.9723`` is ``1 / accuracy`` or less."""
    return min(MAX_SKETCH, max(8, math.ceil((2.296 * accuracy) ** (1 / 0.9723))))


def sketched_bins(samples: DataFrame, specs: list[dz.FeatureSpec], accuracy: int, salts: int) -> DataFrame:
    """One row: ends and quantiles (null without values) of every feature, by sketches merged in two levels."""
    k = sketch_size(accuracy)
    salted = samples.select(F.pmod(F.spark_partition_id(), F.lit(int(salts))).alias("__salt"), *[s.column for s in specs])
    per_salt = salted.groupBy("__salt").agg(
        *_end_columns(specs), *[F.kll_sketch_agg_double(_domain_value(s), k).alias(f"{s.bin_name}__s") for s in specs])
    merged = []
    for s in specs:
        name = s.bin_name
        merged += [F.min(f"{name}__min").alias(f"{name}__min"), F.max(f"{name}__max").alias(f"{name}__max"),
                   F.sum(f"{name}__n").alias(f"{name}__n"), F.kll_merge_agg_double(f"{name}__s", k).alias(f"{name}__s")]
    quantiles = [
        F.when(F.col(f"{s.bin_name}__n") > 0, F.kll_sketch_get_quantile_double(f"{s.bin_name}__s", F.array(*map(F.lit, s.probabilities()))))
        .alias(f"{s.bin_name}__q") for s in specs]
    ends = [f"{s.bin_name}__{e}" for s in specs for e in ("min", "max", "n")]
    return per_salt.agg(*merged).select(*ends, *quantiles)


def _compute_bins(samples: DataFrame, excluded: frozenset[str], exact: bool, accuracy: int,
                  exact_threshold: int, salts: int, ends: Ends | None) -> dict[str, list[float]]:
    specs = binned_specs(excluded)
    if exact:
        ends = ends or _ends_of(samples.agg(*_end_columns(specs)).collect()[0], specs)
        # counts are known now, so every exact summary is sized to what it holds
        quantiles = _exact_quantiles(samples, {s.bin_name: _domain_value(s) for s in specs}, {name: e[2] for name, e in ends.items()},
                                     {s.bin_name: s.probabilities() for s in specs}, accuracy, exact_threshold)
    else:
        row = sketched_bins(samples, specs, accuracy, salts).collect()[0]
        ends = _ends_of({k: v or 0 if k.endswith("__n") else v for k, v in row.asDict().items() if not k.endswith("__q")}, specs)
        quantiles = {s.bin_name: [float(q) for q in (row[f"{s.bin_name}__q"] or [])] for s in specs}
    bins: dict[str, list[float]] = {}
    for s in specs:
        low, high, n = ends[s.bin_name]
        bins[s.bin_name] = [float(low), *quantiles[s.bin_name], float(high)] if n else [0.0, 0.0]
    return bins


def rank_errors(samples: DataFrame, bins: dict[str, list[float]], accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """``(feature, idx, n_values, within_error)`` per bound of approximate bins.

    A quantile is within the error if the wanted rank lies at most ``n / accuracy`` ranks (and one, for rounding)
    from the ranks its value takes; the ends must be the least and the greatest value.  One aggregate.
    """
    aggs, rows = [], []
    for s in binned_specs(frozenset()):
        v = _domain_value(s)
        bounds = bins[s.bin_name]
        n = F.count(v)
        wanted = [0.0, *s.probabilities()][: len(bounds) - 1] + [1.0]
        for i, (bound, p) in enumerate(zip(bounds, wanted, strict=True)):
            below, upto = (F.count(F.when(c, v)) for c in (v < F.lit(bound), v <= F.lit(bound)))
            if p in (0.0, 1.0):
                ok = (below == 0) & (upto > 0) if p == 0.0 else (upto == n) & (below < n)
            else:
                slack = n / F.lit(float(accuracy)) + F.lit(1.0)
                ok = (below - slack <= n * F.lit(p)) & (n * F.lit(p) <= upto + slack)
            name = f"{s.bin_name}__{i}"
            aggs.append(F.struct(n.alias("n"), (ok | (n == 0)).alias("ok")).alias(name))
            rows.append(f"'{s.bin_name}', {i}, `{name}`.n, `{name}`.ok")
    return samples.agg(*aggs).selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (feature, idx, n_values, within_error)")


def quantiles_of(bins: dict[str, list[float]], name: str) -> list[float]:
    b = bins.get(name)
    return list(b[1:-1]) if b else []


def item_columns(bins: dict[str, list[float]], excluded: frozenset[str] = frozenset()) -> list[Column]:
    """One nullable item column per feature, in transaction order."""
    by_item = {s.item: s for s in dz.NUMERIC_FEATURES}
    cols = []
    for item in dz.ITEM_ORDER:
        if item in excluded:
            cols.append(F.lit(None).cast("string").alias(item))
            continue
        if item == "mobileNetType":
            c = dz.mobile_network_item(F.col("mobileNetwork"))
        elif item == "netType":
            c = dz.network_item(F.col("network"))
        else:
            s = by_item[item]
            c = dz.numeric_item(s, F.col(s.column), quantiles_of(bins, s.bin_name) if s.bin_name else [])
        cols.append(c.alias(item))
    return cols


def item_table(samples: DataFrame, bins: dict[str, list[float]], excluded: frozenset[str] = frozenset(),
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Samples as ten nullable item columns (``None`` = no item)."""
    return samples.select(*keep, *item_columns(bins, excluded))


def coded_items(stored: StoredSamples, bins: dict[str, list[float]], excluded: frozenset[str], min_count: int) -> CodedItems:
    """Items of the samples as small codes, straight from the values: no item text is built per row.

    Bucketed features have their codes by rule.  Of the two network features only values in ``min_count`` rows or more get
    one: they are counted first, and the driver receives at most ``n_rows / min_count`` of each.
    """
    samples = stored.samples
    texts = {"mobileNetType": dz.mobile_network_item(F.col("mobileNetwork")), "netType": dz.network_item(F.col("network"))}
    texts = {item: c for item, c in texts.items() if item not in excluded}
    found: dict[str, list[str]] = {item: [] for item in texts}
    if texts:
        each = F.explode(F.array(*[F.struct(F.lit(item).alias("f"), c.alias("item")) for item, c in texts.items()]))
        for r in (samples.select(each.alias("e")).groupBy("e.f", "e.item").agg(F.count(F.lit(1)).alias("n"))
                  .where((F.col("n") >= min_count) & F.col("item").isNotNull()).collect()):
            found[r["f"]].append(r["item"])
    by_item = {s.item: s for s in dz.NUMERIC_FEATURES}
    columns, names = [], {}
    for item in dz.ITEM_ORDER:
        if item in excluded:
            code, names[item] = F.lit(0), []
        elif item in texts:
            names[item] = sorted(found[item])
            code = code_of(texts[item], names[item])
        else:
            spec = by_item[item]
            bounds = quantiles_of(bins, spec.bin_name) if spec.bin_name else []
            code, names[item] = dz.numeric_code(spec, F.col(spec.column), bounds), dz.numeric_items(spec, bounds)
        columns.append(code.alias(item))
    return CodedItems(samples.select(*columns), names)


def transactions(samples: DataFrame, bins: dict[str, list[float]], excluded: frozenset[str] = frozenset(),
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Samples as ``items: array<string>`` (absent items dropped, row kept)."""
    items = F.array_compact(F.array(*item_columns(bins, excluded)))
    return samples.select(*keep, items.alias("items"))


def bins_table(spark, bins: dict[str, list[float]]) -> DataFrame:
    """Long form ``(feature, idx, bound)`` of the bins; at most 7 x 6 rows."""
    rows = [(k, i, float(b)) for k, bounds in bins.items() for i, b in enumerate(bounds)]
    return spark.createDataFrame(rows, "feature string, idx int, bound double")


def persist_for_reuse(df: DataFrame) -> DataFrame:
    """Keep the app's samples between the bins pass and mining (spills to disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
