"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

**Features** of a whole text are shares and counts that its characters, words and lines give (``FEATURES``); nothing but the text
enters a score.  Each is cut into at most ``BINS`` bins at quantiles of the training rows.

**Model**: the log odds are a sum of lookup tables, one per feature and one per chosen pair of features.  Boosting goes through the features in
cycles: for each a tree of at most ``LEAVES`` leaves is fitted to the histogram of its bins (gradient and curvature of the logistic loss) and
added, shrunk by ``RATE``, to its table.  Then the pairs of which a depth-two tree on coarse bins would gain most get tables of their
own in the same way.  The number of cycles is the one of least loss on a part of the training rows (by a hash of their ids), and the
tables are then fitted to all of them.

**Training rows**: at most ``max_train`` labelled ids (smallest hashes; a documented bound), one row each.  Rows whose ``crc32(id) % folds`` is
0 are held out, their labels never read.

**Scoring** adds table entries by bin numbers, whole batches at a time, with the tables (some 100 KB) as a broadcast.

Nulls and odd input: a null text is empty (all features 0) and scored like any other; rows with a null id are scored, but
carry no label and are not held out; labels that are null are left out, of several labels of one id the least counts; of several texts of one
labelled id the one of least features trains; without labelled rows of both kinds the score is the rate of label 1 (0.5 without any); an
empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import doc_columns, hash_sample, map_arrow
from drainrules.session import materialize

MAX_TRAIN = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 64
PAIR_BINS = 12
LEAVES = 3
RATE = 0.1
CYCLES = 200
PAIRS = 10
LEAST_ROWS = 8.0  # training rows on either side of a cut
RIDGE = 1.0

FEATURES = (
    "words", "word_bytes", "longest_word", "capitals", "digits", "symbols", "exclamations", "stops", "other_marks", "wide_bytes",
    "control_bytes", "distinct_words", "repeated_neighbours", "distinct_pairs", "distinct_lines", "line_words", "markless_words",
)

_CLASSES = ("upper", "lower", "digits", "symbols", "exclaim", "stops", "marks", "wide", "control", "space")


def _byte_classes() -> np.ndarray:
    of = np.zeros((256, len(_CLASSES)))
    for name, chars in {
        "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": b"0123456789", "symbols": b"#*$%&|<>", "exclaim": b"!?",
        "stops": b".,;:", "marks": b"\"'()[]{}/\\=+-_~^@`", "wide": bytes(range(128, 256)), "control": bytes(set(range(32)) - set(range(9, 14))) + b"\x7f",
        "space": b" \t\n\x0b\x0c\r",
    }.items():
        of[list(chars), _CLASSES.index(name)] = 1
    return of


_OF_CLASS = _byte_classes()


def text_features(text: str) -> list[float]:
    """``FEATURES`` of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    upper, lower, digits, symbols, exclaim, stops, marks, wide, control, space = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _OF_CLASS
    wide_upper = sum(map(text.count, "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ")) if wide else 0
    chars = len(data) - space
    lines = [line for line in data.split(b"\n") if line.strip()]
    different = set(words)
    return [
        np.log1p(n), chars / n, np.log1p(max(map(len, different))), (upper + wide_upper) / max(1.0, upper + lower + wide / 2), digits / chars,
        symbols / n, exclaim / n, stops / n, marks / n, wide / chars, control / chars, len(different) / n, sum(map(eq, words, words[1:])) / n,
        len(set(pairwise(words))) / max(1, n - 1), len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(bytes.isalpha, words)) / n,
    ]


# ---------------------------------------------------------------- fitting
def _gain(g, h):
    return g * g / (h + RIDGE)


def line_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Steps per bin of a tree that cuts the bins into at most ``leaves`` runs, each cut the one that gains most."""
    cg, ch, cn = (np.concatenate(([0.0], np.cumsum(x))) for x in (g, h, n))
    runs = [(0, len(g))]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(runs):
            cuts = np.arange(a + 1, b)
            if not len(cuts):
                continue
            left_g, left_h, right_g, right_h = cg[cuts] - cg[a], ch[cuts] - ch[a], cg[b] - cg[cuts], ch[b] - ch[cuts]
            gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            gain[(cn[cuts] - cn[a] < LEAST_ROWS) | (cn[b] - cn[cuts] < LEAST_ROWS)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, int(cuts[at]))
        if best[1] is None:
            break
        a, b = runs.pop(best[1])
        runs += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def plane_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps per cell of the best tree of depth two: one cut along an axis, and one along the other on either side."""
    best_gain, best = 0.0, np.zeros(g.shape)
    whole = _gain(g.sum(), h.sum())
    for axis in (0, 1):
        tables = [x if axis == 0 else x.T for x in (g, h, n)]
        sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in tables]
        rows, columns = tables[0].shape
        if rows < 2 or columns < 2:
            continue
        sides = []
        for upper in (True, False):  # rows before the cut, rows after it
            g1, h1, n1 = ((s[1:rows] if upper else s[rows] - s[1:rows]) for s in sums)
            gain = _gain(g1[:, 1:-1], h1[:, 1:-1]) + _gain(g1[:, -1:] - g1[:, 1:-1], h1[:, -1:] - h1[:, 1:-1])
            gain = np.where((n1[:, 1:-1] < LEAST_ROWS) | (n1[:, -1:] - n1[:, 1:-1] < LEAST_ROWS), -np.inf, gain)
            at = gain.argmax(axis=1)
            sides.append((gain[np.arange(rows - 1), at], at + 1))
        total = sides[0][0] + sides[1][0] - whole
        cut = int(total.argmax())
        if total[cut] > best_gain:
            best_gain = float(total[cut])
            steps = np.zeros((rows, columns))
            for part, (_, at) in ((slice(0, cut + 1), sides[0]), (slice(cut + 1, rows), sides[1])):
                for cells in (slice(0, at[cut]), slice(at[cut], columns)):
                    steps[part, cells] = -tables[0][part, cells].sum() / (tables[1][part, cells].sum() + RIDGE)
            best = steps if axis == 0 else steps.T
    return best_gain, best


@dataclass
class Gam:
    edges: list[np.ndarray]  # per feature: inner edges of its bins
    coarse: list[np.ndarray]  # per feature: coarse bin of each bin
    bias: float
    lines: list[np.ndarray]
    planes: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.bias)
        for f, table in enumerate(self.lines):
            z += table[bins[:, f]]
        for (i, j), table in self.planes.items():
            z += table[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.bins(x)), -35, 35))) if len(x) else np.zeros(0)


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 edges, half-way between different values, at quantiles of the rows."""
    different, n = np.unique(values, return_counts=True)
    if len(different) < 2:
        return np.zeros(0)
    rank = np.cumsum(n)[:-1] / len(values) * bins
    last = np.flatnonzero(np.diff(np.floor(np.concatenate(([0], rank)))) > 0) if len(different) > bins else np.arange(len(different) - 1)
    return (different[last] + different[last + 1]) / 2


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean()) if len(y) else 0.0


def _boost(model: Gam, bins: np.ndarray, y: np.ndarray, cycles: int, keys: list, watch: tuple[np.ndarray, np.ndarray] | None) -> int:
    """Add ``cycles`` rounds of trees for ``keys`` (features or pairs) to the tables; the number of rounds of least loss on ``watch``."""
    at, seen_at, shapes = {}, {}, {}

    def cells(rows: np.ndarray, key) -> np.ndarray:
        if isinstance(key, int):
            return rows[:, key]
        i, j = key
        return model.coarse[i][rows[:, i]] * (int(model.coarse[j].max()) + 1) + model.coarse[j][rows[:, j]]

    for key in keys:
        table = model.lines[key] if isinstance(key, int) else model.planes[key]
        at[key], shapes[key] = cells(bins, key), table.shape
        if watch is not None:
            seen_at[key] = cells(watch[0], key)
    counts = {key: np.bincount(at[key], minlength=int(np.prod(shapes[key]))).astype(float) for key in keys}
    z = model.log_odds(bins)
    seen = model.log_odds(watch[0]) if watch is not None else None
    best, best_cycle = (_loss(seen, watch[1]) if watch is not None else 0.0), 0
    for cycle in range(1, cycles + 1):
        for key in keys:
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            size = len(counts[key])
            g = np.bincount(at[key], p - y, size)
            h = np.bincount(at[key], p * (1 - p), size)
            if isinstance(key, int):
                step = line_tree(g, h, counts[key])
                model.lines[key] += RATE * step
            else:
                _, step = plane_tree(*(v.reshape(shapes[key]) for v in (g, h, counts[key])))
                model.planes[key] += RATE * step
                step = step.reshape(-1)
            z = z + RATE * step[at[key]]
            if watch is not None:
                seen = seen + RATE * step[seen_at[key]]
        if watch is not None:
            now = _loss(seen, watch[1])
            if now < best - 1e-6:
                best, best_cycle = now, cycle
            elif cycle - best_cycle >= 30:
                break
    return best_cycle


def _start(edges: list[np.ndarray], coarse: list[np.ndarray], y: np.ndarray) -> Gam:
    rate = (y.sum() + 0.5) / (len(y) + 1)
    return Gam(edges, coarse, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], {})


def fit_gam(x: np.ndarray, y: np.ndarray, part: np.ndarray, cycles: int = CYCLES, pairs: int = PAIRS) -> Gam:
    """Fit the tables; rows with ``part`` 0 choose the numbers of cycles and the pairs."""
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    coarse = [(np.arange(len(e) + 1) * min(PAIR_BINS, len(e) + 1)) // (len(e) + 1) for e in edges]
    model = _start(edges, coarse, y)
    if y.min(initial=1) == y.max(initial=0):
        return model
    bins, keys = model.bins(x), [f for f in range(x.shape[1]) if len(edges[f])]
    train, watch = part != 0, part == 0
    if not train.any() or not watch.any() or y[train].min() == y[train].max():
        _boost(model, bins, y, cycles // 4, keys, None)
        return model
    trial = _start(edges, coarse, y[train])
    best = _boost(trial, bins[train], y[train], cycles, keys, (bins[watch], y[watch]))
    lines_only = _start(edges, coarse, y)
    _boost(lines_only, bins, y, best, keys, None)
    p = 1 / (1 + np.exp(-np.clip(lines_only.log_odds(bins), -35, 35)))
    gains = []
    for i, j in combinations(keys, 2):
        shape = (int(coarse[i].max()) + 1, int(coarse[j].max()) + 1)
        cell = coarse[i][bins[:, i]] * shape[1] + coarse[j][bins[:, j]]
        tables = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p), np.ones(len(y)))]
        gains.append((plane_tree(*tables)[0], i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:pairs]]
    checked = _start(edges, coarse, y[train])
    _boost(checked, bins[train], y[train], best, keys, None)
    for m in (checked, lines_only):
        m.planes = {(i, j): np.zeros((int(coarse[i].max()) + 1, int(coarse[j].max()) + 1)) for i, j in chosen}
    more = _boost(checked, bins[train], y[train], cycles, chosen, (bins[watch], y[watch])) if chosen else 0
    _boost(lines_only, bins, y, more, chosen, None)
    return lines_only


# ---------------------------------------------------------------- on Spark
def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _features(docs: DataFrame) -> DataFrame:
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return map_arrow(docs, take, "doc_id long, x array<double>")


def fit_quality_gam(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, max_train: int = MAX_TRAIN) -> Gam:
    """Fit on labelled documents whose ``crc32(id) % folds`` is not 0."""
    texts = doc_columns(docs)
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.min((F.col("y") != 0).cast("int")).alias("y"))
    )
    chosen = materialize(hash_sample(marked.join(texts.select("doc_id"), "doc_id", "left_semi"), max_train, F.xxhash64("doc_id"), "doc_id"), "gam-ids")
    # At most max_train ids: a bounded broadcast, and one row of each comes to the driver.
    some = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = _features(some).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    part = np.array([zlib.crc32(f"part {d}".encode()) % 5 for d in rows["doc_id"]], dtype=np.int64)
    return fit_gam(x, rows["y"].to_numpy(dtype=float), part)


def score_quality(docs: DataFrame, model: Gam, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = map_arrow(doc_columns(docs), score, "doc_id long, score double, predicted int")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
