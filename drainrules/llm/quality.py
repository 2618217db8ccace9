"""Quality rules judged by an isolation forest over rule statistics.

**Statistics** of a whole text: words ``[^\\x20\\x09-\\x0D]+``, their code points, symbol characters, repeated
lines, words inside repeated 5-word windows; beside these, counts of capital letters, of
digits and of other characters for shares that the rules speak of.  ``base_failed`` holds for
texts of under ``MIN_WORDS`` words or with over ``MAX_REPEAT_PERCENT`` % repeated words.

**Forest.**  Shares of those counts (``FEATURES``) of ``trees * rows_per_tree`` documents (the smallest
hashes of their ids: a bounded sample, as the method itself asks for small samples per tree)
that did not fail the base rules.  Each tree splits its rows at random features and
values; anomalies end after few splits.  The score is the usual ``2 ** (-mean path / c(rows))``.

**Rules and thresholds.**  Of the splits on a document's paths, those that leave it on the smaller
side isolate it; the feature with the largest ``log2(rows before / rows after)`` in sum is the
rule its anomaly is put down to.  Labelled rows then calibrate one score threshold per rule: the one that
rejects most bad rows less ``good_weight`` times the good ones.  A rule under which no threshold
comes out at ``LEAST_GAIN`` or more, or without labelled rows, rejects nothing.  All labelled rows count; the
driver receives them as a histogram of (rule, score bin).

Nulls and odd input: a null text is empty (no words: it fails the base rules); null ids are rows
like any other, but carry no label; a document with several label rows counts once for each
different value; labels that are null are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drainrules.llm.common import doc_columns, hash_sample, map_arrow
from drainrules.session import materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
TREES = 100
ROWS_PER_TREE = 256
SCORE_BINS = 200
GOOD_WEIGHT = 3.0
LEAST_GAIN = 3.0
SEED = 11

SYMBOLS = "#*$%&|<>"  # fixed by the contract of the rule
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
FEATURES = ("symbols_per_word", "capitals", "digits", "marks_per_word", "dup_lines", "repeat_words")

_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[!?;:=_/\\~^@+{}\[\]\"]")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def rule_counts(text: str) -> tuple[int, ...]:
    """``COUNTS`` of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        once: set = set()
        twice = {w for w in windows if w in once or once.add(w)}
        end = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return (
        n, len(text) - spaces, len(_SYMBOL.findall(text)), dup, repeated, lines,
        len(_UPPER.findall(text)), len(_DIGIT.findall(text)), len(_MARK.findall(text)),
    )


def base_fails(n_words, n_repeat_words):
    """The base rules, for numbers, arrays or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def features(counts: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``COUNTS``."""
    n, chars, symbols, dup, repeat, lines, upper, digits, marks = counts.T.astype(float)
    n, chars, lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack((symbols / n, upper / chars, digits / chars, marks / n, dup / lines, repeat / n), axis=1)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rule_counts(t) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS])

    return map_arrow(doc_columns(docs), count, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)]))


def _mean_path(n):
    """Mean depth of a row in a random tree of n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays, a row per node: feature (-1: leaf), value, children, path length, credits by feature."""

    trees: list[tuple[np.ndarray, ...]]
    rows_per_tree: int
    thresholds: np.ndarray | None = None  # by feature

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the feature each row's anomaly is put down to."""
        path, credit = np.zeros(len(x)), np.zeros((len(x), len(FEATURES)))
        rows = np.arange(len(x))
        for feature, value, left, right, depth, credits in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] < value[node], left[node], right[node])
                node = np.where(f < 0, node, down)
            path += depth[node]
            credit += credits[node]
        score = 2 ** (-path / max(1, len(self.trees)) / max(float(_mean_path(self.rows_per_tree)), 1e-9))
        return score, credit.argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        score, rule = self.judge(x)
        return score >= self.thresholds[rule]


def _tree(x: np.ndarray, rng: np.random.Generator, most: int) -> tuple[np.ndarray, ...]:
    feature, value, left, right, depth, credits = [], [], [], [], [], []

    def grow(rows: np.ndarray, level: int, credit: np.ndarray) -> int:
        at = len(feature)
        for column, v in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (depth, level + float(_mean_path(len(rows)))), (credits, credit)):
            column.append(v)
        low, high = rows.min(axis=0), rows.max(axis=0)
        can = np.flatnonzero(high > low)
        if level >= most or not len(can):
            return at
        f = int(rng.choice(can))
        cut = rng.uniform(low[f], high[f])
        below = rows[:, f] < cut
        if not below.any():  # the draw fell on the lowest value itself
            cut = np.nextafter(low[f], high[f])
            below = rows[:, f] < cut
        sides = []
        for side in (rows[below], rows[~below]):
            more = credit.copy()
            if 2 * len(side) < len(rows):
                more[f] += np.log2(len(rows) / len(side))
            sides.append(grow(side, level + 1, more))
        feature[at], value[at], left[at], right[at] = f, cut, *sides
        return at

    grow(x, 0, np.zeros(len(FEATURES)))
    return tuple(np.array(c) for c in (feature, value, left, right, depth, credits))


def fit_forest(x: np.ndarray, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = SEED) -> Forest:
    """A forest over sampled rows, dealt to the trees at random."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return Forest([], rows_per_tree)
    size = min(rows_per_tree, len(x))
    most = int(np.ceil(np.log2(max(2, size))))
    return Forest([_tree(x[rng.choice(len(x), size, replace=False)], rng, most) for _ in range(trees)], size)


def calibrate(histogram: list[tuple[int, int, int, int]], good_weight: float = GOOD_WEIGHT) -> np.ndarray:
    """One threshold per feature from rows ``(feature, score bin, good rows, bad rows)``."""
    thresholds = np.full(len(FEATURES), np.inf)
    for f in range(len(FEATURES)):
        best, total = LEAST_GAIN, 0.0
        for _, score_bin, good, bad in sorted((h for h in histogram if h[0] == f), key=lambda h: -h[1]):
            total += bad - good_weight * good
            if total >= best and total > 0:
                best, thresholds[f] = total, score_bin / SCORE_BINS
    return thresholds


def _with_verdict(stats: DataFrame, forest: Forest, scores: bool) -> DataFrame:
    """Statistics with score, rule and verdict of the forest."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in COUNTS], axis=1))
            score, rule = shared.value.judge(x)
            more = [pa.array(score), pa.array(rule.astype(np.int32))]
            names = ["score", "rule"]
            if not scores:
                more.append(pa.array(score >= shared.value.thresholds[rule]))
                names.append("rejected")
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    more = [T.StructField("score", T.DoubleType()), T.StructField("rule", T.IntegerType()), T.StructField("rejected", T.BooleanType())]
    return map_arrow(stats, judge, T.StructType([*stats.schema.fields, *(more[:2] if scores else more)]))


def fit_quality(
    stats: DataFrame, labels: DataFrame, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, good_weight: float = GOOD_WEIGHT, seed: int = SEED
) -> Forest:
    """Fit the forest and calibrate its thresholds.  ``stats`` should be a stored table."""
    passed = stats.where(~base_fails(F.col("n_words"), F.col("n_repeat_words")))
    sample = hash_sample(passed, trees * rows_per_tree, F.xxhash64("doc_id", F.lit(seed)), *COUNTS).select(*COUNTS).toPandas()
    forest = fit_forest(features(sample.to_numpy(dtype=np.int64).reshape(-1, len(COUNTS))), trees, rows_per_tree, seed)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good")).where("good is not null").distinct()
    judged = _with_verdict(passed.select("doc_id", *COUNTS).join(marked, "doc_id"), forest, scores=True)
    histogram = (
        judged.groupBy("rule", F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"))
        .agg(F.sum((F.col("good") != 0).cast("int")).alias("g"), F.sum((F.col("good") == 0).cast("int")).alias("b"))
        .collect()
    )
    forest.thresholds = calibrate([(r["rule"], r["bin"], r["g"], r["b"]) for r in histogram], good_weight)
    return forest


def judge_quality(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """``doc_id``, ``COUNTS``, ``base_failed``, ``score``, ``rule`` (the feature's name) and ``kept`` of every document."""
    stats = materialize(rule_statistics(docs), "quality-stats")
    forest = fit_quality(stats, labels, **parameters)
    names = F.array(*[F.lit(f) for f in FEATURES])
    failed = base_fails(F.col("n_words"), F.col("n_repeat_words"))
    return (
        _with_verdict(stats, forest, scores=False)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
        .withColumn("rule", F.element_at(names, F.col("rule") + 1))
        .drop("rejected")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all their columns, that pass the base rules and the forest."""
    forest = fit_quality(materialize(rule_statistics(docs), "quality-stats"), labels, **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([rule_counts(t or "") for t in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            kept = ~base_fails(counts[:, 0], counts[:, 4]) & ~shared.value.rejects(features(counts))
            yield batch.filter(pa.array(kept))

    return map_arrow(docs, keep, docs.schema)
