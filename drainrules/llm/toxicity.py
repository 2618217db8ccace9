"""Toxicity categories by a classifier chain of linear models.

The categories come in a fixed order.  The model of a category sees the words of a text and the first
letters that one, two or three of its longer words share (present or not) and the probabilities of all earlier categories.  In training these are **out of fold**: the
labelled sample is cut into ``folds`` parts by a hash of the id, and a row's probability comes from
a model fitted without its part, so a later model learns from inputs as good as it will
get for new texts.  For new texts the models fitted on the whole sample are chained.

Training takes at most ``max_train`` labelled rows (the smallest hashes of their ids; a documented
bound), from which Spark counts words per category, and the ``words_per_category`` words of highest
chi-square each (``MIN_CHI_SQUARE`` or more), seen in ``min_docs`` rows and ``MIN_SHARE`` of all or more, become features.  The models are logistic
regressions with an L2 penalty, fitted by Newton's method.  The decision threshold of the target category maximises
F1 over the out-of-fold probabilities of the sample.

Scoring is one pass over the documents with the small model as a broadcast; a whole text counts.

Nulls and odd input: a null text is empty; rows with null ids are scored but carry no
label; null labels are left out; of several label rows of one id each category takes the
largest value; of several texts of one id one trains; a category without both values in the sample gets its constant rate; without any
labelled row no text is toxic; an empty table gives no rows; other columns are left behind by
``score_toxicity`` and kept by ``keep_nontoxic``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import doc_columns, hash_sample, map_arrow
from drainrules.session import materialize

MAX_TRAIN = 10_000
WORDS_PER_CATEGORY = 150
MIN_DOCS = 5
MIN_SHARE = 0.002  # of the sample's rows
MIN_CHI_SQUARE = 25.0  # words this far from chance; many words are tried at once
FOLDS = 5
PENALTY = 0.3
STEMS = (5, 7)  # leading letters of longer words
STEM_COUNTS = (1, 2, 3)  # a stem of so many different words is a word of its own

_WORDS = re.compile(r"[^\W_]+")


def text_words(text: str) -> set[str]:
    """The different words of a text, and the stems of its longer words with how many of them share it."""
    words = set(_WORDS.findall(text.lower()))
    stems = Counter([w[:n] for n in STEMS for w in words if len(w) > n])
    return words | {f"{s}*{k}" for s, n in stems.items() for k in STEM_COUNTS if k <= n}


@dataclass
class Chain:
    categories: tuple[str, ...]
    words: dict[str, int]
    weights: list[np.ndarray]  # per category: bias, words, earlier probabilities
    target: int
    threshold: float

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.categories)))
        known = self.words
        for i, text in enumerate(texts):
            found = [known[w] + 1 for w in text_words(text) & known.keys()]
            for c, w in enumerate(self.weights):
                z = w[0] + w[found].sum() + w[1 + len(known) :] @ out[i, :c]
                out[i, c] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out

    def toxic(self, p: np.ndarray) -> np.ndarray:
        return p[:, self.target] >= self.threshold


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 25) -> np.ndarray:
    """Weights (the bias first, not penalised) of an L2 logistic regression, by damped Newton steps."""
    x = np.hstack((np.ones((len(x), 1), dtype=x.dtype), x)).astype(float)
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = np.log(rate / (1 - rate))
    if y.min(initial=1) == y.max(initial=0):
        return w
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (v * v))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        was, now = now, loss(w)
        if abs(was - now) < 1e-7 * max(1.0, abs(was)):
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, penalty: float = PENALTY) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per category, and the out-of-fold probabilities ``(rows, categories)``."""
    inner, weights = np.zeros(y.shape), []

    def predict(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(w[0] + rows @ w[1:], -35, 35)))

    for c in range(y.shape[1]):
        seen = np.hstack((x, inner[:, :c]))
        weights.append(logistic(seen, y[:, c], penalty))
        for k in np.unique(fold):
            out = fold == k
            inner[out, c] = predict(logistic(seen[~out], y[~out, c], penalty) if (~out).any() else weights[c], seen[out])
    return weights, inner


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of highest F1, half-way to the next lower probability; over 1 where no row is positive."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # only between different probabilities
    at = int(f1.argmax())
    return float(p[at] + p[at + 1]) / 2 if at + 1 < len(p) else float(p[at])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    target: str,
    max_train: int = MAX_TRAIN,
    words_per_category: int = WORDS_PER_CATEGORY,
    min_docs: int = MIN_DOCS,
    folds: int = FOLDS,
    penalty: float = PENALTY,
) -> Chain:
    """Fit a chain; ``categories`` gives a 0/1 column of ``labels`` per category, in chain order."""
    names = tuple(categories)
    marks = [F.max(c.cast("int")).alias(f"c{i}") for i, c in enumerate(categories.values())]
    columns = [f"c{i}" for i in range(len(names))]
    rows = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks).dropna()
    texts = doc_columns(docs)
    chosen = hash_sample(rows.join(texts.select("doc_id"), "doc_id", "left_semi"), max_train, F.xxhash64("doc_id"), "doc_id")
    # At most max_train ids: a bounded broadcast.
    sample = texts.join(F.broadcast(chosen), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(text_words(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            keys = pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, found, *batch.columns[2:]], names=["doc_id", "h", "words", *columns])

    schema = "doc_id long, h long, words array<string>, " + ", ".join(f"{c} int" for c in columns)
    # Of several texts of one id one trains (that of the smallest hash), so max_train bounds the rows, too.
    one = F.min(F.struct("h", "words", *columns)).alias("r")
    bags = materialize(map_arrow(sample, words, schema).groupBy("doc_id").agg(one).select("doc_id", "r.*"), "toxicity-bags")
    sums = bags.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).first()
    n, positive = sums["n"], [sums[c] or 0 for c in columns]
    counts = (
        bags.select(F.explode("words").alias("word"), *columns)
        .groupBy("word")
        .agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in columns])
        .where(F.col("df") >= max(min_docs, MIN_SHARE * n))
    )
    best: set[str] = set()
    for c, pos in zip(columns, positive, strict=True):
        if 0 < pos < n:
            expected = F.col("df") * F.lit(pos / n)
            chi = (F.col(c) - expected) ** 2 / (expected * F.lit(1 - pos / n) * (1 - F.col("df") / F.lit(n)) + F.lit(1e-9))
            best |= {r["word"] for r in counts.where(chi >= MIN_CHI_SQUARE).orderBy(chi.desc(), "word").limit(words_per_category).select("word").collect()}
    features = sorted(best)
    known = {w: i for i, w in enumerate(features)}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[shared.value[w] for w in ws if w in shared.value] for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), *batch.columns[3:]], names=["doc_id", "h", "f", *columns])

    got = map_arrow(bags, present, schema.replace("words array<string>", "f array<int>")).toPandas().sort_values(["doc_id", "h"], kind="stable")
    x = np.zeros((len(got), len(features)), dtype=np.float32)
    for i, f in enumerate(got["f"]):
        x[i, np.asarray(f, dtype=np.int64)] = 1
    y = got[columns].to_numpy(dtype=float).reshape(len(got), len(columns))
    fold = np.array([zlib.crc32(str(d).encode()) % folds for d in got["doc_id"]])
    weights, inner = fit_chain(x, y, fold, penalty)
    at = names.index(target)
    return Chain(names, known, weights, at, best_threshold(inner[:, at], y[:, at]))


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, ``p_<category>`` of each category and ``toxic`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{c}" for c in chain.categories), "toxic"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T), pa.array(shared.value.toxic(p))], names=names)

    return map_arrow(doc_columns(docs), score, ", ".join(["doc_id long", *(f"{n} double" for n in names[1:-1]), "toxic boolean"]))


def keep_nontoxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~shared.value.toxic(shared.value.probabilities([t or "" for t in batch.column(at).to_pylist()]))))

    return map_arrow(docs, keep, docs.schema)
