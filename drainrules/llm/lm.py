"""Scores of texts by a byte model with context-tree weighting, learnt from a part of the documents.

**Training.**  Tasks count the bytes of whole lower-cased texts under the ``depth`` bytes before them, and Spark
sums the counts of all tasks.  Every context that was met is a node of the model, so it grows with the input.  The
levels are weighed two at a time from the longest contexts to the empty one, and the mixtures passed down
again: rows are dealt by the context all of them share, and a task weighs whole contexts, some at a
time (``ctw.climb``, ``ctw.descend``).  Only contexts of at most two bytes meet in one task.  The result is
the log probability of every byte after every ``depth`` bytes that stand in any text.

**Score.**  The sum of these over a text.  The ``hot_grams`` most frequent ones are a shared file that each Python worker reads once, summed where the text is read;
all others are joined by shuffle.  Both give the same sums.

**Base score.**  Words ``[^\\x20\\x09-\\x0D]+`` and one end per text, each ``log10((c + 1) / (N + V + 1))`` from the training
tokens.  Words with ``c >= N / HOT_WORDS`` (so at most ``HOT_WORDS`` of them) are a broadcast, summed where the
text is read; only the other words of a text are joined with the word counts by shuffle.
So no join key is frequent, and no table without a bound is broadcast.

Nulls and odd input: a null text is empty (its only token is the end); a null id is never held out;
repeated rows each get their row; without training texts every token has probability
``1 / (0 + 0 + 1)`` and the byte model is uniform; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import blocks_of, doc_columns, map_arrow, shared_filesystem
from drainrules.llm.ctw import Tree, climb, descend, gram_codes, leaf_nodes, path_log10, weigh
from drainrules.session import materialize, scratch_path

DEPTH = 6
SHARE = 1e-5
HOT_WORDS = 1 << 18
HOT_GRAMS = 1 << 21
COUNT_BYTES = 8 << 20  # bytes of text that a task counts at once
COUNT_ROWS = 5 << 19  # counts that a task holds back
SCORE_BYTES = 1 << 20  # bytes of text whose grams a task looks up at once
WEIGH_ROWS = 1 << 18  # rows that a task weighs at once, or one context's where it has more
DEAL_ROWS = 1 << 17  # rows that a task weighs, about


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls on the fold that is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word binary, c long``: all words of a column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.encode("utf-8", "surrogatepass").lower().split())
                if len(held) >= 200_000:
                    yield rows()
        yield rows()

    return map_arrow(texts, count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def summed(held: list[np.ndarray], found: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of ``[sorted codes, counts...]``, each code once; a column at a time, ``held`` is emptied."""
    place = np.searchsorted(held[0], found[0])
    known = held[0][np.minimum(place, len(held[0]) - 1)] == found[0]
    for mine, more in zip(held[1:], found[1:], strict=True):
        mine[place[known]] += more[known]
    new = ~known
    at = place[new] + np.arange(np.count_nonzero(new))
    old = np.ones(len(held[0]) + len(at), dtype=bool)
    old[at] = False
    out = []
    for more in found:
        column = np.empty(len(old), dtype=more.dtype)
        column[old] = held.pop(0)
        column[at] = more[new]
        out.append(column)
    return out


def count_marked(marked: np.ndarray) -> list[np.ndarray]:
    """Different codes, how often each stands unmarked, and at all; the lowest bit is the mark (the input is sorted in place)."""
    marked.sort()
    new = np.ones(len(marked), dtype=bool)
    for i in range(1, len(marked), 1 << 18):
        part = marked[i - 1 : i + (1 << 18)]
        np.greater(part[1:] ^ part[:-1], 1, out=new[i : i + (1 << 18)])
    first = np.flatnonzero(new)
    codes = (marked[first] >> np.uint64(1)).view(np.int64)
    marked &= np.uint64(1)
    seen = np.diff(np.append(first, len(marked)))
    return [codes, seen - np.add.reduceat(marked, first).view(np.int64), seen]


def count_grams(batches: Iterator[pa.RecordBatch], depth: int, count_bytes: int, count_rows: int) -> Iterator[pa.RecordBatch]:
    """``code, n, seen`` of the bytes of ``(text, held_out)`` rows; ``count_bytes`` are counted at once, about ``count_rows`` counts held."""
    texts: list[bytes] = []
    marks: list[bool] = []
    counts: list[list[np.ndarray]] = []
    size = 0

    def add() -> None:
        codes = gram_codes(texts, depth)
        codes <<= np.uint64(1)
        codes |= np.repeat(np.array(marks, dtype=np.uint8), [len(t) + 1 for t in texts])
        texts.clear()
        marks.clear()
        found = count_marked(codes)
        del codes
        counts.append(summed(counts.pop(), found) if counts else found)

    def rows() -> Iterator[pa.RecordBatch]:
        for found in counts:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["code", "n", "seen"])
            yield from (batch.slice(i, 1 << 16) for i in range(0, batch.num_rows, 1 << 16))
        counts.clear()

    for batch in batches:
        for text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass").lower()
            texts.append(data)
            marks.append(out)
            size += len(data) + depth + 1
            if size >= count_bytes:
                add()
                size = 0
                if len(counts[0][0]) > count_rows:
                    yield from rows()
    if texts:
        add()
    yield from rows()


def gram_counts(texts: DataFrame, depth: int) -> DataFrame:
    """``code long, n long, seen long``: all bytes of the texts of ``(text, held_out)`` under the ``depth`` bytes before them.

    ``seen`` counts all texts, ``n`` those that are learnt from.  A task adds up its counts while they are at most
    ``COUNT_ROWS``, so they are dealt by code before Spark sums them.
    """
    counted = map_arrow(texts, lambda batches: count_grams(batches, depth, COUNT_BYTES, COUNT_ROWS), "code long, n long, seen long")
    return counted.repartition("code").groupBy("code").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


NODES = "key long, zeros long, ones long, product double"
MIXED = "key long, fixed double, free double, last double"


def whole_contexts(batches: Iterator[pa.RecordBatch], rows: int = WEIGH_ROWS) -> Iterator[list[np.ndarray]]:
    """The columns after the first of sorted batches, in runs of about ``rows`` rows that end where the first column changes."""
    held: list[pa.RecordBatch] = []
    n, limit = 0, rows

    def columns(table: pa.Table) -> list[np.ndarray]:
        return [c.to_numpy() for c in table.columns[1:]]

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            table = pa.Table.from_batches(held)
            shared = table.column(0).to_numpy()
            cut = int(np.searchsorted(shared, shared[-1]))
            if cut:
                yield columns(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            n -= cut
            limit = max(rows, 2 * n)
    if n:
        yield columns(pa.Table.from_batches(held))


def _dealt(rows: DataFrame, shared: int) -> DataFrame:
    """Rows with ``key`` dealt, ``DEAL_ROWS`` a task, and sorted by the last ``shared`` bytes of its context."""
    context = F.shiftright("key", 8).bitwiseAND((1 << 8 * shared) - 1)
    dealt = rows.select(context.alias("shared"), *rows.columns)
    return (dealt.repartition(blocks_of(rows.count(), DEAL_ROWS), "shared") if shared else dealt.repartition(1)).sortWithinPartitions("shared")


def _batch(columns: tuple[np.ndarray, ...], schema: str) -> pa.RecordBatch:
    kinds = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if kind == "long" else pa.float64()) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[name for name, _ in kinds]
    )


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """``code long, seen long, log_p double``: log10 probability of the last byte of each code after the bytes before it."""
    spans = [(min(depth, 2), 0), *((min(depth, low + 1), low) for low in (3, 5) if depth >= low)]
    no_mixture = {name: F.lit(0.0) for name in ("fixed", "free", "last")}

    def sort_leaves(codes: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(codes)
        return [c[order] for c in (codes, *counts)]

    def start(keys: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(np.unique(keys))
        return np.zeros(n), np.ones(n), np.full(n, 0.5)

    def up(rows: DataFrame, deepest: int, shortest: int) -> DataFrame:
        leaf = deepest == depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, zeros, ones, product in whole_contexts(batches):
                if leaf:
                    keys, zeros, ones, _ = leaf_nodes(*sort_leaves(keys, zeros))
                yield _batch(climb(keys, zeros, ones, None if leaf else product, deepest, shortest)[1], NODES)

        return map_arrow(_dealt(rows, shortest - 1), run, NODES)

    def down(rows: DataFrame, mixed: DataFrame | None, deepest: int, shortest: int) -> DataFrame:
        """Mixtures of the nodes of ``rows``; for the leaves, the scores of their codes."""
        leaf, top_span = deepest == depth, mixed is None
        out = "code long, seen long, log_p double" if leaf else MIXED

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, zeros, ones, product, fixed, free, last in whole_contexts(batches):
                given = last == 0  # no estimate is
                above = keys[~given]
                codes, zeros, ones, product = keys[given], zeros[given], ones[given], product[given]
                if leaf:
                    codes, n, seen = sort_leaves(codes, zeros, ones)
                    keys, zeros, ones, places = leaf_nodes(codes, n)
                else:
                    keys = codes
                levels, (top, *_) = climb(keys, zeros, ones, None if leaf else product, deepest, shortest)
                if top_span:
                    before = start(top)
                else:
                    order = np.argsort(above)
                    at = order[np.searchsorted(above, top, sorter=order)]
                    before = tuple(v[~given][at] for v in (fixed, free, last))
                fixed, free, last = descend(levels, *before)
                if leaf:
                    yield _batch((codes, seen, path_log10(codes, places, fixed + free * last)), out)
                else:
                    yield _batch((keys, fixed, free, last), out)

        both = rows.withColumns(no_mixture)
        if mixed is not None:
            zero = F.lit(0).cast("long")
            both = both.unionByName(mixed.select("key", zero.alias("zeros"), zero.alias("ones"), F.lit(0.0).alias("product"), "fixed", "free", "last"))
        return map_arrow(_dealt(both, max(0, shortest - 1)), run, out)

    # the leaves: n stands as zeros, seen as ones
    rows = {spans[-1]: grams.select(F.col("code").alias("key"), F.col("n").alias("zeros"), F.col("seen").alias("ones"), F.lit(0.0).alias("product"))}
    for span, above in zip(spans[:0:-1], spans[-2::-1], strict=True):
        rows[above] = materialize(up(rows[span], *span), "lm-nodes")
    mixed = None
    for span in spans:
        mixed = materialize(down(rows[span], mixed, *span), "lm-mixtures")
    return mixed


def fit_tree(texts: DataFrame, depth: int = DEPTH, share: float = SHARE) -> Tree:
    """A byte model for one process, from a column of texts: contexts under ``share`` of all bytes are pooled (``score_texts`` pools none)."""
    if not 0 <= depth <= 6:
        raise ValueError("a context and its byte must fit in a long: at most 6 bytes of context")
    grams = materialize(gram_counts(texts.select("text", F.lit(False).alias("held_out")), depth).select("code", "n"), "lm-grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth, -1, -1):
        if d < depth:
            grams = materialize(grams.groupBy(F.col("code").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("code")).agg(F.sum("n").alias("n")), "lm-grams")
        kept = (
            grams.groupBy(F.shiftright("code", 8).alias("context"))
            .agg(F.sum("n").alias("t"), F.collect_list(F.struct(F.col("code").bitwiseAND(255).cast("int").alias("byte"), "n")).alias("f"))
            .where(F.col("t") >= share * total)
            .select("context", F.explode("f").alias("f"))
            .select("context", "f.byte", "f.n")
            .toPandas()
        )
        codes, at = np.unique(kept["context"].to_numpy(dtype=np.uint64), return_inverse=True)
        counts = np.zeros((len(codes), 256), dtype=np.uint32 if total < 1 << 32 else np.int64)
        counts[at, kept["byte"].to_numpy(dtype=np.int64)] = kept["n"]
        levels.append((codes, counts))
    levels.reverse()
    if not len(levels[0][0]):
        levels[0] = (np.zeros(1, dtype=np.uint64), np.zeros((1, 256), dtype=np.uint32))
    return weigh(levels)


def store_frequent(scored: DataFrame, at_most: int) -> tuple[int, str]:
    """``(bar, folder)``: the codes seen at least ``bar`` times, at most ``at_most`` of them, are written to the shared folder."""
    often = scored.groupBy(F.least("seen", F.lit(1 << 20)).alias("seen")).count().toPandas().sort_values("seen", ascending=False)
    fit = often[often["count"].cumsum() <= at_most]
    bar = int(fit["seen"].min()) if len(fit) else (1 << 63) - 1
    folder = scratch_path(scored.sparkSession, "lm-hot")
    scored.where(F.col("seen") >= bar).select("code", "log_p").write.parquet(folder)
    return bar, folder


@functools.lru_cache(maxsize=1)
def frequent(folder: str) -> tuple[pd.Index, np.ndarray]:
    """Codes (hashed by pandas) and their log probabilities, with a 0 for all others at the end, read once per Python worker."""
    system, root = shared_filesystem(folder)
    parts = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(p, filesystem=system, use_threads=False) for p in sorted(parts)]
    codes = np.concatenate([np.zeros(0, dtype=np.int64), *(t.column("code").to_numpy() for t in tables)])
    log_p = np.concatenate([*(t.column("log_p").to_numpy() for t in tables), np.zeros(1)])
    return pd.Index(codes), log_p


def hot_sums(texts: list[bytes], depth: int, hot: pd.Index, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text, the sum of ``log_p`` of its hot codes; its other codes, and how many they are."""
    codes = gram_codes(texts, depth).astype(np.int64)
    place = hot.get_indexer(codes)
    other = place < 0
    log = log_p[place]  # -1, where a code is not hot, is the 0 at the end
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.add.reduceat(log, starts), codes[other], np.add.reduceat(other.astype(np.int64), starts)


def score_texts(
    docs: DataFrame, is_held_out: Column | None = None, depth: int = DEPTH, share: float | None = None, hot_words: int = HOT_WORDS, hot_grams: int = HOT_GRAMS
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``hot_grams`` and ``hot_words`` (and ``share``: then at most ``1 / share`` grams are hot) only say what is summed without a join.
    """
    if not 0 <= depth <= 6:
        raise ValueError("a context and its byte must fit in a long: at most 6 bytes of context")
    out = held_out(F.col("doc_id")) if is_held_out is None else is_held_out
    texts = doc_columns(docs).select("doc_id", "text", out.alias("held_out"))
    training = texts.where(~F.col("held_out"))
    grams = gram_scores(materialize(gram_counts(texts.select("text", "held_out"), depth), "lm-grams"), depth)
    bar, folder = store_frequent(grams, hot_grams if share is None else min(hot_grams, int(1 / share)))
    words = materialize(word_counts(training.select("text")), "lm-words")
    ends = training.count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train = sums["n"] + ends
    log_all = math.log10(n_train + sums["v"] + (ends > 0) + 1)
    frequent_words = words.where(F.col("c") * hot_words >= n_train).toPandas()  # at most hot_words rows
    hot = dict(zip(map(bytes, frequent_words["word"]), frequent_words["c"].tolist(), strict=True))
    sc = docs.sparkSession.sparkContext
    shared_hot = sc.broadcast(hot)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_codes, hot_log = frequent(folder)
        logs = {w: math.log10(c + 1) for w, c in shared_hot.value.items()}
        end_log = math.log10(ends + 1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            held: list[bytes] = []
            size = 0
            sums = []
            for text in batch.column(1).to_pylist():
                data = text.encode("utf-8", "surrogatepass").lower()
                held.append(data)
                size += len(data) + depth + 1
                if size >= SCORE_BYTES:
                    sums.append(hot_sums(held, depth, hot_codes, hot_log))
                    held, size = [], 0
                known, log_sum, rare, rare_n, n = (1, end_log, [], [], 1) if ends else (0, end_log, [], [], 1)
                for w, k in Counter(data.split()).items():
                    n += k
                    log = logs.get(w)
                    if log is None:
                        rare.append(w)
                        rare_n.append(k)
                    else:
                        known += k
                        log_sum += k * log
                for column, value in zip(columns, (row, n, known, log_sum, rare, rare_n), strict=True):
                    column.append(value)
                row += 1
            if held:
                sums.append(hot_sums(held, depth, hot_codes, hot_log))
            if not sums:
                continue
            score, others, n_others = (np.concatenate(c) for c in zip(*sums, strict=True))
            rare_grams = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_others))), pa.int32()), pa.array(others))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(score), rare_grams],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "log_sum", "rare", "rare_n", "score", "rare_grams"],
            )

    schema = (
        "doc_id long, held_out boolean, row long, n_tokens long, known long, log_sum double, "
        "rare array<binary>, rare_n array<long>, score double, rare_grams array<long>"
    )
    scored = materialize(map_arrow(texts, read, schema, looks_up=True), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    seen = words.where(F.col("c") * hot_words < n_train)
    more = rare.join(seen, "word").groupBy("row").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rare_log"))
    rare_codes = scored.select("row", F.explode("rare_grams").alias("code"))
    more_score = rare_codes.join(grams.where(F.col("seen") < bar), "code").groupBy("row").agg(F.sum("log_p").alias("rare_score"))
    zero = F.lit(0)
    return scored.drop("rare", "rare_n", "rare_grams").join(more, "row", "left").join(more_score, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("rare_log", zero) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", zero)).alias("score"),
    )
