"""Phrase collocations, counted level by level with broadcast double-array tries.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+`` (A-Z in lower case).  Phrases of 2
and 3 words are counted per language, all contiguous occurrences inside pieces.

* **Level 1**: all words are counted.  By Apriori no phrase of ``MIN_COUNT`` occurrences holds a rarer word, so each text becomes an
  array of word ids in which rare words and piece ends are -1, stored once.
* **Level k**: candidates are phrases whose parts of k - 1 words are frequent.  The likeliest of them (by counts in a bounded sample of the
  stored arrays, ``TRIE_PHRASES`` at most) form a double-array trie: the state of a phrase is ``base[state of its
  beginning] + next word``, valid if ``check`` names that beginning.  numpy advances the states of all text positions at once, level
  by level, and bincounts the accepting states; the tasks' sums are added up.
* **The rest, exactly**: positions whose phrase is Apriori-safe but not in the trie are summed per task and added up by a shuffle.
  So the trie and its sample only decide *how* a phrase is counted; every occurrence counts, and broadcasts stay
  bounded whatever the number of candidates.  The frequent parts of level 2 are known to level 3 by a bitmap of fixed
  size, whose false hits only let more phrases be counted.
* **Words beyond the vocabulary** (frequent, but not among the ``VOCABULARY`` most frequent, or over ``MAX_WORD_BYTES`` long): phrases that
  hold one are counted as text by a shuffle, level by level too: pairs found around such words (a bitmap says which
  words may be frequent), then those triples whose two pairs are frequent (by a bitmap of all frequent pairs).

Scores are exact: Python integers.  A candidate's words inside a longer candidate of half its count or more drop it.  The first ``TOP`` of each
language are found per part of the language first, so no task sorts all its phrases.

Nulls and odd input: a null text is empty; a null lang is ``und`` (together with texts whose lang says so); repeated rows count each
time; an empty table gives no rows; a language without candidates gives none; other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drainrules.llm.common import map_arrow, shuffle_partitions
from drainrules.session import materialize

MIN_COUNT = 10
DROP_PERCENT = 50
TOP = 2000
VOCABULARY = 1 << 18  # words with an id; an id has WORD_BITS bits
WORD_BITS = 18
MAX_WORD_BYTES = 256
TRIE_PHRASES = 1 << 16
SAMPLE_WORDS = 4_000_000  # ids from which the likeliest phrases are taken
BITMAP_SIZE = 16_777_213  # a prime; bits of a bitmap
PAIR_HASH = (40_503_001, 2_654_435)
ROW_IDS = 1 << 17  # ids in a stored row
HELD = 1 << 20  # entries a task holds before it hands them on

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
BREAK = b"."


def text_words(text: str) -> list[bytes]:
    """The words of a text in order, with ``BREAK`` (no word holds its character) between pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS).replace(b"\n", b" . ").split()


def lang_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _batch_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


# ---------------------------------------------------------------- level 1
def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, words in held.items() for word, n in words.items() if word != BREAK]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in _batch_rows(batch):
                held.setdefault(lang, Counter()).update(text_words(text))
            if sum(map(len, held.values())) > HELD // 4:
                yield flush()
        yield flush()

    return map_arrow(texts, count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


class _Ids(dict):
    """Word -> id; words without one (and breaks) are -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _encoded(texts: DataFrame, words: list[tuple[str, bytes]]) -> DataFrame:
    """``(ids, n)``: word ids of the texts, -1 for what no phrase of known words crosses; rows hold many texts or a part of one."""
    ids: dict[str, _Ids] = {}
    for i, (lang, word) in enumerate(words):
        ids.setdefault(lang, _Ids())[word] = i
    shared = texts.sparkSession.sparkContext.broadcast(ids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = shared.value, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n
            row = np.concatenate(held) if held else np.zeros(0, dtype=np.int32)
            held.clear()
            n = 0
            return pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary()), pa.array([len(row)], pa.int64())], names=["ids", "n"])

        for batch in batches:
            for lang, text in _batch_rows(batch):
                if lang in known:
                    found = text_words(text)
                    row = np.full(len(found) + 1, -1, dtype=np.int32)
                    row[:-1] = np.fromiter(map(known[lang].__getitem__, found), dtype=np.int32, count=len(found))
                    held.append(row)
                    n += len(row)
                    if n >= ROW_IDS:
                        yield flush()
        if held:
            yield flush()

    return map_arrow(texts, encode, "ids binary, n long")


# ---------------------------------------------------------------- bitmaps of fixed size
def _collect_bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each value ``h`` in [0, BITMAP_SIZE); the driver receives at most BITMAP_SIZE bits."""
    at = F.col("h") + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITMAP_SIZE // 8 + 4097, dtype=np.uint8)
    for r in rows:
        start = (r["b"] - 1) * 4096
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)[: len(out) - start]
        out[start : start + len(part)] = part
    return out


def _pair_hash(a, b):
    return (a * PAIR_HASH[0] + b * PAIR_HASH[1]) % BITMAP_SIZE


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)


# ---------------------------------------------------------------- double-array tries
class DoubleArrayTrie:
    """Phrases of word ids; states under ``n_words`` are the words themselves.

    ``keys[state]`` is the phrase of an accepting state (its ids, WORD_BITS each), -1 of others.
    """

    def __init__(self, phrases: np.ndarray, n_words: int):
        """``phrases``: different rows of k ids."""
        self.n_words, self.k = n_words, phrases.shape[1] if phrases.ndim == 2 else 2
        self.base = np.zeros(max(1, n_words), dtype=np.int32)
        self.check = np.full(n_words + max(1, n_words), -1, dtype=np.int32)
        self._end = n_words
        self._tried: dict[int, int] = {}  # by size of family (power of two): where the last one was put
        states = phrases[:, 0].astype(np.int64) if len(phrases) else np.zeros(0, dtype=np.int64)
        for level in range(1, self.k):
            if len(phrases):
                states = self._grow(states, phrases[:, level].astype(np.int64))
        size = self._end + max(1, n_words)
        self.check = self.check[:size]
        self.base = np.pad(self.base, (0, max(0, size - len(self.base))))
        self.keys = np.full(size, -1, dtype=np.int64)
        key = np.zeros(len(phrases), dtype=np.int64)
        for level in range(self.k if len(phrases) else 0):
            key = key << WORD_BITS | phrases[:, level]
        self.keys[states] = key

    def _room(self, upto: int) -> None:
        need = upto + max(1, self.n_words) + 1
        if need > len(self.check):
            self.check = np.pad(self.check, (0, max(need, 2 * len(self.check)) - len(self.check)), constant_values=-1)
        if upto + 1 > len(self.base):
            self.base = np.pad(self.base, (0, max(upto + 1, 2 * len(self.base)) - len(self.base)))

    def _grow(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Give each parent its children; the states of ``(parent, symbol)``."""
        edges, inverse = np.unique(np.stack((parents, symbols), axis=1), axis=0, return_inverse=True)
        owner, start, n = np.unique(edges[:, 0], return_index=True, return_counts=True)
        states = np.zeros(len(edges), dtype=np.int64)
        for i in np.lexsort((owner, -n)):  # large families first, while the array is empty
            if n[i] == 1:
                break
            rows = slice(start[i], start[i] + n[i])
            base = self._fit(edges[rows, 1])
            states[rows] = base + edges[rows, 1]
            self._put(np.array([owner[i]]), np.array([base]), states[rows], owner[i])
        alone = np.flatnonzero(n == 1)
        if len(alone):  # single children take the free places in order
            rows = start[alone]
            self._room(self._end + len(alone))
            free = np.flatnonzero(self.check[self.n_words : self._end + len(alone)] < 0)[: len(alone)] + self.n_words
            states[rows] = free
            self._put(owner[alone], free - edges[rows, 1], free, owner[alone])
        return states[inverse.reshape(-1)]

    def _put(self, parents: np.ndarray, bases: np.ndarray, states: np.ndarray, owners) -> None:
        top = int(states.max())
        self._end = max(self._end, top + 1)
        self._room(self._end)
        self.check[states] = owners
        self.base[parents] = bases

    def _fit(self, symbols: np.ndarray) -> int:
        """A base (0 or more) at which all children fall on free places, behind the last family of about this size."""
        kind = len(symbols).bit_length()
        base = self._search(symbols, self._tried.get(kind, self.n_words))
        self._tried[kind] = base + int(symbols[0])
        return base

    def _search(self, symbols: np.ndarray, at: int) -> int:
        step = max(16, (1 << 10) // len(symbols))
        while at < self._end:
            places = np.flatnonzero(self.check[at : min(at + 4 * step, self._end)] < 0)[:step] + at
            if len(places):
                self._room(int(places[-1] + symbols[-1] - symbols[0]) + 1)
                fits = (self.check[(places - symbols[0])[:, None] + symbols[None, :]] < 0).all(axis=1)
                if fits.any():
                    return int(places[fits.argmax()] - symbols[0])
                at = int(places[-1]) + 1
            else:
                at += 4 * step
        self._room(self._end + int(symbols[-1] - symbols[0]) + 1)
        return int(self._end - symbols[0])

    def advance(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """States after one more word each; -1 where there is none (also for states or words of -1)."""
        live = (states >= 0) & (words >= 0)
        to = self.base[np.where(live, states, 0)] + np.where(live, words, 0)
        return np.where(live & (self.check[to] == states), to, -1)

    def run(self, ids: np.ndarray) -> np.ndarray:
        """For each position with k words from there on, the state that its phrase ends in (-1: not in the trie)."""
        n = len(ids) - self.k + 1
        states = ids[:n] if n > 0 else ids[:0]
        for level in range(1, self.k):
            states = self.advance(states, ids[level : level + len(states)])
        return states


# ---------------------------------------------------------------- levels 2 and 3
def _phrase_counts(encoded: DataFrame, k: int, trie: DoubleArrayTrie | None, pairs: np.ndarray | None) -> DataFrame:
    """``(key, f)`` of the phrases of k known words; ``pairs`` is the bitmap of frequent pairs for k = 3."""
    context = encoded.sparkSession.sparkContext
    shared = context.broadcast((trie, pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, pairs = shared.value
        sums = np.zeros(len(trie.keys) if trie else 0, dtype=np.int64)
        held, n = [], 0

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["key", "f"])

        for batch in batches:
            for row in batch.column(0):
                ids = np.frombuffer(row.as_buffer(), dtype=np.int32).astype(np.int64)
                if len(ids) < k:
                    continue
                size = len(ids) - k + 1
                safe = np.logical_and.reduce([ids[i : i + size] >= 0 for i in range(k)])
                if pairs is not None:
                    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                    known = np.zeros(len(both), dtype=bool)
                    known[both] = _has(pairs, _pair_hash(ids[:-1][both], ids[1:][both]))
                    safe &= known[:-1] & known[1:]
                if trie is not None:
                    states = trie.run(ids)
                    accepted = states >= 0
                    sums += np.bincount(states[accepted], minlength=len(sums))
                    safe &= ~accepted
                at = np.flatnonzero(safe)
                key = np.zeros(len(at), dtype=np.int64)
                for i in range(k):
                    key = key << WORD_BITS | ids[at + i]
                held.append(key)
                n += len(key)
                if n >= HELD:
                    yield from rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, n = [], 0
        if held:
            yield from rows(*np.unique(np.concatenate(held), return_counts=True))
        seen = np.flatnonzero(sums)
        if len(seen):
            yield from rows(trie.keys[seen], sums[seen])

    return map_arrow(encoded.select("ids"), count, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def _level(encoded: DataFrame, n_ids: int, k: int, n_words: int, pairs: np.ndarray | None, trie_phrases: int, sample_words: int) -> DataFrame:
    """Frequent phrases ``(key, f)`` of k known words, stored."""
    share = min(1.0, sample_words / max(1, n_ids))
    sample = encoded.where(F.pmod(F.xxhash64("ids"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    likely = _phrase_counts(sample, k, None, pairs).orderBy(F.col("f").desc(), "key").limit(trie_phrases).select("key").toPandas()["key"].to_numpy(dtype=np.int64)
    mask = (1 << WORD_BITS) - 1
    phrases = np.stack([likely >> WORD_BITS * (k - 1 - i) & mask for i in range(k)], axis=1).reshape(-1, k)
    trie = DoubleArrayTrie(phrases, n_words)
    return _phrase_counts(encoded, k, trie, pairs)


def _as_text(counts: DataFrame, k: int, words: list[tuple[str, bytes]]) -> DataFrame:
    """``(lang, phrase, k, f)`` of counted keys."""
    shared = counts.sparkSession.sparkContext.broadcast(words)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mask = shared.value, (1 << WORD_BITS) - 1
        for batch in batches:
            langs, phrases = [], []
            for key in batch.column(0).to_pylist():
                ids = [key >> WORD_BITS * (k - 1 - i) & mask for i in range(k)]
                langs.append(known[ids[0]][0])
                phrases.append(b" ".join(known[i][1] for i in ids).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array([k] * len(langs), pa.int32()), batch.column(1)], names=["lang", "phrase", "k", "f"])

    return map_arrow(counts.select("key", "f"), spell, "lang string, phrase string, k int, f long")


def _phrase_hash(lang, phrase):
    """Place of a phrase's text in a bitmap, as Column and (``_text_hash``) in Python."""
    return F.crc32(F.concat(F.encode(lang, "utf-8"), F.lit(b" "), phrase)) % F.lit(BITMAP_SIZE)


def _text_hash(lang: bytes, phrase: bytes) -> int:
    return zlib.crc32(lang + b" " + phrase) % BITMAP_SIZE


def _cold_phrases(texts: DataFrame, words: list[tuple[str, bytes]], cold: np.ndarray, k: int, pairs: np.ndarray | None) -> DataFrame:
    """``(lang, phrase, k, f)`` of the phrases of k words with a frequent word outside the vocabulary.

    ``cold`` is the bitmap of these words, ``pairs`` (for k = 3) that of all frequent pairs.
    """
    known: dict[str, set] = {}
    for lang, word in words:
        known.setdefault(lang, set()).add(word)
    shared = texts.sparkSession.sparkContext.broadcast((known, cold, pairs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cold, pairs = shared.value
        held: dict[str, Counter] = {}

        def has(bits: np.ndarray, h: int) -> int:
            return bits[h >> 3] >> (h & 7) & 1

        def flush() -> pa.RecordBatch:
            rows = [(lang, phrase, n) for lang, phrases in held.items() for phrase, n in phrases.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in _batch_rows(batch):
                name, hot, found = lang.encode("utf-8"), known.get(lang, ()), text_words(text)
                rare: dict[int, bool] = {}  # by position, of the words outside the vocabulary
                for i, w in enumerate(found):
                    if w not in hot:
                        rare[i] = w == BREAK or not has(cold, _text_hash(name, w))
                at = sorted({j for i, no in rare.items() if not no for j in range(max(0, i - k + 1), min(i, len(found) - k) + 1)})
                counter = held.setdefault(lang, Counter())
                for j in at:
                    if any(rare.get(j + d) for d in range(k)):
                        continue
                    if pairs is not None and not all(has(pairs, _text_hash(name, b" ".join(found[j + d : j + d + 2]))) for d in range(k - 1)):
                        continue
                    counter[b" ".join(found[j : j + k])] += 1
            if sum(map(len, held.values())) >= HELD // 8:
                yield flush()
        yield flush()

    counts = map_arrow(texts, count, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counts.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), "f")


# ---------------------------------------------------------------- scores
def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``(lang, phrase, k, a, l, r, score)`` by the lowest-scoring cut of each candidate."""
    part = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = candidates.select("lang", "phrase", "k", "a", cut.alias("cut")).select(
        "*", F.array_join(F.slice(part, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(part, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "phrase", "k", "a", "cut", "l", "r")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [1_000_000 * a * a // (f * g) for a, f, g in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.int64())], names=[*batch.schema.names, "score"])

    scored = map_arrow(joined, score, "lang string, phrase string, k int, a long, cut int, l long, r long, score long")
    least = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    return least.select("lang", "phrase", "k", "a", "s.l", "s.r", "s.score")


def mine_collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, drop_percent: int = DROP_PERCENT, top: int = TOP,
    vocabulary: int = VOCABULARY, trie_phrases: int = TRIE_PHRASES, sample_words: int = SAMPLE_WORDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each language."""
    spark = docs.sparkSession
    if not 1 <= vocabulary <= 1 << WORD_BITS:
        raise ValueError(f"the vocabulary holds 1 to {1 << WORD_BITS} words")
    texts = lang_texts(docs)
    all_words = materialize(word_counts(texts), "collocation-words")
    frequent = all_words.where(F.col("f") >= min_count)
    short = frequent.where(F.length("word") <= MAX_WORD_BYTES)
    words = [(r["lang"], bytes(r["word"])) for r in short.orderBy(F.col("f").desc(), "lang", "word").limit(vocabulary).collect()]
    encoded = materialize(_encoded(texts, words), "collocation-ids")
    n_ids = encoded.agg(F.sum("n").alias("n")).first()["n"] or 0

    pairs = materialize(_level(encoded, n_ids, 2, len(words), None, trie_phrases, sample_words).where(F.col("f") >= min_count), "collocation-pairs")
    mask = (1 << WORD_BITS) - 1
    a, b = F.shiftright("key", WORD_BITS), F.col("key").bitwiseAND(F.lit(mask))
    bitmap = _collect_bitmap(pairs.select(_pair_hash(a, b).alias("h")))
    triples = _level(encoded, n_ids, 3, len(words), bitmap, trie_phrases, sample_words).where(F.col("f") >= min_count)
    doubles = _as_text(pairs, 2, words)
    triples = _as_text(triples, 3, words)
    if frequent.count() > len(words):
        # The vocabulary is bounded (VOCABULARY words of MAX_WORD_BYTES bytes at most).
        known = spark.createDataFrame([(lang, bytearray(w)) for lang, w in words], "lang string, word binary")
        cold = frequent.join(F.broadcast(known), ["lang", "word"], "left_anti")
        cold_bits = _collect_bitmap(cold.select(_phrase_hash(F.col("lang"), F.col("word")).alias("h")))
        doubles = materialize(doubles.unionByName(_cold_phrases(texts, words, cold_bits, 2, None).where(F.col("f") >= min_count)), "collocation-doubles")
        pair_bits = _collect_bitmap(doubles.select(_phrase_hash(F.col("lang"), F.encode("phrase", "utf-8")).alias("h")))
        triples = triples.unionByName(_cold_phrases(texts, words, cold_bits, 3, pair_bits).where(F.col("f") >= min_count))
    phrases = materialize(doubles.unionByName(triples), "collocation-phrases")

    candidates = phrases.withColumnRenamed("f", "a")
    counts = frequent.select("lang", F.col("word").cast("string").alias("phrase"), "f").unionByName(phrases.where("k = 2").select("lang", "phrase", "f"))
    part = F.split("phrase", " ")
    inside = F.explode(F.array(F.array_join(F.slice(part, 1, 2), " "), F.array_join(F.slice(part, 2, 2), " ")))
    longer = candidates.where("k = 3").select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = (
        _scored(candidates, counts).join(longer, ["lang", "phrase"], "left")
        .where((F.col("k") == 3) | F.col("longest").isNull() | (100 * F.col("longest") < drop_percent * F.col("a")))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(spark))).alias("salt")
    first = kept.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
