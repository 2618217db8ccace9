"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Items and documents are word sequences (letters and digits, lower case).  An item leaks into a document where some
stretch of its words is within ``floor((1 - similarity) * words)`` word edits of the item.

1. **Embedding.**  The CGK random walk copies a sequence into a string of ``STRETCH`` times its length: at step ``j`` it emits the word
   at its place, and a random function of (step, word) says whether the place moves on.  Sequences at a small
   edit distance get strings at a small Hamming distance.
2. **Bit sampling.**  A round has its own walk and ``sampled`` random steps; the words emitted there are its key.  Items enter
   a table per round and length; a window of a document is a candidate of the items whose key it shares in
   some round.  Longer items need more rounds, so each class of lengths (allowed edits within a quarter of each other) has as many as
   reach ``recall`` on its own trial pairs: its items against copies with as many random word edits as are allowed, the
   windows around such a copy included.  A class that has not reached it after ``max_rounds`` is not left short: all windows of
   step 3 of its sizes are candidates, which misses no leak.
3. **Windows** have the size of an item and start at every word.  By the q-gram lemma a stretch within ``k`` edits of an item
   of ``w`` words holds at least ``w - 1 - 2k`` of its bigrams, so windows with fewer bigrams of any one item of their
   size than that can hold no leak and are not embedded.
4. **Verification.**  The least word edit distance of the item to any stretch around a candidate window is computed exactly.

The benchmark is a stated query set: it is read in blocks of at most ``ITEMS_AT_ONCE`` items, each a bounded broadcast against
all documents; documents are not shuffled.

Nulls and odd input: a null text is empty and leaks nothing; items without words (null or empty texts among
them) are left out; items of one word must be met exactly; repeated items and repeated documents each give their
rows; a null id is kept; an empty table on either side gives no rows (or keeps all documents); other columns are left
behind by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import blocks_of, doc_columns, map_arrow

SIMILARITY = 0.8
RECALL = 0.95
SAMPLED = 4
STRETCH = 3
TRIALS = 8  # copies of an item, more where a class has few items ...
CLASS_TRIALS = 64  # ... to have this many in each class
MAX_ROUNDS = 200
ITEMS_AT_ONCE = 2000
CELLS_AT_ONCE = 4_000_000  # of embedded strings held at once
SEED = 5

_WORD = re.compile(r"[^\W_]+")


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A random function of 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """``(windows, steps)`` strings of the windows ``words[start : start + size]``; 0 stands after a window's end."""
    out = np.zeros((steps, len(starts)), dtype=np.int32)
    place, last = starts.copy(), starts + sizes
    padded = np.append(words, 0)
    with np.errstate(over="ignore"):
        salts = _mix(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(seed * 100_003))
        hashes = _mix(padded.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        for j in range(steps):
            out[j] = padded[place] * (place < last)
            place += (((hashes[place] ^ salts[j]) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(63)).astype(np.int64)
            np.minimum(place, last, out=place)  # a window that has ended stays there
    return out.T


def _distances(item: list[int], words: list[int], anchored: bool) -> list[int]:
    """Edit distance of the item to the stretch that ends after each word, and begins anywhere (anchored: at the first word).

    One column of the table per word, as bit vectors over the item's words.
    """
    size = len(item)
    full, high = (1 << size) - 1, 1 << (size - 1)
    equal: dict[int, int] = {}
    for i, w in enumerate(item):
        equal[w] = equal.get(w, 0) | 1 << i
    plus, minus, score, out = full, 0, size, [size]
    for w in words:
        eq = equal.get(w, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & high) - bool(down & high)
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        out.append(score)
    return out


def semi_global(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least word edits that turn a stretch of ``words`` into the item, and that stretch: the first to end, then the shortest."""
    a, b = item.tolist(), words.tolist()
    to = _distances(a, b, False)
    least = min(to)
    end = to.index(least)
    back = _distances(a[::-1], b[:end][::-1], True)
    return least, end - back.index(least), end


@dataclass
class Items:
    """A block of benchmark items with their tables."""

    ids: list[int | None]
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    edits: list[int]
    bigrams: np.ndarray
    bigram_items: np.ndarray  # the items of each bigram, one bigram after the other ...
    bigram_first: np.ndarray  # ... and where they begin
    own_bigrams: list[set[int]]
    sampled: int
    rounds: int = 0
    trial_recall: float = 1.0
    class_recall: dict[int, float] = field(default_factory=dict)  # by sampling alone
    rounds_of: dict[int, int] = field(default_factory=dict)  # size -> rounds
    exact: dict[int, list[int]] = field(default_factory=dict)  # size -> items that sampling does not reach
    tables: list[dict[int, list[int]]] = field(default_factory=list)  # per round: key -> items

    def codes(self, words: np.ndarray) -> np.ndarray:
        return words[:-1] * (len(self.vocabulary) + 1) + words[1:]

    def keys(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, round_: int) -> np.ndarray:
        """The key of each window in a round."""
        draws = np.random.default_rng((SEED, round_)).random(self.sampled)
        steps = np.sort((draws[None, :] * STRETCH * sizes[:, None]).astype(np.int64), axis=1)
        key = sizes.astype(np.uint64)
        longest = int(steps.max(initial=0)) + 1
        at_once = max(1, CELLS_AT_ONCE // longest)
        for first in range(0, len(starts), at_once):
            rows = slice(first, first + at_once)
            strings = cgk(words, starts[rows], sizes[rows], longest, 1 + round_)
            with np.errstate(over="ignore"):
                for s in steps[rows].T:
                    key[rows] = _mix(key[rows] * np.uint64(31) + strings[np.arange(len(s)), s].astype(np.uint64) + np.uint64(1))
        return key


def length_class(edits: int) -> int:
    """Items of a class allow numbers of edits within a quarter of each other."""
    return int(math.log(edits) / math.log(1.25)) if edits else -1


def fit_items(
    rows: list[tuple[int | None, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, sampled: int = SAMPLED, max_rounds: int = MAX_ROUNDS
) -> Items:
    """Build the tables of some items, with as many rounds for each class of lengths as reach the recall on its trial pairs."""
    texts = [(i, text_words(t or "")) for i, t in rows]
    texts = [(i, w) for i, w in texts if w]
    vocabulary = {w: n for n, w in enumerate(sorted({x for _, ws in texts for x in ws}), 1)}
    words = [np.array([vocabulary[x] for x in ws], dtype=np.int64) for _, ws in texts]
    items = Items([i for i, _ in texts], vocabulary, words, [int((1 - similarity) * len(w) + 1e-9) for w in words], *([np.zeros(0, dtype=np.int64)] * 3), [], sampled)
    items.own_bigrams = [set(items.codes(w).tolist()) for w in words]
    pairs = sorted({(c, n) for n in range(len(words)) for c in items.own_bigrams[n]})
    items.bigrams, items.bigram_first = np.unique(np.array([c for c, _ in pairs], dtype=np.int64), return_index=True)
    items.bigram_first = np.append(items.bigram_first, len(pairs))
    items.bigram_items = np.array([n for _, n in pairs], dtype=np.int64)
    classes = np.array([length_class(k) for k in items.edits], dtype=np.int64)
    members = dict(zip(*(x.tolist() for x in np.unique(classes, return_counts=True)), strict=True))
    trials = []
    rng = np.random.default_rng(SEED)
    for n, (w, k) in enumerate(zip(words, items.edits, strict=True)):
        for _ in range(max(TRIALS, -(-CLASS_TRIALS // members[int(classes[n])])) if k else 0):
            trials.append((n, _edited(w, k, len(vocabulary), rng)))
    found = np.zeros(len(trials), dtype=bool)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    joined = np.concatenate(words) if words else np.zeros(0, dtype=np.int64)
    places, sizes, owner, copies, at = [], [], [], [], 0
    for t, (n, copy) in enumerate(trials):
        windows = 2 * items.edits[n] + 1
        places += range(at, at + windows)
        sizes += [lengths[n]] * windows
        owner += [t] * windows
        copies += [copy, np.zeros(lengths[n], dtype=np.int64)]
        at += len(copy) + lengths[n]
    places, sizes, owner = (np.array(x, dtype=np.int64) for x in (places, sizes, owner))
    copies = np.concatenate(copies) if copies else np.zeros(0, dtype=np.int64)
    trial_class = classes[[n for n, _ in trials]] if trials else np.zeros(0, dtype=np.int64)
    first_words = np.cumsum(lengths) - lengths
    going = set(members)
    while items.rounds < max_rounds and going:
        active = np.flatnonzero(np.isin(classes, list(going)))
        table: dict[int, list[int]] = {}
        for n, key in zip(active.tolist(), items.keys(joined, first_words[active], lengths[active], items.rounds).tolist(), strict=True):
            table.setdefault(key, []).append(n)
        items.tables.append(table)
        still = (~found & np.isin(trial_class, list(going)))[owner] if len(trials) else np.zeros(0, dtype=bool)
        if still.any():
            keys = items.keys(copies, places[still], sizes[still], items.rounds)
            for t, key in zip(owner[still].tolist(), keys.tolist(), strict=True):
                if trials[t][0] in table.get(key, ()):
                    found[t] = True
        items.rounds += 1
        items.rounds_of |= dict.fromkeys(lengths[active].tolist(), items.rounds)
        # Items that allow no edits have no trials: they are met in any round.
        going = {c for c in going if c >= 0 and found[trial_class == c].mean() < recall}
    items.class_recall = {c: float(found[trial_class == c].mean()) for c in members if c >= 0}
    for n in np.flatnonzero(np.isin(classes, list(going))).tolist():
        items.exact.setdefault(int(lengths[n]), []).append(n)
    if len(trials):
        items.trial_recall = float((found | np.isin(trial_class, list(going))).mean())
    return items


def _edited(words: np.ndarray, k: int, n_words: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with ``k`` random word edits, between ``k`` foreign words on either side."""
    copy = words.tolist()
    for _ in range(k):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(copy))))
        if kind == 0 and len(copy) > 1:
            del copy[at]
        elif kind == 1:
            copy.insert(at, 0)
        else:
            copy[at] = int(rng.integers(n_words + 1))
    return np.array([0] * k + copy + [0] * k, dtype=np.int64)


def _windows(words: np.ndarray, items: Items, edits_of: dict[int, int]) -> dict[int, np.ndarray]:
    """``size -> starts`` of the windows of a text that hold enough bigrams of some item of that size for a leak."""
    n = len(words)
    known = words > 0
    which = np.full(n, -1, dtype=np.int64)  # the benchmark bigram that begins here
    both = np.flatnonzero(known[:-1] & known[1:])
    if len(both) and len(items.bigrams):
        code = words[both] * (len(items.vocabulary) + 1) + words[both + 1]
        at = np.searchsorted(items.bigrams, code)
        at[at == len(items.bigrams)] = 0
        which[both] = np.where(items.bigrams[at] == code, at, -1)
    sums = np.concatenate(([0], np.cumsum(which >= 0)))
    known_sums = np.concatenate(([0], np.cumsum(known)))
    starts = np.arange(n)
    widest = max(size + k for size, k in edits_of.items())
    most = int((sums[np.minimum(starts + widest, n)] - sums[:-1]).max())
    out: dict[int, list[np.ndarray]] = {}
    inside = np.zeros(n + 1, dtype=np.int64)  # stretches with enough bigrams of any items begin and end
    for size, k in edits_of.items():
        need = size - 1 - 2 * k
        if need > most or known_sums[-1] < size - k:
            continue
        end = np.minimum(starts + size + k, n)
        ok = known_sums[end] - known_sums[:-1] >= size - k
        if need > 0:
            ok &= sums[end] - sums[:-1] >= need
            if ok.any():
                inside[starts[ok]] += 1
                inside -= np.bincount(end[ok], minlength=n + 1)
        elif ok.any():  # too short or too many edits for bigrams to tell
            out.setdefault(size, []).append(starts[ok])
    hits = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (which >= 0))
    if len(hits):
        first, count = items.bigram_first[which[hits]], items.bigram_first[which[hits] + 1] - items.bigram_first[which[hits]]
        item = items.bigram_items[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        place = np.repeat(hits, count)
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        for i, begin, stop in zip(*(x.tolist() for x in _groups(item)), strict=True):
            size, k = len(items.words[i]), items.edits[i]
            need = size - 1 - 2 * k
            if 0 < need <= stop - begin:
                own = place[begin:stop]
                at = np.arange(max(0, int(own[0]) - size - k), int(own[-1]) + 1)
                at = at[np.searchsorted(own, at + size + k) - np.searchsorted(own, at) >= need]
                if len(at):
                    out.setdefault(size, []).append(at)
    return {size: np.unique(np.concatenate(at)) for size, at in out.items()}


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values, and where each begins and stops."""
    begin = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return sorted_values[begin], begin, np.append(begin[1:], len(sorted_values))


def leaks_in(texts: list[str], items: Items) -> list[list[tuple[int, int, int, int]]]:
    """For each text ``(item, edits, start, end)`` of each item of the block that leaks into it: its best stretch of words."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not items.words:
        return found
    get = items.vocabulary.get
    edits_of = dict(sorted(zip((len(w) for w in items.words), items.edits, strict=True)))
    widest = max(edits_of)
    held: dict[int, tuple[np.ndarray, int]] = {}  # text -> its words, their place among all held words
    places, sizes, owner, at = [], [], [], 0
    for t, text in enumerate(texts):
        raw = text_words(text)
        words = np.fromiter(map(get, raw, repeat(0)), dtype=np.int64, count=len(raw))
        windows = _windows(words, items, edits_of) if len(words) else {}
        if windows:
            held[t] = (words, at)
            for size, starts in windows.items():
                places.append(at + starts)
                sizes.append(np.full(len(starts), size))
                owner.append(np.full(len(starts), t))
            at += len(words) + widest
    if not held:
        return found
    joined = np.zeros(at, dtype=np.int64)
    for words, place in held.values():
        joined[place : place + len(words)] = words
    places, sizes, owner = np.concatenate(places), np.concatenate(sizes), np.concatenate(owner)
    candidates: dict[tuple[int, int], set[int]] = {}
    for size, all_items in items.exact.items():
        for w in np.flatnonzero(sizes == size).tolist():
            for item in all_items:
                candidates.setdefault((int(owner[w]), item), set()).add(int(places[w]))
    needed = np.zeros(widest + 1, dtype=np.int64)  # rounds by size
    needed[list(items.rounds_of)] = list(items.rounds_of.values())
    needed[list(items.exact)] = 0
    needed = needed[sizes]
    for r, table in enumerate(items.tables):
        live = np.flatnonzero(needed > r)
        if not len(live):
            break
        keys = items.keys(joined, places[live], sizes[live], r)
        hits = np.flatnonzero(np.isin(keys, np.fromiter(table, dtype=np.uint64, count=len(table))))
        for w, key in zip(live[hits].tolist(), keys[hits].tolist(), strict=True):
            for item in table[key]:
                if len(items.words[item]) == sizes[w]:
                    candidates.setdefault((int(owner[w]), item), set()).add(int(places[w]))
    for (t, item), starts in sorted(candidates.items()):
        words, place = held[t]
        size, k = len(items.words[item]), items.edits[item]
        best, done = None, -1
        for s in sorted(p - place for p in starts):
            if s <= done:
                continue
            lo, hi = max(0, s - k), min(len(words), s + size + 3 * k + 1)
            done = s + k  # stretches that begin up to there lie within the words just compared
            if sum(map(items.own_bigrams[item].__contains__, items.codes(words[lo:hi]).tolist())) < size - 1 - 2 * k:
                continue
            edits, start, end = semi_global(items.words[item], words[lo:hi])
            if edits <= k and (best is None or edits < best[0]):
                best = (edits, lo + start, lo + end)
                if edits == 0:
                    break
        if best:
            found[t].append((item, *best))
    return found


def item_blocks(benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE, **parameters) -> Iterator[Items]:
    """The benchmark's items, in blocks of about ``items_at_once`` that the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = blocks_of(rows.count(), items_at_once)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield fit_items([(r["item_id"], r["text"]) for r in rows.where(block == b).orderBy("item_id", "text").collect()], **parameters)


def find_leaks(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE, **parameters) -> DataFrame:
    """``doc_id, item_id, edits, item_words, similarity, word_start, word_end`` for each document and item that leaks into it."""
    schema = "doc_id long, item_id long, edits long, item_words long, similarity double, word_start long, word_end long"
    texts = doc_columns(docs)
    out = None
    for items in item_blocks(benchmark, items_at_once, **parameters):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                rows = []
                for doc_id, leaks in zip(batch.column(0).to_pylist(), leaks_in(batch.column(1).to_pylist(), block), strict=True):
                    for item, edits, start, end in leaks:
                        size = len(block.words[item])
                        rows.append((doc_id, block.ids[item], edits, size, 1 - edits / size, start, end))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                names = ["doc_id", "item_id", "edits", "item_words", "similarity", "word_start", "word_end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if m == "similarity" else pa.int64()) for c, m in zip(columns, names, strict=True)], names=names)

        part = map_arrow(texts, find, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE, **parameters) -> DataFrame:
    """The rows of ``docs``, all their columns, into which no benchmark item leaks."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, items_at_once, **parameters):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not leaks for leaks in leaks_in([t or "" for t in batch.column(at).to_pylist()], shared.value)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_arrow(docs, keep, docs.schema)
    return docs
