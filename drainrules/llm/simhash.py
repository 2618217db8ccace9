"""Near-duplicate documents by SimHash, with bit-sliced comparison of fingerprints.

1. **Fingerprints.**  Words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z in lower case; shingles of
   ``shingle`` words joined by a space, repeats included (fewer words: the whole sequence).
   A bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).
   A text without words has fingerprint 0.  Equal fingerprints collapse to one row first.
2. **Buckets.**  Two fingerprints within ``radius`` bits agree on all bits of at least
   ``blocks - radius`` of ``blocks`` bit ranges, so each choice of that many ranges is a bucket key; no
   pair within the radius is lost.  Buckets of one fingerprint end here.  A bucket of
   over ``chunk_rows`` rows is dealt into chunks, and each pair of chunks goes to a
   task of its own.
3. **Comparison.**  Sorted bucket rows are cut into blocks of ``BLOCK`` rows.  A block is
   stored vertically, one bit plane per fingerprint bit, 64 rows to a word.  XOR
   with a query bit gives one more differing bit for 64 rows at once; it is added to
   carry-save counters (one word per counter bit), and rows whose count passes the radius
   are marked dead.  Once all rows of a block are dead the other planes are left out.
   All links inside a block are found; each block hands on a spanning forest, never all pairs.
4. **Components** of the forests' links, by ``components.connected_components``.

Nulls and odd input: a null text is empty; a null id keeps its row, and the component id is the
smallest id that is not null (null if there is none); repeated rows each get their row; an
empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from drainrules.llm.common import doc_columns, lower_words, map_arrow
from drainrules.llm.components import connected_components
from drainrules.session import few_files, materialize

SHINGLE = 3
RADIUS = 2
BLOCKS = 5
CHUNK_ROWS = 4096
BLOCK = 512
SEED = 42
_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text, as a signed integer."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _HASHES_AT_ONCE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _HASHES_AT_ONCE], ends[i : i + _HASHES_AT_ONCE], strict=True)], dtype="<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<i8")[0])


def add_fingerprints(df: DataFrame, name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``df`` and the fingerprint of its column ``text`` (a column of that name is replaced)."""
    df = df.drop(name)
    at = df.columns.index("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or "", shingle) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, name])

    return map_arrow(df, compute, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """``(64, words)`` bit planes of some fingerprints, 64 of them to a word."""
    bits = np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(prints) // 64) * 64), dtype=np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within_radius(queries: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray | None:
    """``(queries, block)`` boolean matrix of the pairs within the radius; None if there is none."""
    planes = bit_planes(block)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = (queries.astype(np.int64)[:, None] >> np.arange(64)) & 1
    masks = np.where(asked == 1, ones, np.uint64(0)).astype("<u8")
    shape = (len(queries), planes.shape[1])
    over = radius + 1
    counters = [np.zeros(shape, dtype="<u8") for _ in range(over.bit_length())]
    dead = np.zeros(shape, dtype="<u8")
    for b in range(64):
        carry = masks[:, b][:, None] ^ planes[b][None, :]
        for c, counter in enumerate(counters):
            counters[c], carry = counter ^ carry, counter & carry
        reached = np.full(shape, ones, dtype="<u8")
        for c, counter in enumerate(counters):
            reached &= counter if over >> c & 1 else ~counter
        dead |= reached
        if b % 8 == 7 and (dead == ones).all():
            return None
    alive = np.unpackbits((~dead).view(np.uint8), axis=1, bitorder="little")[:, : len(block)].astype(bool)
    return alive if alive.any() else None


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked inside block ``a``, or between ``a`` and ``b``."""
    near = within_radius(a, a if b is None else b, radius)
    if near is None:
        return a[:0], a[:0]
    both = a if b is None else np.concatenate((a, b))
    if b is not None:
        full = np.zeros((len(both), len(both)), dtype=bool)
        full[: len(a), len(a) :] = near
        near = full | full.T
        np.fill_diagonal(near, True)
    label = np.arange(len(both))
    while True:
        least = np.where(near, label[None, :], len(both)).min(axis=1)
        least = np.minimum(least, label[least])
        if (least == label).all():
            break
        label = least
    rows = np.flatnonzero(both != both[label])
    return both[rows], both[label[rows]]


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints whose components are those of all pairs within the radius."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more bit ranges than bits may differ")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(ranges, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fp = F.col("fp")
    keyed = prints.select(
        fp,
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])).alias("k"),
    ).select("fp", "k.t", "k.key")
    chunks = F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int")
    cells = (
        keyed.withColumn("n", F.count("*").over(Window.partitionBy("t", "key")))
        .where("n > 1")
        .withColumn("chunks", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "t", "key", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
        .repartition("t", "key", "ci", "cj")
        .sortWithinPartitions("t", "key", "ci", "cj", "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns fp, run number
        last_key, run = None, -1

        def links(data: np.ndarray) -> pa.RecordBatch:
            parts = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            found = []
            for i, p in enumerate(parts):
                found.append(_forest(p[:, 0], None, radius))
                for q in parts[i + 1 :]:
                    if q[0, 1] != p[-1, 1]:
                        break
                    found.append(_forest(p[p[:, 1] == q[0, 1], 0], q[q[:, 1] == q[0, 1], 0], radius))
            a = np.concatenate([f[0] for f in found])
            b = np.concatenate([f[1] for f in found])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            keys = np.stack(cols[1:], axis=1)
            new = np.empty(len(keys), dtype=bool)
            new[0] = last_key is None or (keys[0] != last_key).any()
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            runs = run + np.cumsum(new)
            last_key, run = keys[-1], int(runs[-1])
            held.append(np.stack((cols[0], runs), axis=1))
            if sum(map(len, held)) >= 8 * BLOCK:
                data = np.concatenate(held)
                whole = int(np.searchsorted(data[:, 1], run))  # the last run may go on
                if whole:
                    yield links(data[:whole])
                held = [data[whole:]]
        if held and len(data := np.concatenate(held)):
            yield links(data)

    return map_arrow(cells, compare, "a long, b long").distinct()


def fingerprint_components(ids: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(fp, doc_id, first_fp)`` per distinct fingerprint of ``ids (doc_id, fp)``, a written table (it is counted first).

    ``doc_id`` is the smallest id of its component, ``first_fp`` the fingerprint of that document.
    """
    distinct = materialize(few_files(ids.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), ids.count()), "simhash-prints")
    # About one link for each row of a bucket; more of them only make larger files.
    most = distinct.count() * comb(blocks, blocks - radius)
    links = materialize(few_files(near_links(distinct.select("fp"), radius, blocks, chunk_rows), most), "simhash-links")
    roots = connected_components(links)
    # Only linked fingerprints have a root; the others are components of their own.
    linked = distinct.join(roots, distinct["fp"] == roots["id"]).select("fp", "doc_id", "root")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("f"))
    merged = linked.join(first, "root").select("fp", F.col("f.doc_id").alias("doc_id"), F.col("f.fp").alias("first_fp"))
    alone = distinct.join(roots, distinct["fp"] == roots["id"], "left_anti").select("fp", "doc_id", F.col("fp").alias("first_fp"))
    return merged.unionByName(alone)


def simhash_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``."""
    prints = materialize(add_fingerprints(doc_columns(docs), "fp", shingle).select("doc_id", "fp"), "simhash-docs")
    classes = fingerprint_components(prints, radius, blocks, chunk_rows)
    return few_files(prints.join(classes.select("fp", F.col("doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id"), prints.count())


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component its document with the smallest id.

    Of rows that share that id and fingerprint, one stays.
    """
    fp = "__fp"
    while fp in docs.columns:  # no column of the table is touched
        fp += "_"
    docs_fp = materialize(add_fingerprints(docs, fp, shingle), "simhash-rows")
    classes = fingerprint_components(docs_fp.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")), radius, blocks, chunk_rows)
    stay = classes.where(F.col("fp") == F.col("first_fp")).select(F.col("fp").alias("__stay_fp"), F.col("doc_id").alias("__stay_id"))
    on = (docs_fp[fp] == stay["__stay_fp"]) & docs_fp["doc_id"].cast("long").eqNullSafe(stay["__stay_id"])
    return docs_fp.join(stay, on, "left_semi").dropDuplicates(["doc_id", fp]).drop(fp)
