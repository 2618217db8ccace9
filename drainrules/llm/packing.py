"""Cost-balanced packing of token ids into sequences of a fixed capacity.

Method: a document costs ``linear * n + quadratic * n**2`` (projections grow with its tokens,
attention with their square).  Documents are taken longest first, and each goes to the
sequence of lowest cost so far that still has room for it.

Each task packs its own documents in blocks of about ``block_tokens`` tokens, so nothing is
shuffled, memory is bounded by one block plus one document, and a lost task redoes only its
own partition.  Inside a block:

* a document longer than the capacity first gives whole sequences of its own; what is left
  joins the other documents of the block;
* the block opens ``total // capacity`` sequences of full capacity, and for the remaining tokens
  one sequence per power of two in their count, so that the capacities add up to the tokens
  and **no sequence is padded** (lengths are the capacity or a power of two);
* where no sequence has room for a whole document, the one of lowest cost takes what it can
  hold, and the rest of the document goes on by the same rule.

Nulls and odd input: a null text is empty (its document is the end id alone); null ids and
repeated rows are packed as any other row; an empty table gives no rows; other columns
are left behind.  Ties in length keep the order of the block's rows, ties in cost go to the
sequence opened first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from drainrules.llm.common import doc_columns, map_arrow
from drainrules.llm.tokens import encoder

CAPACITY = 2048
BLOCK_TOKENS = 1 << 19
END_ID = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 4096

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def plan_block(
    lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset, sequence length)`` of a block.

    ``lengths`` are the tokens of the block's documents; sequences count from 0.
    """
    pieces = []
    rest = []
    n_seq = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, n_seq, 0, capacity))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, doc, n - n % capacity))
    total = sum(r[0] for r in rest)
    sizes = [capacity] * (total // capacity)
    sizes += [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room = np.array(sizes, dtype=np.int64)
    cost = np.zeros(len(sizes))
    rest.sort(key=lambda r: -r[0])
    for n, doc, start in rest:
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room)
            seq = int(fits[np.argmin(cost[fits])])
            take = min(n, int(room[seq]))
            pieces.append((doc, start, take, n_seq + seq, sizes[seq] - int(room[seq]), sizes[seq]))
            room[seq] -= take
            cost[seq] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return pieces


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Pieces of all documents with their ids (``binary``, little-endian unsigned 32-bit).

    ``sequence_id`` is the task's partition number in the upper bits and a counter below.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in
                            ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens")])
        block: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            rows = plan_block([len(ids) // 4 for _, ids in block], capacity, linear, quadratic)
            out = [
                [block[d][0] for d, *_ in rows],
                [r[1] for r in rows],
                [r[2] for r in rows],
                [block[d][1][4 * s : 4 * (s + n)] for d, s, n, *_ in rows],
                [len(block[d][1]) // 4 for d, *_ in rows],
                [base + r[3] for r in rows],
                [r[4] for r in rows],
                [r[5] for r in rows],
            ]
            base += 1 + max((r[3] for r in rows), default=-1)
            block.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, tokens in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1)), strict=True):
                ids = tokens + end
                block.append((doc_id, ids))
                held += len(ids) // 4
                if held >= block_tokens:
                    yield flush()
        if block:
            yield flush()

    return map_arrow(doc_columns(docs), pack, SCHEMA, encodes=True)
