"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record file holds one frame per document::

    length of the payload    8 bytes, little endian
    masked CRC of those      4 bytes
    payload                  the ids: 16 bit where the vocabulary allows, else 32 bit
    masked CRC of it         4 bytes

The mask is the usual one for stored checksums (rotate by 15 bits, add a constant); the CRC is
zlib's CRC-32.  Documents are dealt by ranges of ``doc_id``, sorted inside each
range, and each task writes the file of its range, so that files in order of their part
number hold all documents in ascending order.  The index, a Parquet table beside
the files, has for each document its file, position, ids before it in the file and id count.
Readers take any set of index rows in any order and read just those frames.

A task names its file after itself and its attempt, and the index keeps only rows
of attempts that were committed: a repeated or lost task leaves at most a file that no index
row points to.

Nulls and odd input: a null text is empty (the end id alone); rows with a null id come first;
rows with equal ids follow each other in the order of a hash of their texts; an empty
table gives an empty index; other columns are left behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drainrules.llm.common import doc_columns, map_arrow, shuffle_partitions
from drainrules.llm.tokens import encoder

END_ID = 1
MASK_DELTA = 0xA282EAD8  # fixed value of the checksum mask
READ_SPAN = 8 << 20  # neighbouring frames are read together up to this many bytes

INDEX_SCHEMA = "doc_id long, part int, file string, position long, bytes long, id_bytes int, start_in_part long, n_tokens long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def unframe(data: bytes) -> bytes:
    """The payload of a frame; raises where a length or checksum does not hold."""
    head = data[:8]
    n = int.from_bytes(head, "little")
    if masked_crc(head) != int.from_bytes(data[8:12], "little") or len(data) != n + 16:
        raise ValueError("damaged record: its length does not hold")
    payload = data[12 : 12 + n]
    if masked_crc(payload) != int.from_bytes(data[12 + n :], "little"):
        raise ValueError("damaged record: its checksum does not hold")
    return payload


def _filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write all documents to ``folder`` (shared by all executors) and return the stored index."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kind = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype=kind).tobytes()
        task = TaskContext.get()
        part = task.partitionId()
        file = f"part-{part:05d}-{task.attemptNumber()}-{uuid.uuid4().hex}.rec"
        out, position, start = None, 0, 0
        try:
            for batch in batches:
                if out is None:
                    system, root = _filesystem(folder)
                    system.create_dir(f"{root}/data", recursive=True)
                    out = system.open_output_stream(f"{root}/data/{file}")
                ids = batch.column(0).to_pylist()
                rows: tuple[list, ...] = ([], [], [], [])
                for tokens in enc.encode_many(batch.column(1)):
                    n_tokens = len(tokens) // 4 + 1
                    data = frame(np.frombuffer(tokens, dtype="<u4").astype(kind).tobytes() + end)
                    out.write(data)
                    for column, value in zip(rows, (position, len(data), start, n_tokens), strict=True):
                        column.append(value)
                    position += len(data)
                    start += n_tokens
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([file] * n),
                     pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array([int(kind[-1])] * n, pa.int32()),
                     pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                    names=["doc_id", "part", "file", "position", "bytes", "id_bytes", "start_in_part", "n_tokens"],
                )
        finally:
            if out is not None:
                out.close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    dealt = (
        doc_columns(docs)
        .withColumn("text_hash", F.xxhash64("text"))
        .repartitionByRange(parts or shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    map_arrow(dealt, write, INDEX_SCHEMA, encodes=True).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def with_global_start(index: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before a document.

    The driver sees one sum per part (their number is the number of tasks, not of rows).
    """
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for r in sums:
        bases.append((r["part"], base))
        base += r["n"]
    before = index.sparkSession.createDataFrame(bases, "part int, base long")
    return index.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The ids (``binary``, little-endian unsigned 32-bit) of the documents of some index rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = None, ""
        open_file, name = None, None
        for batch in batches:
            if system is None:
                system, root = _filesystem(folder)
            files, at, size, width = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "position", "bytes", "id_bytes"))
            order = sorted(range(len(files)), key=lambda i: (files[i], at[i]))
            ids: list[bytes] = [b""] * len(files)
            i = 0
            while i < len(order):
                first = order[i]
                end = at[first] + size[first]
                j = i + 1
                while j < len(order) and files[order[j]] == files[first] and at[order[j]] == end and end - at[first] < READ_SPAN:
                    end += size[order[j]]
                    j += 1
                if files[first] != name:
                    if open_file is not None:
                        open_file.close()
                    name = files[first]
                    open_file = system.open_input_file(f"{root}/data/{name}")
                open_file.seek(at[first])
                data = open_file.read(end - at[first])
                for k in order[i:j]:
                    payload = unframe(data[at[k] - at[first] : at[k] - at[first] + size[k]])
                    ids[k] = np.frombuffer(payload, f"<u{width[k]}").astype("<u4").tobytes()
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])
        if open_file is not None:
            open_file.close()

    return map_arrow(index, read, T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())]))
