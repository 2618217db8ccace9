"""Helpers shared by the corpus operators: Arrow batches of texts and byte-level words.

Every operator reads its texts through Arrow batches of at most ``BATCH_ROWS`` rows,
so a Python worker never holds more than one such batch of whole texts.
"""

from __future__ import annotations

import gc
import math
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drainrules.session import workers_find_package

BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers at most ``BATCH_ROWS`` rows at a time (texts can be long)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def doc_columns(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of a documents table; null texts become empty, other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_arrow(
    df: DataFrame,
    batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    encodes: bool = False,
    looks_up: bool = False,
) -> DataFrame:
    """``mapInArrow`` with bounded batches.

    Python workers outlive a stage.  The caches of token encoders and the byte model's frequent grams, which they keep
    for their next task, are dropped where a stage does not encode (``encodes``) or look grams up (``looks_up``).
    """
    bounded_batches(df.sparkSession)
    workers_find_package(df.sparkSession)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, name, used in (("tokens", "encoder", encodes), ("lm", "frequent", looks_up)):
            cached = getattr(sys.modules.get(f"drainrules.llm.{module}"), name, None)
            if not used and cached is not None and cached.cache_info().currsize:
                cached.cache_clear()
                gc.collect()
                pa.default_memory_pool().release_unused()
        yield from batches(given)

    return df.mapInArrow(run, schema)


def lower_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8, with A-Z (and nothing else) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hash_sample(df: DataFrame, size: int, hashed: Column, *ties: str) -> DataFrame:
    """The ``size`` rows of the smallest hashes (all rows where there are no more).

    A cut at the hash value under which about twice as many rows are expected goes first, so that each
    task hands on a few rows, however many tasks there are.  Where many rows share a hash too few may lie under the cut:
    it is then widened until enough do.
    """
    n = df.count()
    share = min(1.0, 2 * size / max(1, n) + 1e-9)
    while True:
        cut = int(-(1 << 63) + share * ((1 << 64) - 1))
        few = df.where(hashed <= F.lit(min(cut, (1 << 63) - 1)))
        if share >= 1.0 or few.count() >= min(size, n):
            return few.orderBy(hashed, *ties).limit(size)
        share = min(1.0, 8 * share)


def shared_filesystem(folder: str):
    """``(file system, path)`` of a folder that all executors share."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ceil_div(value: Column, by: int) -> Column:
    return F.ceil(value / F.lit(by)).cast("int")


def blocks_of(n_rows: int, block_rows: int) -> int:
    """How many blocks of about ``block_rows`` rows hold ``n_rows`` rows (at least one)."""
    return max(1, math.ceil(n_rows / block_rows))
