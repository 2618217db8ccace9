"""The corpus pipeline: documents in, packed sequences out.

Each stage takes the stored result of the one before it and decides over all of it: quality rules and toxicity
reject documents, SimHash leaves one document of each group of near duplicates, decontamination drops documents into
which a benchmark item leaks, and packing lays the rest out in sequences.  All but the last return the columns
of ``documents``.  A stage on an empty table gives an empty table; nulls, repeated rows and extra columns are treated as the
stage's operator says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from drainrules.llm import decontaminate, packing, quality, simhash, toxicity
from drainrules.llm.queries import TOXICITY_TARGET, table, toxicity_categories, with_digest
from drainrules.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), toxicity_categories(), TOXICITY_TARGET)
    return toxicity.keep_nontoxic(docs, chain)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL can express none of the stages after the base rules; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
