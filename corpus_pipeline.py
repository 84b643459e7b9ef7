"""A corpus preparation pipeline: each stage works on all rows that the one before kept.

Language ID drops what is in no language; near-duplicates leave one document of each group; passages of earlier
documents are cut out; sources are mixed to target weights, by dropping and repeating documents; sequences are packed.

Defined cases by stage. Language ID drops null texts and texts without a letter or a known n-gram; null and repeated ids don't
matter to it. Near-duplicates keep all rows without id or words, the row with the smallest id of each group, of rows that
share that id the one of the smallest text hash, of rows equal in id and text the one that is first as JSON; unlinked texts under
one id all stay. Passages: rows with null ids lose nothing and take nothing from others, rows that share an id
take nothing from each other; null texts stay null. Mixing takes every row by itself; a null source is a source of its own. Packing has
a null text as an empty one; rows that share an id have pieces each. Every stage takes empty tables and extra columns of
any name, and all but the last keep the columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import language_id, minhash, mixing, packing, suffix_dedup
from halyard.llm.common import Scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language."""
    model = language_id.fit_language_filter(docs.where(~language_id.held_out("doc_id")))
    return language_id.accept_languages(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of documents with smaller ids."""
    cut = suffix_dedup.drop_repeated_passages(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages need tokens, hashes and components that SQL can't express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.save(out, name) if i < len(STAGES) - 1 else out
    return docs
