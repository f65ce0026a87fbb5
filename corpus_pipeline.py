"""Corpus preparation: quality rules, near-duplicates, benchmark passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` applies them
to ``documents``; each stage's rows are written to the shared folder and read again as
the next one's. Rows are told apart by ``doc_id`` and text: rows equal in both are one
document, of which near-dedup keeps one row; a null ``doc_id`` is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.batches import materialize
from opinara.llm.decontaminate import contamination
from opinara.llm.near_dup import near_duplicates
from opinara.llm.packing import pack_documents
from opinara.llm.quality import keep_good
from opinara.llm.tokenizing import BYTE_BPE, vocabulary_path

END_ID = 2


def row_key():
    """Sorts by ``doc_id``, then text digest; for any type of either column."""
    number = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~"))
    return F.concat(number, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("doc_id"), "text")


def keep(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose key is in the table ``(row_key)``; ``once``: one row a key."""
    names = docs.columns
    rows = docs.select(row_key().alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    kept = rows.join(keys, "row_key", "left_semi")
    if once:
        kept = kept.groupBy("row_key").agg(F.first("doc").alias("doc"))
    return kept.select(*(F.col("doc")[c].alias(c) for c in names))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the outlier test reject."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets link at 0.8 or more.

    Texts without words are linked with nothing and stay; of rows equal in id and text
    one stays.
    """
    verdicts = near_duplicates(keyed(docs))
    keys = verdicts.where("kept").select(F.col("doc_id").alias("row_key"))
    return keep(docs, keys, once=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten consecutive words of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    verdicts = contamination(keyed(docs), benchmark)
    clean = verdicts.where("NOT contaminated").select(F.col("doc_id").alias("row_key")).distinct()
    return keep(docs, clean)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack_documents(docs, vocabulary_path(BYTE_BPE), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

# Token packing and robust estimates are beyond SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
