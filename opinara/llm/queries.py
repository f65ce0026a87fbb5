"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import checks
from opinara.llm.decontaminate import contamination
from opinara.llm.html_text import extract_text
from opinara.llm.importance import resample
from opinara.llm.languages import predict_languages
from opinara.llm.licenses import scan_licenses
from opinara.llm.near_dup import THREE_WORDS, near_duplicates
from opinara.llm.packing import pack_documents
from opinara.llm.quality import quality
from opinara.llm.records import index_records, record_table, write_records
from opinara.llm.registry import CHECKS, QUERIES, table
from opinara.llm.spelling import group_variants
from opinara.llm.suffix_tree import score_texts
from opinara.llm.token_counts import count_tokens
from opinara.llm.url_filter import judge_urls, path_of
from opinara.llm.tokenizing import BYTE_BPE, WORD_BPE, vocabulary_path
from opinara.session import scratch_path

END_ID = 2  # closes a document in the packed and written sequences


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged; a page is labelled as the document is whose number its path has."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    urls = pages.select("url", number.alias("n")).selectExpr("url", "try_cast(n AS BIGINT) AS doc_id")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return judge_urls(pages, urls.join(labels, "doc_id"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), THREE_WORDS)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE), END_ID)


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    vocabulary = vocabulary_path(BYTE_BPE)
    write_records(table(spark, sf_dir, "documents"), f"{path}/data", vocabulary, END_ID)
    index_records(spark, f"{path}/data", f"{path}/index")
    rows = record_table(spark, f"{path}/index")
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents, drawn towards the word runs of the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones outside the held-out fold."""
    return predict_languages(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents under the form that each is a variant of."""
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES |= {
    "op1_url_filter": op1_url_filter,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_licenses": op5_licenses,
    "op6_html_text": op6_html_text,
    "op7_packing": op7_packing,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_quality": op9_quality,
    "op10_records": op10_records,
    "op11_resampling": op11_resampling,
    "op12_languages": op12_languages,
    "op13_spelling": op13_spelling,
}
CHECKS |= {
    "op1_url_filter": checks.URL_FILTER,
    "op2_near_duplicates": checks.NEAR_DUPLICATES,
    "op3_decontamination": checks.CONTAMINATION,
    "op11_resampling": checks.RESAMPLING,
    "op13_spelling": checks.SPELLING,
}


def load():
    """All queries and all checks, by name."""
    return dict(QUERIES), dict(CHECKS)
