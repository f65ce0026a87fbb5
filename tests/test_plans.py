"""Physical plans keep the shape that scales."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from opinara.plans.base import QUERIES

entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_plans(spark, data):
    slow = {"c1_logistic_regression", "c2_linear_svm", "c3_naive_bayes", "c4_random_forest",
            "c6_train_all", "c7_density_ratio", "s7_model_round_trip", "o2_isolation_forest",
            "v2_fit_transform"}
    for name in sorted(set(QUERIES) - slow):
        text = plan(QUERIES[name](spark, data))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_only_what_is_asked(spark, data):
    from opinara.operators.sampling import top_values
    from opinara.sources.files import read_table

    text = plan(top_values(read_table(spark, data, "documents"), "lang"))
    assert "ReadSchema: struct<lang:string>" in text
    text = plan(QUERIES["l5_hint_sentence"](spark, data))
    assert re.search(r"PushedFilters: \[.*EqualTo\(lang,fr\)", text)


def test_hints_need_no_shuffle_and_no_python(spark, data):
    from opinara.functions.lexicons import FRENCH_LEXICON
    from opinara.functions.labels import keyword_hint
    from opinara.functions.text import clean_review
    from opinara.sources.files import read_table

    docs = read_table(spark, data, "documents")
    cleaned = docs.select("doc_id", clean_review(F.col("text"), True).alias("c"))
    text = plan(cleaned.select("doc_id", keyword_hint(F.col("c"), FRENCH_LEXICON).alias("hint")))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("regexp_replace") <= 2  # cleaned once


def test_labels_are_not_computed_for_positions(spark, data):
    """The branch that counts blocks reads ids only."""
    text = plan(QUERIES["j1_combine_sources"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_no_one_task_window_over_rows(spark, data):
    """Positions never put the source rows in a window without a partition key."""
    for name in ("r3_shuffle", "r8_batches", "d15_pack_wrapped", "r1_sample_exact"):
        text = plan(QUERIES[name](spark, data))
        for line in text.splitlines():
            if "Exchange SinglePartition" in line:
                assert "text" not in line


def test_labelled_corpus_is_one_scan(spark, data):
    for name in ("l10_label_reviews", "label_counts_by_language"):
        assert plan(QUERIES[name](spark, data)).count("FileScan parquet") == 1, name
