"""The pipeline's stages, each on awkward rows and against what it must keep and drop."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.helpers import AWKWARD, documents
from tests.llm.test_scores import BYTE, check_packing, clean  # noqa: F401


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    good = [(i, clean(rng, 60 + i % 80), "en", "a", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in clean(rng).split()), "en", "a", 1) for i in range(20)]
    return good, junk


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then some")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage(spark, corpus, sf_dir):
    good, junk = corpus
    docs = documents(spark, good + junk)
    out = pipeline.quality_rules(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in good}


def test_near_dedup_stage(spark, corpus, sf_dir):
    good, _ = corpus
    copies = [(900, good[0][1], "en", "a", 1), (901, good[1][1] + " extra", "en", "a", 1), good[2], (None, good[3][1], "en", "a", 1)]
    docs = documents(spark, copies + good)
    out = pipeline.near_dedup(spark, docs, sf_dir)
    assert rows(out) == rows(documents(spark, good))
    alone = documents(spark, [(None, good[0][1]), (None, "another text"), (None, "another text"), (5, None), (6, "")])
    kept = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, alone, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(None, good[0][1]), (None, "another text"), (5, None), (6, "")], key=str)


def test_decontamination_stage(spark, corpus, sf_dir):
    good, _ = corpus
    bad = "x The quick, brown fox jumps over the lazy dog AND y"
    docs = documents(spark, [*good, (901, bad), (None, bad), (902, "the quick brown fox"), (None, "fine")])
    out = pipeline.decontaminate(spark, docs, sf_dir)
    assert rows(out) == rows(documents(spark, [*good, (902, "the quick brown fox"), (None, "fine")]))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, sf_dir, name):
    stage = dict(pipeline.STAGES)[name]
    assert stage(spark, documents(spark, []), sf_dir).count() == 0
    out = stage(spark, documents(spark, AWKWARD), sf_dir)
    if name != "packing":
        assert out.columns == documents(spark, []).columns
    assert out.count() <= 200


def test_run_is_its_stages(spark, corpus, sf_dir):
    good, junk = corpus
    table = documents(spark, [*good, *junk, (900, good[0][1], "en", "a", 1)])
    table.write.parquet(f"{sf_dir}/documents.parquet")
    got = pipeline.run(spark, sf_dir).collect()
    bins, least = check_packing([r[:2] for r in good], got, 1024)
    assert bins <= least + 3


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
