from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.operators import filters as fl
from opinara.operators import labeling as lab
from opinara.operators import ordering as od
from opinara.operators import sampling as sm


def skewed(spark, n=6000):
    """A third of the rows share one class, and another third one text."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("label"),
        F.when(F.col("id") % 3 == 1, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )


@pytest.mark.parametrize("parts", [1, 8])
def test_positions_equal_a_plain_window(spark, parts):
    from pyspark.sql import Window

    df = skewed(spark).repartition(parts)
    key = od.hash_key(42, F.col("id"))
    plain = Window.partitionBy("label").orderBy(key, "id")
    want = df.withColumn("position", F.row_number().over(plain).cast("bigint"))
    got = od.hash_positions(df, "id", 42, ["label"])
    assert got.select("id", "position").exceptAll(want.select("id", "position")).count() == 0
    assert got.count() == 6000


def test_positions_of_sparse_and_negative_ids(spark):
    ids = [-(2**50), -5, 0, 3, 65_536, 2**33, 2**41 + 1, 2**60]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(4)
    got = od.id_positions(df, "id").orderBy("id").collect()
    assert [r["position"] for r in got] == list(range(1, len(ids) + 1))


def test_null_part_is_a_part(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "id bigint, p string")
    got = {r["id"]: r["position"] for r in od.id_positions(df, "id", ["p"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_double_digits_never_decrease(spark):
    values = [-1e300, -7.5, -7.25, -1e-300, -0.0, 1e-300, 0.1, 0.10000001, 3, 4, 4.0001, 1e300]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    digits = [r[0] for r in df.select(*od.double_digits(F.col("v"))).collect()]
    assert digits == sorted(digits)


def test_lookup_join_keeps_hot_and_cold_rows(spark):
    left = skewed(spark).select("id", "label")
    table = left.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 10)
    got = od.lookup_join(left, table, "label", "n", ["v"], F.lit(6000))
    assert got.count() == 6000
    assert got.where("v IS NULL").count() == 0
    assert got.where("label = 'hot' AND v <> 20000").count() == 0


def test_dedupe_keeps_first_and_null_once(spark):
    df = skewed(spark).unionByName(
        spark.createDataFrame([(9001, "x", None), (9000, "x", None)], "id bigint, label string, text string")
    )
    got = fl.dedupe_first(df, "text", "id")
    want = df.groupBy("text").agg(F.min("id").alias("id")).select("id")
    assert got.select("id").exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_dedupe_runs_before_strip(spark):
    df = spark.createDataFrame(
        [(1, "good food", "Prix"), (2, "good food ", "Prix"), (3, "ok", "Prix"), (4, "good food", "Prix")],
        "id bigint, text string, Critere string",
    )
    got = lab.clean_corpus(df).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in got] == [(1, "good food"), (2, "good food")]


def test_short_abusive(spark):
    df = spark.createDataFrame([("merde",), ("second",), ("con artist bad deal",), ("très bon",)], "text string")
    assert [r[0] for r in fl.drop_short_abusive(df, "text").collect()] == ["con artist bad deal", "très bon"]
    whole = [r[0] for r in fl.drop_short_abusive(df, "text", whole_word=True).collect()]
    assert whole == ["second", "con artist bad deal", "très bon"]


def test_sample_is_exact_and_stable(spark):
    df = skewed(spark)
    first = {r["id"] for r in sm.sample_n(df.repartition(1), 500, 7, "id").collect()}
    again = {r["id"] for r in sm.sample_n(df.repartition(8), 500, 7, "id").collect()}
    assert first == again and len(first) == 500
    assert sm.sample_n(df, 10_000, 7, "id").count() == 6000


SUPPORTS = [11, 519, 60, 415, 51, 71, 21, 60, 11, 67, 16, 628, 96, 195, 579]
VALIDATION = [9, 416, 48, 332, 41, 57, 17, 47, 9, 54, 13, 502, 76, 156, 463]


def test_split_quotas(spark):
    """Class sizes of five times the published test supports."""
    rows = [(c, 5 * n) for c, n in zip(lx.EVALUATION_TAXONOMY, SUPPORTS)]
    classes = spark.createDataFrame(rows, "label string, n bigint")
    numbered = classes.select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    df = numbered.select("label", F.xxhash64("label", "i").alias("id"))
    got = sm.stratified_split(df, "label", "id").groupBy("split", "label").count().collect()
    sizes = {(r["split"], r["label"]): r["count"] for r in got}
    for label, test, val in zip(lx.EVALUATION_TAXONOMY, SUPPORTS, VALIDATION):
        assert sizes["test", label] == test
        assert abs(sizes["val", label] - val) <= 1
    assert sum(n for (s, _), n in sizes.items() if s == "test") == 2800
    assert sum(n for (s, _), n in sizes.items() if s == "val") == 2240
    assert sum(sizes.values()) == 14_000


def test_split_is_stable_over_partitions(spark):
    df = skewed(spark).select("id", "label")
    one = sm.stratified_split(df.coalesce(1), "label", "id")
    eight = sm.stratified_split(df.repartition(8), "label", "id")
    assert one.exceptAll(eight).count() == 0


def test_downsample_keeps_nulls(spark):
    df = skewed(spark).withColumn("label", F.when(F.col("label") != "1", F.col("label")))
    got = sm.downsample_class(df, "label", "hot", 0.05, 1, "id").groupBy("label").count().collect()
    sizes = {r["label"]: r["count"] for r in got}
    assert sizes["hot"] == 100
    assert sizes[None] == df.where("label IS NULL").count()


def test_mirrored_batches(spark):
    df = spark.range(7).select("id", (F.col("id") * 10).alias("y"))
    got = sm.mismatched_pairs(df, 3, "id", ["y"]).orderBy("id").collect()
    assert [r["KL_y"] for r in got] == [20, 10, 0, 50, 40, 30, 60]
    assert [r["self_paired"] for r in got] == [False, True, False, False, True, False, True]
    with pytest.raises(ValueError):
        sm.mismatched_pairs(df, 1, "id", ["y"])


def test_expansion_without_exemplar(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None)], "id bigint, t string, l string")
    got = sm.expansion_plan(df, "l", "t", "id", 10, ["A", "B"], 1)
    assert got.count() == 10
    assert {r["exemplar"] for r in got.where("l IS NULL").collect()} == {"Standard review"}


def test_expansion_reads_its_corpus_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def named(texts):
        for batch in texts:
            seen.add(len(batch))
            yield batch.str[:1]

    named.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    df = spark.createDataFrame([(i, f"{'ab'[i % 2]} text {i}") for i in range(40)], "id bigint, text string")
    df = df.withColumn("criteria", F.pandas_udf(named, "string")("text"))
    got = lab.expand_corpus(df, lambda prompts: prompts.map(lambda p: "a new review"), 10, ["A"], 1).collect()
    assert seen.value == 40
    assert len(got) == 50
    assert sorted(r["shuffle_pos"] for r in got) == list(range(1, 51))


def test_labeler_failures_take_the_fallback(spark):
    df = spark.createDataFrame([(1, "le plat"), (2, "boom"), (3, "prix")], "id bigint, text string")

    def flaky(prompts):
        if prompts.str.contains("boom").any():
            raise RuntimeError("down")
        return prompts.map(lambda p: "Service")

    got = {r["id"]: r["criteria"] for r in lab.label_reviews(df, lab.FRENCH, labeler=flaky).collect()}
    assert got == {1: "Service", 2: "Global_experience", 3: "Service"}


def test_columns_attached_by_position(spark):
    left = spark.createDataFrame([(-5, "a"), (70_000, "b"), (9, None), (10**12, "d")], "k long, x string").repartition(3)
    right = spark.createDataFrame([(4, 40), (1, 10), (3, None), (2, 20)], "p int, y int").repartition(2)
    got = od.attach_columns(left, right, "k", "p")
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == [(-5, "a", 10), (9, None, 20), (70_000, "b", None), (10**12, "d", 40)]
    assert od.attach_columns(left.limit(0), right.limit(0), "k", "p").collect() == []


def test_tables_that_cannot_be_attached(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    for right in (
        spark.createDataFrame([(1, 5)], "p long, y int"),  # too short
        spark.createDataFrame([(1, 5), (1, 6)], "p long, y int"),
        spark.createDataFrame([(1, 5), (None, 6)], "p long, y int"),
        spark.createDataFrame([(1, 5), (2, 6)], "p long, X int"),
    ):
        with pytest.raises(ValueError):
            od.attach_columns(left, right, "k", "p")
