import numpy as np
import pandas as pd
import math

import pytest
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.operators import correlation as co
from opinara.operators import features as ft
from opinara.operators import labeling as lab
from opinara.operators import metrics as mt
from opinara.operators import models as md
from opinara.operators import outliers as ol
from opinara.operators import profiling as pf
from opinara.operators import tuning as tn


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "id": range(400),
            "a": rng.integers(0, 9, 400).astype(float),
            "b": np.round(rng.normal(0, 50, 400), 1),
            "c": rng.exponential(3, 400),
        }
    )
    pdf.loc[::3, "a"] = 4.0  # a third of the rows share one value
    pdf.loc[5, "b"] = np.nan
    pdf["b2"] = pdf["b"] * 2 + rng.normal(0, 5, 400)
    return pdf, spark.createDataFrame(pdf).repartition(4).persist()


def test_profile_matches_pandas(numbers):
    pdf, df = numbers
    rows = {r["column"]: r for r in pf.profile(df.select("a", "b", "c")).collect()}
    for c in "abc":
        s = pdf[c]
        want = {
            "n_missing": s.isna().sum(), "n_unique": s.nunique(), "mean": s.mean(), "std": s.std(),
            "min": s.min(), "max": s.max(), "q25": s.quantile(0.25), "median": s.median(),
            "q75": s.quantile(0.75), "skew": s.skew(), "kurtosis": s.kurtosis(),
        }
        for k, v in want.items():
            assert rows[c][k] == pytest.approx(v, rel=1e-9, abs=1e-9), (c, k)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, None), (1.0, None)], "x double, y string")
    rows = {r["column"]: r for r in pf.profile(df).collect()}
    assert rows["x"]["is_constant"] and rows["x"]["skew"] == 0 and rows["x"]["kurtosis"] == 0
    assert rows["y"]["n_unique"] == 0 and rows["y"]["mode"] is None and rows["y"]["missing_pct"] == 100


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_match_pandas(numbers, method):
    pdf, df = numbers
    cols = ["a", "b", "c", "b2"]
    complete = pdf[cols].dropna()
    if method == "spearman":
        complete, method_ = complete.rank(), "pearson"
    else:
        method_ = method
    want = complete.corr(method=method_)
    for r in co.correlations(df, cols, method).collect():
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-12)


def brute_tau(x, y):
    s = nx = ny = 0
    for i in range(len(x)):
        dx, dy = np.sign(x[i] - x[:i]), np.sign(y[i] - y[:i])
        s += (dx * dy).sum()
        nx += (dx != 0).sum()
        ny += (dy != 0).sum()
    return s / np.sqrt(float(nx) * float(ny))


def test_kendall_matches_brute_force(numbers):
    pdf, df = numbers
    cols = ["a", "b", "c"]
    complete = pdf[cols].dropna()
    for r in co.kendall(df, cols).collect():
        want = brute_tau(complete[r["a"]].to_numpy(), complete[r["b"]].to_numpy())
        assert r["r"] == pytest.approx(want, abs=1e-12)


def test_histogram_counts_everything(numbers):
    pdf, df = numbers
    bins = pf.histogram(df, "c").orderBy("bin").collect()
    edges = np.histogram_bin_edges(pdf["c"], bins="auto")
    counts, _ = np.histogram(pdf["c"], bins=edges)
    assert [r["n"] for r in bins] == counts.tolist()
    assert sum(r["n"] for r in pf.histogram(df, "b").collect()) == 399


def test_density_integrates_to_one(numbers):
    _, df = numbers
    curve = pf.density(df, "b").orderBy("point").toPandas()
    area = np.trapezoid(curve["density"], curve["x"])
    assert 0.9 < area < 1.0 + 1e-6


def test_box_and_fences(numbers):
    pdf, df = numbers
    s = pdf["c"]
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    row = pf.box_summary(df, ["c"]).first()
    assert row["n_outside"] == ((s < low) | (s > high)).sum()
    assert row["whisker_high"] == s[s <= high].max()
    assert ol.iqr_outliers(df, ["c"]).count() == row["n_outside"]


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(1000), "x": rng.normal(size=1000), "y": rng.normal(size=1000)})
    pdf.loc[:9, ["x", "y"]] = 9.0 + rng.normal(0, 0.5, (10, 2))
    df = spark.createDataFrame(pdf)
    out = ol.isolation_forest(df, ["x", "y"], "id", trees=50).toPandas()
    flagged = set(out[out["iso_label"] == -1]["id"])
    assert len(flagged) == 50
    assert set(range(10)) <= flagged
    again = ol.isolation_forest(df.repartition(5), ["x", "y"], "id", trees=50).toPandas()
    assert set(again[again["iso_label"] == -1]["id"]) == flagged


SUPPORTS = [11, 519, 60, 415, 51, 71, 21, 60, 11, 67, 16, 628, 96, 195, 579]


def test_scores_of_a_constant_predictor(spark):
    """Every answer unusable: the score is the share of the fallback class."""
    labels = lx.EVALUATION_TAXONOMY
    sizes = spark.createDataFrame(list(zip(labels, SUPPORTS)), "y_true string, n int")
    df = sizes.select("y_true", F.lit(lx.FALLBACK).alias("y_pred"), F.explode(F.sequence(F.lit(1), "n")))
    assert round(mt.accuracy(df).first()["accuracy"], 4) == 0.2243
    assert mt.fallback_rate(df, lx.FALLBACK).first()[0] == 1.0
    report = {r["label"]: r for r in mt.classification_report(df, labels).collect()}
    assert [report[x]["support"] for x in labels] == SUPPORTS
    row = report[lx.FALLBACK]
    assert (round(row["precision"], 2), row["recall"], round(row["f1"], 2)) == (0.22, 1.0, 0.37)
    assert report["Price"]["f1"] == 0
    means = {r["average"]: r for r in mt.report_averages(df, labels).collect()}
    assert [round(means["macro avg"][c], 2) for c in ("precision", "recall", "f1")] == [0.01, 0.07, 0.02]
    assert [round(means["weighted avg"][c], 2) for c in ("precision", "recall", "f1")] == [0.05, 0.22, 0.08]
    matrix = mt.confusion_matrix(df, labels)
    assert matrix.count() == 225 and matrix.agg(F.sum("n")).first()[0] == 2800


def test_report_on_a_small_table(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", None)]
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    report = {r["label"]: r for r in mt.classification_report(df, ["a", "b", "c"]).collect()}
    assert (report["a"]["precision"], report["a"]["recall"]) == (1.0, 0.75)
    assert (report["b"]["precision"], report["b"]["recall"]) == (2 / 3, 2 / 3)
    assert report["c"]["support"] == 0
    assert mt.accuracy(df).first()["accuracy"] == pytest.approx(5 / 7)


def test_classifiers_learn_and_survive_saving(spark, tmp_path):
    from opinara.sources.files import load_model, save_model

    words = {"Price": "cheap price cost", "Service": "staff agent rude", "Delay": "late slow waiting"}
    rows = [
        (i, f"{w.split()[i % 3]} {w.split()[(i + 1) % 3]} word{i % 5}", c)
        for i in range(60)
        for c, w in words.items()
    ]
    df = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "id bigint, text string, criteria string")
    fitted = md.fit_classifiers(df, settings={"rf": {"numTrees": 10, "maxDepth": 5}})
    for name, model in fitted.items():
        assert mt.accuracy(md.predict(model, df, "id")).first()["accuracy"] > 0.95, name
    save_model(fitted["nb"], str(tmp_path / "nb"))
    back = load_model(str(tmp_path / "nb"))
    assert mt.accuracy(md.predict(back, df, "id")).first()["accuracy"] > 0.95


def test_vector_tfidf_equals_relational_tfidf(spark, data):
    from pyspark.ml.functions import vector_to_array

    from opinara.operators import features as ft

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = ft.fit_tfidf(docs)
    words = model.stages[2].vocabulary
    vec = model.transform(docs).select("doc_id", vector_to_array("features").alias("v")).orderBy("doc_id").limit(5)
    rel = {(r["doc_id"], r["term"]): r["w"] for r in ft.tfidf_terms(docs, "doc_id", "text").where("doc_id < 5").collect()}
    for r in vec.collect():
        own = {words[i]: w for i, w in enumerate(r["v"]) if w}
        want = {t: w for (k, t), w in rel.items() if k == r["doc_id"]}
        assert own.keys() == want.keys()
        for term, w in own.items():
            assert w == pytest.approx(want[term], rel=1e-9)


def awkward_texts(spark):
    rng = np.random.default_rng(8)
    words = ["aa", "bb", "É1", "dd_", "x", "日本", "aa.bb"]
    rows = [(int(i) if i % 9 else None, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(90)]
    rows += [(1, None), (2, ""), (5, "aa bb aa"), (5, "aa bb aa"), (5, "bb aa")]
    return spark.createDataFrame(rows, "k long, text string").repartition(5)


def test_term_counts_equal_counts_of_each_row(spark):
    """Runs counted once for all sizes against terms counted inside each row."""
    docs = awkward_texts(spark)
    numbered = docs.withColumn("k", F.monotonically_increasing_id()).persist()
    for sizes in ((1, 2), (2,), (1, 3), (3, 1, 2)):
        rows = ft.document_counts(numbered, "k", "text", sizes)
        want = rows.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        got = ft.term_counts(numbered, "text", sizes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), sizes


def test_document_frequencies_shuffle_no_pairs(spark):
    """Rows of one key, or without one, are one document; only their pairs are shuffled."""
    docs = awkward_texts(spark)
    got = ft.document_frequencies(docs, "k", "text")
    want = ft.document_terms(docs, "k", "text").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    alone = docs.withColumn("k", F.monotonically_increasing_id())
    assert sum(ft.document_frequencies(alone, "k", "text").toPandas()["n"]) == ft.document_terms(alone, "k", "text").distinct().count()


def test_rows_of_a_class_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select((F.col("id") % 50 == 0).cast("int").alias("c"), "id").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighted = md.add_balanced_weight(rows, "c")
        sizes = weighted.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sorted({round(r["weight"], 6) for r in weighted.collect()}) == [round(4000 / (2 * 3920), 6), 25.0]
        assert max(r["count"] for r in sizes) <= 1100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_user_callables_get_slices_of_bounded_text(spark):
    """Many long texts in one Arrow batch reach a callable in several calls."""
    long = spark.range(40).select("id", F.repeat(F.lit("word "), 40_000).alias("text")).coalesce(1)

    def calls(values):
        assert sum(map(len, values)) <= 1_000_000
        return pd.Series([[str(len(v))] for v in values])

    def once(values):
        assert sum(map(len, values)) <= 1_000_000
        return values.map(lambda v: str(len(v)))

    assert {r["text"] for r in tn.format_rows(long, calls, "text").collect()} == {"200000"}
    assert {r["answer"] for r in lab.ask(long, once, "text").collect()} == {"200000"}

    def encode(texts):
        assert sum(map(len, texts)) <= 1_000_000
        return [[len(t)] for t in texts]

    coded = tn.user_tokenizer(encode, batched=True)
    both = long.select(coded(F.col("text")).alias("a"), coded.each(F.array("text")).alias("b")).collect()
    assert len(both) == 40 and {(tuple(r["a"]), tuple(r["b"][0])) for r in both} == {((200_000,), (200_000,))}


def test_most_frequent_against_a_sort(spark):
    from opinara.operators import features as ft

    counts = spark.range(1, 3000).select(
        F.concat(F.lit("t"), F.col("id")).alias("term"),
        F.floor(3000 / F.col("id")).alias("total"),
        F.lit(1).alias("df"),
    )
    for k in (1, 7, 500, 5000):
        want = counts.orderBy(F.desc("total"), "term").limit(k).collect()
        assert sorted(ft.most_frequent(counts, "total", "term", k).collect()) == sorted(want)


def largest_blocks(df, digits):
    """Most rows below one prefix of digits, and most next digits below it, per level."""
    names = [f"d{i}" for i in range(len(digits))]
    keyed = df.select(*[d.alias(n) for d, n in zip(digits, names)])
    out = []
    for depth in range(len(names)):
        wide = keyed.select(*names[: depth + 1]).distinct()
        below = wide.groupBy(*names[:depth]).count() if depth else wide.agg(F.count(F.lit(1)).alias("count"))
        out.append(below.agg(F.max("count")).first()[0])
    out.append(keyed.groupBy(*names).count().agg(F.max("count")).first()[0])
    return out


def test_histogram_of_a_heavy_tail(spark):
    rows = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"))
    tail = rows.unionAll(spark.createDataFrame([(3e6,)], "x double"))
    bins = pf.histogram(tail, "x")
    total = bins.agg(F.sum("n"), F.count(F.lit(1))).first()
    assert total[0] == 2001 and total[1] > 100_000


def test_no_window_grows_with_sparse_ids_or_narrow_numbers(spark):
    from opinara.operators import ordering as od

    ids = spark.range(400_000).select(F.xxhash64("id").alias("x"))
    assert max(largest_blocks(ids, od.long_digits(F.col("x")))) <= 65_536
    dense = spark.range(400_000).select((F.col("id") - 200_000).alias("x"))
    assert max(largest_blocks(dense, od.long_digits(F.col("x")))) <= 65_536
    day = spark.range(400_000).select((F.col("id") * 216 + 1_700_000_000_000).cast("double").alias("x"))
    assert max(largest_blocks(day, od.double_digits(F.col("x")))) <= 65_536
    keys = spark.range(400_000).select(od.hash_key(1, F.col("id")).alias("x"))
    assert max(largest_blocks(keys, od.hash_digits(F.col("x")))) <= 65_536


def test_digits_of_numbers_follow_their_order(spark):
    from opinara.operators import ordering as od

    values = [0.0, -0.0, 5e-324, -5e-324, 1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 4.0, 3.9999999999999996,
              -1.0, -2.0, -1.9999999999999998, 1e308, -1e308, 1e-308, float("inf"), float("-inf"), 1e12 + 1, 1e12, 0.1, 0.3]
    values += [float(2**k) for k in range(-60, 60)] + [math.nextafter(2.0**k, 0) for k in range(-60, 60)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", *[d.alias(f"d{i}") for i, d in enumerate(od.double_digits(F.col("x")))]).collect()
    rows.sort(key=lambda r: r["x"])
    digits = [tuple(r)[1:] for r in rows]
    assert digits == sorted(digits)


def test_trees_take_distinct_rows_at_any_size(spark):
    for n, most in ((100, 100), (2000, 256)):
        df = spark.range(n).select((F.col("id") * 1_000_003).alias("id"), F.rand(1).alias("x"), F.rand(2).alias("y"))
        forest = ol.fit_forest(df, ["x", "y"], "id", trees=4)
        assert len(forest) == 4 and all(50 < len(t) < 2 * most for t in forest)


def test_quantiles_count_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i % 50) if i % 3 else 0.1 * i

    df = spark.range(600).withColumn("v", value("id"))
    got = {r["prob"]: r["quantile"] for r in pf.exact_quantiles(df.select("v"), ["v"], [0.0, 0.3, 0.5, 1.0]).collect()}
    assert seen.value == 600
    want = [float(i % 50) if i % 3 else 0.1 * i for i in range(600)]
    for p, q in got.items():
        assert math.isclose(q, np.quantile(want, p), rel_tol=1e-12)
    assert len(got) == 4


def test_quantiles_of_close_and_odd_values(spark):
    close = [1e9 + i / 1024 for i in range(300)]  # one block of values
    odd = [math.inf, -math.inf, -0.0, 0.0, 5e-324, -3.5, -3.5, 2.0**60, None, math.nan]
    rows = [(x, odd[i] if i < len(odd) else None) for i, x in enumerate(close)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = {(r["col"], r["prob"]): r["quantile"] for r in pf.exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert got["x", p] == pytest.approx(np.quantile(close, p), rel=1e-15)
    # -inf, -3.5, -3.5, 0, 0, 5e-324, 2 ** 60, inf: places 1.75, 3.5 and 5.25
    assert got["y", 0.25] == -3.5 and got["y", 0.5] == 0.0 and got["y", 0.75] == 2.0**58


def test_profile_counts_distinct_values_exactly(spark):
    from decimal import Decimal

    rows = [
        (2**60 + 1, -0.0, Decimal("1.10"), "b", True),
        (2**60 + 2, 0.0, Decimal("1.10"), "a", None),
        (2**60 + 2, math.nan, Decimal("1.11"), "b", True),
        (None, 1.5, None, None, False),
    ]
    df = spark.createDataFrame(rows, "i bigint, x double, d decimal(20,2), s string, t boolean")
    got = {r["column"]: r for r in pf.profile(df).collect()}
    assert {c: got[c]["n_unique"] for c in got} == {"i": 2, "x": 3, "d": 2, "s": 2, "t": 2}
    assert {c: got[c]["n_missing"] for c in got} == {"i": 1, "x": 1, "d": 1, "s": 1, "t": 1}
    assert {c: got[c]["mode"] for c in got} == {"i": None, "x": None, "d": None, "s": "b", "t": "true"}
    assert got["x"]["median"] == 0.0 and got["d"]["median"] == 1.1


@pytest.mark.parametrize("few", [3, 900])
def test_kendall_over_cut_groups(spark, monkeypatch, few):
    """Parts of 70 rows cut every group; 900 values need two digits."""
    monkeypatch.setattr(co, "PART_ROWS", 70)
    rng = np.random.default_rng(few)
    x = rng.integers(0, few, 1500)
    y = (x * 3 + rng.integers(0, 1200, 1500)).astype(float)
    y[:5], x[5:300] = [np.nan, -np.inf, np.inf, -0.0, 0.0], 1
    pdf = pd.DataFrame({"x": x, "y": y}).dropna()
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x bigint, y double")
    dx, dy = (np.sign(np.subtract.outer(v, v)) for v in (pdf.x.to_numpy(), pdf.y.rank().to_numpy()))
    want = (dx * dy).sum() / math.sqrt((dx**2).sum() * (dy**2).sum())
    for a, b in (("x", "y"), ("y", "x")):
        got = co.kendall_pair(df, a, b).first()
        assert (got["a"], got["b"]) == (a, b)
        assert got["r"] == pytest.approx(want, abs=1e-12)


def test_kendall_without_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "x double, y double")
    assert co.kendall_pair(df, "x", "y").first()["r"] is None
