"""TF-IDF, classifiers, density-ratio weights and evaluation metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.operators import features as ft
from opinara.operators import metrics as mt
from opinara.operators import models as md
from opinara.operators.sampling import stratified_split
from opinara.plans.base import (
    LABELLED_SQL,
    PREDICTIONS_SQL,
    documents,
    labelled_corpus,
    predictions,
    query,
    quoted,
    table,
)
from opinara.plans.row_queries import SPLIT_SQL
from opinara.session import cut_lineage, scratch_path
from opinara.sources.files import load_model, save_model

TERMS = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
  x AS (SELECT doc_id, unnest(w) AS term FROM t UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i+1] FOR i IN range(1, len(w))]) AS term FROM t),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
  v AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 30000)"""


@query(
    "v1_tfidf_terms",
    f"""WITH {TERMS}, r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN v USING (term))
    SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS w FROM r""",
)
def v1(spark, d):
    return ft.tfidf_terms(documents(spark, d), "doc_id", "text").withColumn("w", F.round("w", 6))


@query("v3_vocabulary", f"WITH {TERMS} SELECT term, total, df FROM v")
def v3(spark, d):
    return ft.vocabulary(documents(spark, d), "doc_id", "text")


@query("v3_top_words", f"WITH {TERMS} SELECT term, df AS n FROM v ORDER BY df DESC, term LIMIT 15")
def v3_top(spark, d):
    counts = ft.document_frequencies(documents(spark, d), "doc_id", "text")
    return counts.orderBy(F.desc("n"), F.asc("term")).limit(15)


def split_corpus(spark, d):
    """The labelled corpus with its split column, written once for all models."""
    corpus = labelled_corpus(spark, d).select("id", "text", "criteria")
    return cut_lineage(stratified_split(cut_lineage(corpus), "criteria", "id"))


@query("v2_fit_transform")
def v2(spark, d):
    corpus = split_corpus(spark, d)
    model = ft.fit_tfidf(corpus.where("split = 'train'"))
    held_out = model.transform(corpus.where("split <> 'train'"))
    x = vector_to_array("features")
    return held_out.select(
        "id",
        "split",
        F.size(F.filter(x, lambda v: v > 0)).alias("terms"),
        F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v), 6).alias("norm"),
    )


def _model_report(spark, d, name, **settings):
    corpus = split_corpus(spark, d)
    evals = {s: corpus.where(F.col("split") == s) for s in ("val", "test")}
    return md.train_all(
        corpus.where("split = 'train'"), evals, "id", lx.EVALUATION_TAXONOMY, [name],
        settings={name: settings},
    )


@query("c1_logistic_regression")
def c1(spark, d):
    return _model_report(spark, d, "logreg")


@query("c2_linear_svm")
def c2(spark, d):
    return _model_report(spark, d, "svm")


@query("c3_naive_bayes")
def c3(spark, d):
    return _model_report(spark, d, "nb")


@query("c4_random_forest")
def c4(spark, d):
    return _model_report(spark, d, "rf")


@query(
    "c5_class_weights",
    f"SELECT criteria, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM ({LABELLED_SQL}) GROUP BY 1",
)
def c5(spark, d):
    weights = md.balanced_weights(labelled_corpus(spark, d), "criteria")
    return weights.withColumn("weight", F.round("weight", 6))


@query("c6_train_all")
def c6(spark, d):
    corpus = split_corpus(spark, d)
    evals = {s: corpus.where(F.col("split") == s) for s in ("val", "test")}
    return md.train_all(corpus.where("split = 'train'"), evals, "id", lx.EVALUATION_TAXONOMY)


@query("c7_density_ratio")
def c7(spark, d):
    rows = table(spark, d, "embeddings").withColumn("label", F.col("label") % 2 == 1)
    return md.density_ratio_weights(rows, "embedding", "label", "vec_id")


@query(
    "c7_clamped_ratio",
    """SELECT vec_id, round(greatest(least(p / (1 - p + 1e-8), 10.0), 0.5), 6) AS weight
    FROM (SELECT vec_id, 1 / (1 + exp(-8 * embedding[1]::DOUBLE)) AS p FROM embeddings)""",
)
def c7_clamp(spark, d):
    p = 1 / (1 + F.exp(-8 * F.col("embedding")[0].cast("double")))
    weights = table(spark, d, "embeddings").select("vec_id", md.clamp_ratio(p).alias("weight"))
    return weights.withColumn("weight", F.round("weight", 6))


@query("s7_model_round_trip")
def s7(spark, d):
    corpus = split_corpus(spark, d)
    model = md.fit_classifiers(corpus.where("split = 'train'"), ["nb"])["nb"]
    path = scratch_path(spark, "model")
    save_model(model, path)
    return md.predict(load_model(path), corpus.where("split = 'test'"), "id")


@query("m1_accuracy", f"SELECT round(avg((y_true = y_pred)::INTEGER), 6) AS accuracy, count(*) AS n FROM ({PREDICTIONS_SQL})")
def m1(spark, d):
    return mt.accuracy(predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "m1_fallback_rate",
    f"SELECT round(avg((y_pred = 'Global_experience')::INTEGER), 6) AS fallback_rate FROM ({PREDICTIONS_SQL})",
)
def m1_fallback(spark, d):
    rate = mt.fallback_rate(predictions(spark, d), lx.FALLBACK)
    return rate.withColumn("fallback_rate", F.round("fallback_rate", 6))


LABELS = f"(SELECT unnest([{', '.join(quoted(x) for x in lx.EVALUATION_TAXONOMY)}]) AS label, unnest(range(0, 15))::INTEGER AS pos)"
REPORT = f"""p AS MATERIALIZED ({PREDICTIONS_SQL}), c AS (SELECT pos, label, (SELECT count(*) FROM p WHERE y_true = label) AS support,
    (SELECT count(*) FROM p WHERE y_pred = label) AS predicted, (SELECT count(*) FROM p WHERE y_true = label AND y_pred = label) AS hits FROM {LABELS}),
  s AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END::DOUBLE AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END::DOUBLE AS recall FROM c),
  r AS (SELECT pos, label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END::DOUBLE AS f1, support FROM s)"""
SCORES = ["precision", "recall", "f1"]


def _round(df):
    return df.withColumns({c: F.round(c, 6) for c in SCORES})


@query(
    "m2_classification_report",
    f"WITH {REPORT} SELECT pos, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r",
)
def m2(spark, d):
    return _round(mt.classification_report(predictions(spark, d), lx.EVALUATION_TAXONOMY))


@query(
    "m3_report_averages",
    f"""WITH {REPORT} SELECT 'macro avg' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support FROM r
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM r
    UNION ALL SELECT 'accuracy', round(avg((y_true = y_pred)::INTEGER), 6), round(avg((y_true = y_pred)::INTEGER), 6), round(avg((y_true = y_pred)::INTEGER), 6), count(*) FROM p""",
)
def m3(spark, d):
    return _round(mt.report_averages(predictions(spark, d), lx.EVALUATION_TAXONOMY))


@query(
    "m4_confusion_matrix",
    f"""WITH p AS MATERIALIZED (SELECT y_true, y_pred, count(*) AS n FROM ({PREDICTIONS_SQL}) GROUP BY ALL)
    SELECT a.label AS y_true, b.label AS y_pred, a.pos AS true_pos, b.pos AS pred_pos, coalesce(n, 0) AS n
    FROM {LABELS} a CROSS JOIN {LABELS} b LEFT JOIN p ON p.y_true = a.label AND p.y_pred = b.label""",
)
def m4(spark, d):
    return mt.confusion_matrix(predictions(spark, d), lx.EVALUATION_TAXONOMY)

# ---- What SQL can state of results that it cannot compute ---------------------------------

EVALUATED = f"(SELECT * FROM ({SPLIT_SQL}) WHERE split <> 'train')"


@query(
    "v2_fit_totals",
    f"SELECT split, count(*) AS rows, count(*) AS unit FROM {EVALUATED} GROUP BY split",
)
def v2_totals(spark, d):
    """Rows of each held-out split, and those of length one or without known terms."""
    unit = (F.abs(F.col("norm") - 1) < 1e-5) | ((F.col("terms") == 0) & (F.col("norm") == 0))
    return v2(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(unit).alias("unit"))


@query(
    "c6_supports",
    f"""WITH e AS {EVALUATED}, m AS (SELECT unnest(['logreg', 'svm', 'nb', 'rf']) AS model), s AS (SELECT unnest(['val', 'test']) AS split)
    SELECT model, s.split, label, (SELECT count(*) FROM e WHERE e.split = s.split AND criteria = label) AS support, true AS in_bounds
    FROM m, s, {LABELS}""",
)
def c6_supports(spark, d):
    """Supports of every report of every model; all scores within their bounds.

    The forest has fewer trees than in ``c6_train_all``: supports do not depend on them.
    """
    corpus = split_corpus(spark, d)
    evals = {s: corpus.where(F.col("split") == s) for s in ("val", "test")}
    small = {"rf": {"numTrees": 20, "maxDepth": 10}}
    reports = md.train_all(
        corpus.where("split = 'train'"), evals, "id", lx.EVALUATION_TAXONOMY, settings=small
    )
    inside = F.lit(True)
    for c in SCORES:
        inside = inside & F.col(c).between(0, 1)
    return reports.select("model", "split", "label", "support", inside.alias("in_bounds"))


@query(
    "c7_ratio_bounds",
    "SELECT count(*) AS rows, count(*) AS clamped FROM embeddings WHERE label % 2 <> 1",
)
def c7_bounds(spark, d):
    """Only undesirable rows are weighted, each by its clamped odds."""
    odds = F.greatest(F.least(F.col("p") / (1 - F.col("p") + 1e-8), F.lit(10.0)), F.lit(0.5))
    good = F.col("p").between(0, 1) & (F.abs(F.col("weight") - odds) < 1e-9)
    return c7(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("clamped"))


@query(
    "s7_reloaded_predictions",
    f"SELECT count(*) AS rows, count(*) AS same FROM {EVALUATED} WHERE split = 'test'",
)
def s7_same(spark, d):
    """A saved and reloaded model predicts what the model itself does."""
    corpus = split_corpus(spark, d)
    model = md.fit_classifiers(corpus.where("split = 'train'"), ["nb"])["nb"]
    path = scratch_path(spark, "model")
    save_model(model, path)
    test = corpus.where("split = 'test'")
    own = md.predict(model, test, "id").withColumnRenamed("y_pred", "own")
    back = md.predict(load_model(path), test, "id").select("id", "y_pred")
    both = own.join(back, "id")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("own").eqNullSafe(F.col("y_pred"))).alias("same"))
