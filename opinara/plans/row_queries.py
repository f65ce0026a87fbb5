"""Sources, sinks, filters, samples, splits, unions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.functions.text import strip_ws, word_count
from opinara.operators import filters as fl
from opinara.operators import metrics as mt
from opinara.operators import profiling as pf
from opinara.operators import sampling as sm
from opinara.operators.labeling import combine_sources
from opinara.operators.ordering import attach_columns
from opinara.plans.base import (
    CELL,
    LABELLED_SQL,
    NOISY_SQL,
    PAIR_SQL,
    PREDICTIONS_SQL,
    documents,
    labelled_corpus,
    noisy_corpus,
    pairs,
    predictions,
    query,
    quoted_list,
    source_tables,
    sql_any,
    sql_int,
    sql_key,
    sql_strip,
    sql_words,
    table,
)
from opinara.session import cut_lineage, scratch_path
from opinara.sources.files import read_reviews_csv, write_table

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("s1_csv_source", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1(spark, d):
    path = scratch_path(spark, "reviews-csv")
    write_table(documents(spark, d), path, "csv")
    return read_reviews_csv(spark, path, DOC_SCHEMA, na_tokens=[""])


@query(
    "s2_null_tokens",
    f"SELECT doc_id, CASE WHEN cell NOT IN {quoted_list(lx.NA_TOKENS)} THEN cell END AS cell FROM (SELECT doc_id, {CELL} AS cell FROM documents)",
)
def s2(spark, d):
    path = scratch_path(spark, "cells-csv")
    write_table(documents(spark, d).select("doc_id", F.expr(CELL).alias("cell")), path, "csv")
    return read_reviews_csv(spark, path, "doc_id bigint, cell string")


@query("s3_table_source", "SELECT conv_id, turn, role, text FROM conversations")
def s3(spark, d):
    return table(spark, d, "conversations")


@query(
    "s4_split_sink",
    "SELECT doc_id, text, lang FROM documents",
)
def s4(spark, d):
    path = scratch_path(spark, "by-lang-csv")
    write_table(documents(spark, d).select("doc_id", "text", "lang"), path, "csv", ["lang"])
    back = read_reviews_csv(spark, path, "doc_id bigint, text string, lang string", na_tokens=[""])
    return back.select("doc_id", "text", "lang")


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "s5_profile_sink",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        f"CASE WHEN count(*) > 0 THEN 100.0 * (count(*) - count({c})) / count(*) ELSE 0 END::DOUBLE AS missing_pct FROM customer"
        for c in CUSTOMER
    ),
)
def s5(spark, d):
    path = scratch_path(spark, "profile")
    write_table(pf.missing_summary(table(spark, d, "customer")), path)
    return spark.read.parquet(path)


@query(
    "s6_report_sink",
    f"SELECT y_true, y_pred, count(*) AS n FROM ({PREDICTIONS_SQL}) GROUP BY ALL",
)
def s6(spark, d):
    path = scratch_path(spark, "report")
    write_table(mt.pair_counts(predictions(spark, d)), path, "json")
    return spark.read.schema("y_true string, y_pred string, n bigint").json(path)


@query("f1_drop_null", f"SELECT id, Critere FROM ({NOISY_SQL}) WHERE Critere IS NOT NULL AND text IS NOT NULL")
def f1(spark, d):
    return fl.drop_null(noisy_corpus(spark, d), ["text", "Critere"]).select("id", "Critere")


@query("f2_dedupe_first", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def f2(spark, d):
    return fl.dedupe_first(documents(spark, d), "text", "doc_id").select("doc_id", "text")


@query(
    "f3_min_length",
    f"SELECT doc_id, t FROM (SELECT doc_id, {sql_strip('text')} AS t FROM documents) WHERE length(t) > 5",
)
def f3(spark, d):
    stripped = documents(spark, d).select("doc_id", strip_ws(F.col("text")).alias("t"))
    return fl.min_length(stripped, "t", 5)


@query("f4_keep_labels", f"SELECT id, Critere FROM ({NOISY_SQL}) WHERE Critere IN {quoted_list(lx.STRICT_TAXONOMY_FR)}")
def f4(spark, d):
    return fl.keep_labels(noisy_corpus(spark, d), "Critere", lx.STRICT_TAXONOMY_FR).select("id", "Critere")


@query(
    "f5_drop_labels",
    f"SELECT id, Critere FROM ({NOISY_SQL}) WHERE Critere IS NULL OR Critere NOT IN {quoted_list(lx.GHOST_LABELS)}",
)
def f5(spark, d):
    return fl.drop_labels(noisy_corpus(spark, d), "Critere", lx.GHOST_LABELS).select("id", "Critere")


@query("f6_class_selection", f"SELECT id, Critere IS NOT DISTINCT FROM 'Expérience globale' AS is_generic FROM ({NOISY_SQL})")
def f6(spark, d):
    flag = fl.is_class("Critere", lx.FALLBACK_FR)
    return noisy_corpus(spark, d).select("id", flag.alias("is_generic"))


@query(
    "f7_short_abusive",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, line FROM l WHERE NOT (len({sql_words('lower(line)')}) <= 3 AND {sql_any('lower(line)', lx.ABUSIVE_WORDS)})""",
)
def f7(spark, d):
    lines = documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return fl.drop_short_abusive(lines, "line")


@query("f8_max_tokens", f"SELECT doc_id, len({sql_words('text')}) AS n FROM documents WHERE len({sql_words('text')}) < 250")
def f8(spark, d):
    kept = fl.max_tokens(documents(spark, d), ["text"], 249)
    return kept.select("doc_id", word_count(F.col("text")).cast("bigint").alias("n"))


@query(
    "f9_pair_length",
    f"SELECT id FROM ({PAIR_SQL}) WHERE len({sql_words('chosen')}) <= 300 AND len({sql_words('rejected')}) <= 300",
)
def f9(spark, d):
    return fl.max_tokens(pairs(spark, d), ["chosen", "rejected"], 300).select("id")


@query(
    "f10_label_sides",
    "SELECT doc_id, 'toxic' AS side FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'clean' FROM labels WHERE toxic = 0",
)
def f10(spark, d):
    marked = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("label"))
    yes, no = fl.partition_by_label(marked, "label")
    return yes.select("doc_id", F.lit("toxic").alias("side")).unionByName(
        no.select("doc_id", F.lit("clean").alias("side"))
    )


@query(
    "f11_row_accounting",
    f"""SELECT count(*) AS initial, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS removed,
      round(100.0 * count(*) FILTER (ok) / count(*), 6)::DOUBLE AS recovery_pct
    FROM (SELECT coalesce(Critere IN {quoted_list(lx.STRICT_TAXONOMY_FR)}, false) AS ok FROM ({NOISY_SQL}))""",
)
def f11(spark, d):
    before = noisy_corpus(spark, d)
    counts = fl.row_accounting(before, fl.keep_labels(before, "Critere", lx.STRICT_TAXONOMY_FR))
    return counts.withColumn("recovery_pct", F.round("recovery_pct", 6))


@query(
    "r1_sample_exact",
    f"SELECT doc_id, text FROM documents ORDER BY {sql_key(42, 'doc_id')}, doc_id LIMIT 150",
)
def r1(spark, d):
    return sm.sample_n(documents(spark, d).select("doc_id", "text"), 150, 42, "doc_id")


@query(
    "r1_sample_lines",
    f"SELECT l_orderkey, l_linenumber, k FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS k, "
    f"row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) WHERE c = 1 ORDER BY {sql_key(42, 'k')}, k LIMIT 6000",
)
def r1_lines(spark, d):
    keyed = (
        table(spark, d, "lineitem")
        .select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
        .distinct()
    )
    return sm.sample_n(keyed, 6000, 42, "k")


@query(
    "r2_downsample_class",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY criteria ORDER BY {sql_key(42, 'id')}, id) AS rn,
      count(*) OVER (PARTITION BY criteria) AS n FROM ({LABELLED_SQL}))
    SELECT id, criteria FROM r WHERE criteria <> 'Global_experience' OR rn <= round(0.05 * n)""",
)
def r2(spark, d):
    corpus = cut_lineage(labelled_corpus(spark, d).select("id", "criteria"))
    return sm.downsample_class(corpus, "criteria", lx.FALLBACK, 0.05, 42, "id")


@query(
    "r3_shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {sql_key(42, 'doc_id')}, doc_id) AS shuffle_pos FROM documents",
)
def r3(spark, d):
    return sm.shuffle_rows(documents(spark, d).select("doc_id"), 42, "doc_id")


RANKED_SQL = (
    f"SELECT id, criteria, row_number() OVER (PARTITION BY criteria ORDER BY {sql_key(42, 'id')}, id) AS rn, "
    f"count(*) OVER (PARTITION BY criteria) AS n FROM ({LABELLED_SQL})"
)


@query(
    "r4_split_per_class",
    f"""WITH q AS (SELECT *, round(n * 0.2::DOUBLE) AS t, round((n - round(n * 0.2::DOUBLE)) * 0.2::DOUBLE) AS v FROM ({RANKED_SQL}))
    SELECT id, criteria, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS split FROM q""",
)
def r4_rounded(spark, d):
    corpus = cut_lineage(labelled_corpus(spark, d).select("id", "criteria"))
    return sm.stratified_split(corpus, "criteria", "id", exact_total=False)


def _quota(size: str, share: float, out: str, source: str) -> str:
    """Largest remainder in plain SQL over a class table."""
    return f"""SELECT *, base_{out} + CASE WHEN row_number() OVER (ORDER BY round(exact_{out} - base_{out}, 9) DESC, criteria)
        <= want_{out} - sum(base_{out}) OVER () THEN 1 ELSE 0 END AS {out}
      FROM (SELECT *, floor(exact_{out}) AS base_{out} FROM (SELECT *, ceil({share}::DOUBLE * sum({size}) OVER ()) AS want_{out},
        {size} * ceil({share}::DOUBLE * sum({size}) OVER ()) / sum({size}) OVER () AS exact_{out} FROM ({source})))"""


_TEST = _quota("n", 0.2, "t", "SELECT criteria, count(*) AS n FROM (" + LABELLED_SQL + ") GROUP BY 1")
_VAL = _quota("rest", 0.2, "v", f"SELECT *, n - t AS rest FROM ({_TEST})")


SPLIT_SQL = f"""WITH q AS ({_VAL}) SELECT r.id, r.criteria, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS split
    FROM ({RANKED_SQL}) r JOIN q USING (criteria)"""


@query("r4_split_exact", SPLIT_SQL)
def r4_exact(spark, d):
    corpus = cut_lineage(labelled_corpus(spark, d).select("id", "criteria"))
    return sm.stratified_split(corpus, "criteria", "id")


@query(
    "r5_draw_with_replacement",
    f"""WITH n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT unnest(range(1, least(1024, (SELECT n FROM n)) + 1)) AS draw),
    p AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings)
    SELECT draw, vec_id, label FROM (SELECT draw, {sql_int(3, 'draw')} % (SELECT n FROM n) + 1 AS pos FROM k) JOIN p USING (pos)""",
)
def r5(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return sm.draw_with_replacement(rows, 1024, 3, "vec_id")


@query("r6_top_values", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def r6(spark, d):
    return sm.top_values(documents(spark, d), "source", 10)


@query(
    "r8_batches",
    """SELECT doc_id, (rn - 1) // 8 AS batch_id, (rn - 1) % 8 AS slot,
      least(8, (SELECT count(*) FROM documents) - (rn - 1) // 8 * 8) AS batch_size
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)""",
)
def r8(spark, d):
    return sm.batch_rows(documents(spark, d).select("doc_id"), 8, "doc_id")


@query(
    "u1_union_sources",
    "SELECT doc_id AS id, text FROM documents",
)
def u1(spark, d):
    parts = [df.select("id", F.col(spec.text).alias("text")) for df, spec in source_tables(spark, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "u2_attach_columns",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
)
def u2(spark, d):
    return documents(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")


@query(
    "u2_attach_by_position",
    """SELECT d.doc_id, d.lang, m.other_id, m.other_chars
    FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) d
    JOIN (SELECT doc_id AS other_id, n_chars AS other_chars, row_number() OVER (ORDER BY doc_id DESC) AS rn
      FROM documents) m USING (rn)""",
)
def u2_positions(spark, d):
    """Every document beside its mirrored one, as tuning sets attach unrelated answers."""
    docs = documents(spark, d)
    other = docs.select(
        (-F.col("doc_id")).alias("place"), F.col("doc_id").alias("other_id"), F.col("n_chars").alias("other_chars")
    )
    return attach_columns(docs.select("doc_id", "lang"), other, "doc_id", "place")


@query(
    "j1_combine_sources",
    f"SELECT id, text, criteria, row_number() OVER (ORDER BY {sql_key(42, 'id')}, id) AS shuffle_pos FROM ({LABELLED_SQL})",
)
def j1(spark, d):
    return combine_sources([(labelled_corpus(spark, d), "text")])
