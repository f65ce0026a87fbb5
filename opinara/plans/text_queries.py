"""Projections and string functions over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import labels as lb
from opinara.functions import lexicons as lx
from opinara.functions import text as tx
from opinara.plans.base import (
    ANSWER,
    NOISY_SQL,
    SCORED,
    documents,
    noisy_corpus,
    query,
    quoted,
    quoted_list,
    sql_clean,
    sql_strip,
    sql_title,
    sql_words,
    table,
)
from opinara.sources.schema import drop_null_elements, harmonise, keep_existing


@query("p1_select_columns", "SELECT doc_id, text FROM documents")
def p1(spark, d):
    return documents(spark, d).select("doc_id", "text")


@query("p2_keep_existing", "SELECT text, lang FROM documents")
def p2(spark, d):
    return keep_existing(documents(spark, d), ["text", "sentiment", "lang", "customer_rating"])


@query("p3_rename_text", "SELECT doc_id AS id, text AS review, lang FROM documents")
def p3(spark, d):
    return harmonise(
        documents(spark, d), {"doc_id": "id", "text": "review"}, ["id", "review", "lang"]
    )


@query("p4_drop_columns", "SELECT doc_id, text, lang FROM documents")
def p4(spark, d):
    return documents(spark, d).drop("source", "n_chars", "Critere", "Score")


@query(
    "p5_optional_column",
    "SELECT d.doc_id, d.text, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def p5(spark, d):
    joined = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return keep_existing(joined, ["doc_id", "text", "lang", "quality", "SentimentLabel"])


@query(
    "p6_replace_value",
    "SELECT id, CASE WHEN Critere = 'Retail: Rapidité En Caisse' THEN 'Rapidité en caisse' "
    f"ELSE Critere END AS Critere FROM ({NOISY_SQL})",
)
def p6(spark, d):
    return noisy_corpus(spark, d).replace(lx.LABEL_FIXES, subset=["Critere"]).select("id", "Critere")


@query("p7_cast_string", "SELECT doc_id, CAST(n_chars AS VARCHAR) AS n_chars_text FROM documents")
def p7(spark, d):
    return documents(spark, d).select("doc_id", F.col("n_chars").cast("string").alias("n_chars_text"))


@query(
    "p8_split_pair",
    f"""WITH a AS (SELECT doc_id, {SCORED} AS answer FROM documents)
    SELECT doc_id, {sql_strip("split_part(answer, '|', 1)")} AS left_part,
      CASE WHEN instr(answer, '|') > 0 THEN {sql_strip("substr(answer, instr(answer, '|') + 1)")} END AS right_part
    FROM a""",
)
def p8(spark, d):
    left, right = tx.split_pair(F.col("answer"))
    answers = documents(spark, d).select("doc_id", F.expr(SCORED).alias("answer"))
    return answers.select("doc_id", left.alias("left_part"), right.alias("right_part"))


@query(
    "p11_drop_null_elements",
    """SELECT doc_id, array_to_string([w FOR w IN string_split(text, chr(10)) IF w <> ''], '/') AS present,
      len([w FOR w IN string_split(text, chr(10)) IF w <> '']) AS n_present FROM documents""",
)
def p11(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda w: F.nullif(w, F.lit("")))
    kept = documents(spark, d).select("doc_id", drop_null_elements(lines).alias("k"))
    return kept.select(
        "doc_id",
        F.array_join("k", "/").alias("present"),
        F.size("k").cast("bigint").alias("n_present"),
    )


@query("t1_lower", "SELECT doc_id, lower(text) AS low FROM documents")
def t1(spark, d):
    return documents(spark, d).select("doc_id", F.lower("text").alias("low"))


@query(
    "t2_strip",
    f"SELECT doc_id, {sql_strip('s')} AS stripped FROM "
    "(SELECT doc_id, concat(chr(9), ' ', text, chr(160), chr(10)) AS s FROM documents)",
)
def t2(spark, d):
    padded = documents(spark, d).select(
        "doc_id", F.concat(F.lit("\t "), F.col("text"), F.lit("\xa0\n")).alias("s")
    )
    return padded.select("doc_id", tx.strip_ws(F.col("s")).alias("stripped"))


@query(
    "t3_nfc",
    "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS composed FROM documents",
)
def t3(spark, d):
    split = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return documents(spark, d).select("doc_id", tx.nfc(split).alias("composed"))


@query(
    "t4_clean_accents", f"SELECT doc_id, {sql_clean('text', True)} AS clean FROM documents"
)
def t4(spark, d):
    return documents(spark, d).select("doc_id", tx.clean_review(F.col("text"), True).alias("clean"))


@query("t5_clean_ascii", f"SELECT doc_id, {sql_clean('text', False)} AS clean FROM documents")
def t5(spark, d):
    return documents(spark, d).select("doc_id", tx.clean_review(F.col("text"), False).alias("clean"))


@query(
    "t6_fix_label",
    "SELECT id, "
    + sql_strip(f"split_part(regexp_replace({sql_strip('Critere')}, '^[-\\s*]+', ''), '|', 1)")
    + f" AS label FROM ({NOISY_SQL})",
)
def t6(spark, d):
    return noisy_corpus(spark, d).select("id", lb.fix_label(F.col("Critere")).alias("label"))


@query(
    "t7_separator",
    f"SELECT id, regexp_matches(Critere, '^[-\\s=]+$') AS is_separator FROM ({NOISY_SQL})",
)
def t7(spark, d):
    return noisy_corpus(spark, d).select("id", lb.is_separator(F.col("Critere")).alias("is_separator"))


@query(
    "t8_title_label",
    f"""WITH w AS (SELECT id, {sql_words('lower(Critere)')} AS words FROM ({NOISY_SQL})),
    j AS (SELECT id, len(words) AS n, array_to_string(words, ' ') AS s FROM w)
    SELECT id, CASE WHEN n BETWEEN 1 AND 4 THEN {sql_title('s')} END AS title FROM j""",
)
def t8(spark, d):
    return noisy_corpus(spark, d).select("id", lb.title_label(F.lower("Critere")).alias("title"))


@query(
    "t9_canonical_label",
    "SELECT doc_id, replace(replace("
    + sql_strip(f"split_part({sql_strip('answer')}, chr(10), 1)")
    + f", ' ', '_'), '-', '_') AS label FROM (SELECT doc_id, {ANSWER} AS answer FROM documents)",
)
def t9(spark, d):
    answers = documents(spark, d).select("doc_id", F.expr(ANSWER).alias("answer"))
    return answers.select("doc_id", lb.canonical_label(F.col("answer")).alias("label"))


LAST_TOKEN = (
    "coalesce(regexp_extract([x FOR x IN string_split({c}, chr(10)) IF trim(x) <> ''][-1], '[^\\s]+'), '')"
)


@query(
    "t10_last_line_token",
    f"SELECT doc_id, {LAST_TOKEN.format(c='text')} AS token FROM documents",
)
def t10(spark, d):
    return documents(spark, d).select("doc_id", tx.last_line_token(F.col("text")).alias("token"))


@query(
    "t11_last_line_with",
    f"""SELECT doc_id, {sql_strip("[x FOR x IN string_split(answer, chr(10)) IF contains(x, '|')][-1]")} AS line
    FROM (SELECT doc_id, {SCORED} AS answer FROM documents)""",
)
def t11(spark, d):
    answers = documents(spark, d).select("doc_id", F.expr(SCORED).alias("answer"))
    return answers.select("doc_id", tx.last_line_with(F.col("answer"), "|").alias("line"))


MARK = "<|im_start|>assistant\n"


@query(
    "t12_between_markers",
    f"""SELECT doc_id, {sql_strip("string_split(string_split(t, " + quoted(MARK) + ")[-1], '<|im_end|>')[1]")} AS answer
    FROM (SELECT doc_id, concat('<|im_start|>user', chr(10), text, '<|im_end|>', chr(10), {quoted(MARK)}, source, ' ', lang, '<|im_end|>') AS t FROM documents)""",
)
def t12(spark, d):
    rendered = F.concat(
        F.lit("<|im_start|>user\n"), "text", F.lit(f"<|im_end|>\n{MARK}"),
        "source", F.lit(" "), "lang", F.lit("<|im_end|>"),
    )
    return documents(spark, d).select(
        "doc_id", tx.between_markers(rendered, MARK, "<|im_end|>").alias("answer")
    )


@query("t13_drop_quotes", "SELECT doc_id, replace(text, '\"', '') AS bare FROM documents")
def t13(spark, d):
    return documents(spark, d).select("doc_id", tx.drop_quotes(F.col("text")).alias("bare"))


@query(
    "t14_contains_keyword",
    "SELECT doc_id, contains(lower(text), 'dt') OR contains(lower(text), 'lent') OR "
    "contains(lower(text), 'long') AS found FROM documents",
)
def t14(spark, d):
    return documents(spark, d).select(
        "doc_id", tx.contains_any(F.lower("text"), ["dt", "lent", "long"]).alias("found")
    )


@query("t15_word_count", f"SELECT doc_id, len({sql_words('text')}) AS words FROM documents")
def t15(spark, d):
    return documents(spark, d).select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("words"))


@query(
    "t16_render_template",
    "SELECT doc_id, concat('Review ', doc_id, ' (', lang, '): ', text, chr(10), 'Source: ', source) AS message FROM documents",
)
def t16(spark, d):
    cols = {c: F.col(c) for c in ("doc_id", "lang", "text", "source")}
    template = "Review {doc_id} ({lang}): {text}\nSource: {source}"
    return documents(spark, d).select("doc_id", tx.render(template, **cols).alias("message"))


@query(
    "t17_word_tokens",
    "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), ' ') AS tokens FROM documents",
)
def t17(spark, d):
    return documents(spark, d).select(
        "doc_id", F.array_join(tx.word_tokens(F.col("text")), " ").alias("tokens")
    )


MULTI = "concat('Service, Prix ,', source, ', Hygiène, Accueil,', substring(text, 1, 20))"


@query(
    "t18_multi_label",
    f"""SELECT doc_id, array_to_string([n FOR n IN [trim(x) FOR x IN string_split({MULTI}, ',')]
      IF n IN {quoted_list(lx.STRICT_TAXONOMY_FR)}][1:3], '/') AS labels FROM documents""",
)
def t18(spark, d):
    picked = lb.multi_label(F.expr(MULTI), lx.STRICT_TAXONOMY_FR)
    return documents(spark, d).select("doc_id", F.array_join(picked, "/").alias("labels"))
