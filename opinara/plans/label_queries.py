"""Rule-based labelling, answer parsing, label repair and corpus building."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import labels as lb
from opinara.functions import lexicons as lx
from opinara.functions import prompts as pr
from opinara.functions.text import clean_review
from opinara.operators import labeling as lab
from opinara.operators.sampling import expansion_plan, top_values
from opinara.plans.base import (
    ANSWER,
    LABELLED_SQL,
    NOISY_SQL,
    SCORED,
    documents,
    labelled_corpus,
    noisy_corpus,
    query,
    quoted,
    quoted_list,
    source_tables,
    sql_clean,
    sql_first,
    sql_int,
    sql_key,
    sql_strip,
    sql_title,
    sql_words,
)
from opinara.plans.text_queries import LAST_TOKEN
from opinara.session import materialize


def _register_hint(name: str, lexicon, accents: bool | None) -> None:
    text = "lower(text)" if accents is None else sql_clean("text", accents)
    sql = f"SELECT doc_id, {sql_first('c', lexicon)} AS hint FROM (SELECT doc_id, {text} AS c FROM documents)"

    @query(name, sql)
    def hint(spark, d):
        c = F.lower("text") if accents is None else clean_review(F.col("text"), accents)
        cleaned = documents(spark, d).select("doc_id", c.alias("c"))
        return cleaned.select("doc_id", lb.keyword_hint(F.col("c"), lexicon).alias("hint"))


_register_hint("l1_hint_french", lx.FRENCH_LEXICON, True)
_register_hint("l2_hint_english", lx.ENGLISH_LEXICON, False)
_register_hint("l3_hint_arabizi", lx.ARABIZI_LEXICON, False)
_register_hint("l4_hint_old_french", lx.OLD_FRENCH_LEXICON, None)


# The three review tables: name, language in prompts, rows, lexicon, accents kept, criteria.
SOURCES = (
    ("french", "French", "d.lang = 'fr'", lx.FRENCH_LEXICON, True, lx.SHARED_TAXONOMY),
    ("english", "English", "d.lang = 'en'", lx.ENGLISH_LEXICON, False, lx.ENGLISH_TAXONOMY),
    ("third", "Arabizi", "coalesce(d.lang, '') NOT IN ('fr', 'en')", lx.ARABIZI_LEXICON, False, lx.SHARED_TAXONOMY),
)
CONTEXT_EN = (
    "concat('customer_rating: ', coalesce(CAST(l.quality AS VARCHAR), ''), chr(10), "
    "'complaint_registered: ', coalesce(CAST(l.toxic AS VARCHAR), ''), chr(10))"
)
HINTED = " UNION ALL ".join(
    f"SELECT id, '{name}' AS source, '{language}' AS language, {quoted(', '.join(taxonomy))} AS listed, text, c, context, "
    f"{sql_first('c', lexicon)} AS hint FROM (SELECT d.doc_id AS id, d.text, {sql_clean('d.text', accents)} AS c, "
    f"{CONTEXT_EN if name == 'english' else quoted('')} AS context FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {where})"
    for name, language, where, lexicon, accents, taxonomy in SOURCES
)
HINT_LINE = (
    "CASE WHEN hint IS NULL THEN '' ELSE concat('The review uses words of the criterion ''', hint, "
    "'''; prefer it over ''Global_experience''.', chr(10)) END"
)
PROMPT = (
    "concat('Label one ', language, ' customer review.', chr(10), 'Review: ', text, chr(10), "
    f"'Cleaned review: ', c, chr(10), context, {HINT_LINE}, 'Criteria: ', listed, chr(10), "
    "'Use Global_experience only when no other criterion fits. Reply with one criterion.')"
)


def each_source(spark, d, run):
    """Union of ``run(table, spec)`` over the three review tables, with their names."""
    parts = [
        run(df, spec).withColumn("source", F.lit(source[0]))
        for (df, spec), source in zip(source_tables(spark, d), SOURCES)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@query("l5_hint_sentence", f"SELECT id, source, {HINT_LINE} AS sentence FROM ({HINTED})")
def l5(spark, d):
    return each_source(
        spark, d, lambda df, spec: lab.with_hints(df, spec).select("id", pr.hint_sentence(F.col("hint")).alias("sentence"))
    )


@query("l6_context_block", f"SELECT id, source, context FROM ({HINTED})")
def l6(spark, d):
    def context(df, spec):
        fields = {c: F.col(c) for c in spec.context if c in df.columns}
        return df.select("id", pr.context_block(fields).alias("context"))

    return each_source(spark, d, context)


@query("l7_annotation_prompt", f"SELECT id, source, {PROMPT} AS prompt FROM ({HINTED})")
def l7(spark, d):
    return each_source(
        spark, d, lambda df, spec: lab.with_prompts(lab.with_hints(df, spec), spec).select("id", "prompt")
    )


PARSED = (
    "SELECT doc_id AS id, CASE WHEN token IN {taxonomy} THEN token ELSE 'Global_experience' END AS criteria "
    "FROM (SELECT doc_id, " + LAST_TOKEN.replace("{c}", "answer").replace("{", "{{").replace("}", "}}")
    + " AS token FROM (SELECT doc_id, " + ANSWER + " AS answer FROM documents {where}))"
)


@query("l8_parse_label", PARSED.format(taxonomy=quoted_list(lx.SHARED_TAXONOMY), where=""))
def l8(spark, d):
    answers = documents(spark, d).select(F.col("doc_id").alias("id"), F.expr(ANSWER).alias("answer"))
    return answers.select("id", lb.parse_label(F.col("answer")).alias("criteria"))


@query(
    "l9_parse_label_score",
    f"""WITH a AS (SELECT doc_id, coalesce({sql_strip("[x FOR x IN string_split(answer, chr(10)) IF contains(x, '|')][-1]")},
      'Expérience globale | 3') AS line FROM (SELECT doc_id, {SCORED} AS answer FROM documents))
    SELECT doc_id, {sql_strip("split_part(line, '|', 1)")} AS Critere,
      {sql_strip("substr(line, instr(line, '|') + 1)")} AS Score FROM a""",
)
def l9(spark, d):
    answers = documents(spark, d).select("doc_id", F.expr(SCORED).alias("answer"))
    return lab.label_scored(answers)


@query("l10_label_reviews", LABELLED_SQL)
def l10(spark, d):
    return labelled_corpus(spark, d).drop("lang")


@query(
    "l10_label_from_responses",
    " UNION ALL ".join(
        f"SELECT id, '{name}' AS source, criteria FROM "
        f"({PARSED.format(taxonomy=quoted_list(taxonomy), where='d WHERE ' + where)})"
        for name, _, where, _, _, taxonomy in SOURCES
    ),
)
def l10_responses(spark, d):
    stored = documents(spark, d).select(F.col("doc_id").alias("id"), F.expr(ANSWER).alias("raw"))
    return each_source(
        spark, d, lambda df, spec: lab.label_reviews(df, spec, responses=stored).select("id", "criteria")
    )


def longest_name(prompts: pd.Series) -> pd.Series:
    """Stand-in labeler: answers with a listed criterion picked by prompt length."""
    names = lx.SHARED_TAXONOMY
    return prompts.map(lambda p: f"My answer:\n{names[len(p) % len(names)]} (sure)")


# an answer that the source's own criteria lack takes the fallback
CALLED = (
    f"SELECT id, source, listed, [{', '.join(quoted(x) for x in lx.SHARED_TAXONOMY)}][length({PROMPT}) % 12 + 1] AS said "
    f"FROM ({HINTED})"
)


@query(
    "l10_label_by_callable",
    "SELECT id, source, CASE WHEN list_contains(string_split(listed, ', '), said) THEN said ELSE 'Global_experience' END "
    f"AS criteria FROM ({CALLED})",
)
def l10_callable(spark, d):
    return each_source(
        spark, d, lambda df, spec: lab.label_reviews(df, spec, labeler=longest_name).select("id", "criteria")
    )


REPAIRED = f"""WITH n AS (SELECT id, text, lower(Critere) AS low FROM ({NOISY_SQL}) WHERE text IS NOT NULL),
  w AS (SELECT *, {sql_words('low')} AS words FROM n), j AS (SELECT *, array_to_string(words, ' ') AS s FROM w),
  r AS (SELECT id, text, CASE WHEN regexp_matches(low, '^[-\\s=]+$') THEN NULL
    ELSE coalesce({sql_first('low', lx.REPAIR_GROUPS)},
      CASE WHEN contains(low, 'global') OR contains(low, 'expérience') THEN 'Expérience globale' END,
      CASE WHEN len(words) BETWEEN 1 AND 4 THEN {sql_title('s')} END) END AS Critere FROM j)
  SELECT id, text, Critere FROM r WHERE Critere IS NOT NULL"""


@query("l11_repair_labels", REPAIRED)
def l11(spark, d):
    return lab.repair_labels(noisy_corpus(spark, d))


CLEANED = f"""WITH f AS (SELECT * FROM ({NOISY_SQL}) WHERE text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY id) = 1),
  s AS (SELECT id, {sql_strip('nfc_normalize(text)')} AS text, Critere FROM f),
  l AS (SELECT id, text, {sql_strip(f"split_part(regexp_replace({sql_strip('Critere')}, '^[-\\s*]+', ''), '|', 1)")} AS Critere
    FROM s WHERE length(text) > 5 AND Critere IS NOT NULL)
  SELECT id, text, Critere FROM l"""


@query("l12_clean_corpus", f"{CLEANED} WHERE Critere IN {quoted_list(lx.STRICT_TAXONOMY_FR)}")
def l12(spark, d):
    return lab.clean_corpus(noisy_corpus(spark, d))


@query(
    "l13_polish_corpus",
    f"""SELECT CASE WHEN Critere = 'Retail: Rapidité En Caisse' THEN 'Rapidité en caisse' ELSE Critere END AS Critere,
      count(*) AS n FROM ({NOISY_SQL}) WHERE Critere IS NULL OR Critere NOT IN {quoted_list(lx.GHOST_LABELS)}
    GROUP BY 1 HAVING Critere IS NOT NULL ORDER BY n DESC, 1 LIMIT 10""",
)
def l13(spark, d):
    return top_values(lab.polish_corpus(noisy_corpus(spark, d)), "Critere", 10)


NORMALISED = (
    "CASE WHEN label IN " + quoted_list(lx.EVALUATION_TAXONOMY) + " THEN label "
    + " ".join(f"WHEN label = {quoted(a)} THEN {quoted(t)}" for a, t in lx.PREDICTION_ALIASES.items())
    + " ELSE 'Global_experience' END"
)


@query(
    "l14_normalize_prediction",
    f"SELECT doc_id, {NORMALISED} AS y_pred FROM (SELECT doc_id, replace(replace("
    + sql_strip(f"split_part({sql_strip('answer')}, chr(10), 1)")
    + f", ' ', '_'), '-', '_') AS label FROM (SELECT doc_id, {ANSWER} AS answer FROM documents))",
)
def l14(spark, d):
    answers = documents(spark, d).select("doc_id", F.expr(ANSWER).alias("answer"))
    return answers.select("doc_id", lb.normalize_prediction(F.col("answer")).alias("y_pred"))


@query(
    "l15_expansion_plan",
    f"""WITH c AS ({LABELLED_SQL}), s AS (SELECT criteria, count(text) AS n FROM c GROUP BY 1),
    k AS (SELECT criteria, n, 10000 // (SELECT count(*) FROM s) AS k FROM s),
    g AS (SELECT criteria, n, unnest(range(1, k + 1)) AS row FROM k),
    p AS (SELECT *, {sql_int('7e', 'criteria', 'row')} % n + 1 AS pos, {sql_int('7l', 'criteria', 'row')} % 4 AS lang FROM g),
    e AS (SELECT criteria, text, row_number() OVER (PARTITION BY criteria ORDER BY id) AS pos FROM c)
    SELECT p.criteria, p.row, [{", ".join(quoted(x) for x in lx.LANGUAGES)}][lang + 1] AS language, e.text AS exemplar
    FROM p JOIN e USING (criteria, pos)""",
)
def l15(spark, d):
    corpus = materialize(labelled_corpus(spark, d).select("id", "text", "criteria"), "corpus")
    return expansion_plan(
        corpus, "criteria", "text", "id", 10_000, lx.LANGUAGES, 7
    )


def scored_name(prompts: pd.Series) -> pd.Series:
    """Stand-in labeler: a criterion and a score by prompt length, now and then none."""
    names = lx.STRICT_TAXONOMY_FR
    return prompts.map(
        lambda p: "cannot say" if len(p) % 7 == 0 else f"so:\n {names[len(p) % len(names)]} | {len(p) % 5 + 1} "
    )


OLD_HINT = (
    "CASE WHEN hint IS NULL THEN '' ELSE concat('The review uses words of the criterion ''', hint, "
    "'''; prefer it over ''Expérience globale''.', chr(10)) END"
)
STRICT = f"[{', '.join(quoted(x) for x in lx.STRICT_TAXONOMY_FR)}]"


@query(
    "l10_label_scored",
    f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, {sql_first("lower(coalesce(text, ''))", lx.OLD_FRENCH_LEXICON)} AS hint FROM documents),
    p AS (SELECT doc_id, length(concat('Label one customer review with its most specific criterion and a score from 1 to 5.', chr(10),
      'Review: ', text, chr(10), {OLD_HINT}, 'Criteria: ', {quoted(", ".join(lx.STRICT_TAXONOMY_FR))}, chr(10),
      'Reply on one line: criterion | score.')) AS n FROM h)
    SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'Expérience globale' ELSE {STRICT}[n % {len(lx.STRICT_TAXONOMY_FR)} + 1] END AS Critere,
      CASE WHEN n % 7 = 0 THEN '3' ELSE (n % 5 + 1)::VARCHAR END AS Score FROM p""",
)
def l10_scored(spark, d):
    labelled = lab.label_scored_reviews(documents(spark, d).select("doc_id", "text"), scored_name)
    return labelled.select("doc_id", "Critere", "Score")


def short_review(prompts: pd.Series) -> pd.Series:
    """Stand-in generator: quotes a text by prompt length, now and then too short a one."""
    return prompts.map(lambda p: '"no"' if len(p) % 5 == 0 else f'"review" of {len(p)} ')


@query(
    "l15_expand_corpus",
    f"""WITH c AS ({LABELLED_SQL}), s AS (SELECT criteria, count(text) AS n FROM c GROUP BY 1),
    k AS (SELECT criteria, n, 3000 // (SELECT count(*) FROM s) AS k FROM s),
    g AS (SELECT criteria, n, unnest(range(1, k + 1)) AS row FROM k),
    p AS (SELECT *, {sql_int('7e', 'criteria', 'row')} % n + 1 AS pos, {sql_int('7l', 'criteria', 'row')} % {len(lx.LANGUAGES)} AS lang FROM g),
    e AS (SELECT criteria, text, row_number() OVER (PARTITION BY criteria ORDER BY id) AS pos FROM c),
    q AS (SELECT p.criteria, p.row, length(concat('Write one new customer review.', chr(10), 'Criterion: ', p.criteria, chr(10),
      'In the style of: ', e.text, chr(10), 'Language: ', [{", ".join(quoted(x) for x in lx.LANGUAGES)}][lang + 1], chr(10),
      'Do not name the criterion. Reply with the review only.')) AS len FROM p JOIN e USING (criteria, pos)),
    u AS (SELECT id::VARCHAR AS id, text, criteria FROM c UNION ALL
      SELECT concat(criteria, '#', row), concat('review of ', len), criteria FROM q WHERE len % 5 <> 0)
    SELECT id, text, criteria, row_number() OVER (ORDER BY {sql_key(7, 'id')}, id) AS shuffle_pos FROM u""",
)
def l15_expand(spark, d):
    corpus = labelled_corpus(spark, d).drop("lang")
    return lab.expand_corpus(corpus, short_review, 3000, lx.LANGUAGES, 7)


@query(
    "label_counts_by_language",
    f"SELECT d.lang, c.criteria, count(*) AS reviews FROM ({LABELLED_SQL}) c JOIN documents d ON d.doc_id = c.id GROUP BY ALL",
)
def label_counts(spark, d):
    corpus = labelled_corpus(spark, d)
    return corpus.groupBy("lang", "criteria").agg(F.count(F.lit(1)).alias("reviews"))
