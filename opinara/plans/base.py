"""Query registry, given tables, and the inputs derived from them.

Inputs the given tables lack (noisy labels, model answers, pairs) are derived from
their rows by one SQL expression each, which Spark and the checking engine both read;
the operators under test are written separately in either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.functions.labels import keyword_hint
from opinara.functions.text import WHITESPACE, clean_review
from opinara.operators.labeling import ARABIZI, ENGLISH, FRENCH, SourceSpec
from opinara.sources.files import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its checking SQL where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return read_table(spark, directory, name)


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "documents"), "doc_id")


# ---- SQL text for the checking engine -------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def sql_strip(c: str) -> str:
    return f"trim({c}, {quoted(WHITESPACE)})"


def sql_clean(c: str, accents: bool) -> str:
    """The cleaner in its stated steps, one replacement each."""
    kept = "àâçéèêëîïôûùüÿñæœ" if accents else ""
    out = f"lower({c})"
    for pattern in ("http\\S+", "@[^\\s]+", "#[^\\s]+", f"[^a-z0-9{kept}\\s\\.''!?]", "\\s+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"coalesce(trim({out}), '')"


def sql_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


def sql_first(c: str, groups) -> str:
    arms = " ".join(f"WHEN {sql_any(c, words)} THEN {quoted(name)}" for name, words in groups.items())
    return f"CASE {arms} END"


def sql_words(c: str) -> str:
    return f"regexp_extract_all({c}, '[^\\s]+')"


def sql_title(c: str) -> str:
    """Upper-case a letter that follows no letter, character by character."""
    letters = f"string_split({c}, '')"
    return (
        f"array_to_string([CASE WHEN i = 1 OR NOT regexp_matches({letters}[i-1], '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]') "
        f"THEN upper({letters}[i]) ELSE lower({letters}[i]) END FOR i IN range(1, len({letters}) + 1)], '')"
    )


def sql_key(seed, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def sql_int(seed, *cols: str) -> str:
    return f"(('0x' || substr({sql_key(seed, *cols)}, 1, 15))::BIGINT)"


# ---- Derived inputs -------------------------------------------------------------------

# A label column as noisy as free-form answers are.
NOISY = (
    "CASE n_chars % 16 WHEN 0 THEN '---' WHEN 1 THEN '- Sentiment' "
    "WHEN 2 THEN 'Retail: Rapidité En Caisse' WHEN 3 THEN 'Qualité du service | 4' "
    "WHEN 4 THEN '*  Prix' WHEN 5 THEN 'Expérience globale' WHEN 6 THEN 'Excellente ambiance' "
    "WHEN 7 THEN 'd''ambiance calme' WHEN 8 THEN 'une phrase beaucoup trop longue ici' "
    "WHEN 9 THEN NULL WHEN 10 THEN '- Service | 4' WHEN 11 THEN source "
    "WHEN 12 THEN concat(lang, '  ', source) WHEN 13 THEN 'Propreté' WHEN 14 THEN 'Category' "
    "ELSE substring(text, 1, 24) END"
)

# A model answer: some lines of talk, then a label in one of several spellings.
ANSWER = (
    "CASE n_chars % 8 WHEN 0 THEN 'Price value' WHEN 1 THEN 'Food' WHEN 2 THEN 'Service-quality' "
    "WHEN 3 THEN concat('I think:', chr(10), chr(10), 'Speed (', lang, ')', chr(10)) "
    "WHEN 4 THEN 'speed' WHEN 5 THEN '' WHEN 6 THEN concat(' Service', chr(10), 'since ', source) "
    "ELSE concat(substring(text, 1, 40), chr(10), ' Quality ') END"
)

# A ``label | score`` answer.
SCORED = (
    "CASE n_chars % 4 WHEN 0 THEN concat('x', chr(10), 'Prix | 2') WHEN 1 THEN 'none' "
    "WHEN 2 THEN concat('Goût | ', lang, ' | 4', chr(10), source) "
    "ELSE concat(substring(text, 1, 30), chr(10), ' Service | 5 ', chr(10), 'end') END"
)

# Cells some of which read as missing.
CELL = "CASE n_chars % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE source END"


def noisy_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``(id, text, Critere)`` with a score now and then."""
    return documents(spark, directory).select(
        F.col("doc_id").alias("id"), "text", F.expr(NOISY).alias("Critere")
    )


NOISY_SQL = f"SELECT doc_id AS id, text, {NOISY} AS Critere FROM documents"


def source_tables(spark: SparkSession, directory: str) -> list[tuple[DataFrame, SourceSpec]]:
    """The three review tables: French, English, and the rest in the third role."""
    docs = documents(spark, directory)
    rating = table(spark, directory, "labels")
    french = docs.where("lang = 'fr'").select(F.col("doc_id").alias("id"), "text")
    english = docs.where("lang = 'en'").select(
        F.col("doc_id").alias("id"), F.col("text").alias("review_text")
    )
    third = docs.where("coalesce(lang, '') NOT IN ('fr', 'en')").select(
        F.col("doc_id").alias("id"), F.col("text").alias("InputText")
    )
    context = rating.select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("customer_rating"),
        F.col("toxic").alias("complaint_registered"),
    )
    return [(french, FRENCH), (english.join(context, "id", "left"), ENGLISH), (third, ARABIZI)]


def labelled_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``(id, lang, text, criteria)`` of all documents in one pass, each by its source's
    lexicon; any other language, or none, takes the third role."""
    docs = documents(spark, directory).select(F.col("doc_id").alias("id"), "lang", "text")
    lang = F.col("lang")
    french, english = lang.eqNullSafe(F.lit("fr")), lang.eqNullSafe(F.lit("en"))
    cleaned = F.when(french, clean_review(F.col("text"), True)).otherwise(clean_review(F.col("text"), False))
    hint = (
        F.when(french, keyword_hint(F.col("c"), FRENCH.lexicon))
        .when(english, keyword_hint(F.col("c"), ENGLISH.lexicon))
        .otherwise(keyword_hint(F.col("c"), ARABIZI.lexicon))
    )
    criteria = F.coalesce(hint, F.lit(lx.FALLBACK))
    return docs.withColumn("c", cleaned).withColumn("criteria", criteria).drop("c")


LABELLED_SQL = (
    "SELECT doc_id AS id, text, coalesce(CASE coalesce(lang, '') WHEN 'fr' THEN "
    f"{sql_first(sql_clean('text', True), lx.FRENCH_LEXICON)} WHEN 'en' THEN "
    f"{sql_first(sql_clean('text', False), lx.ENGLISH_LEXICON)} ELSE "
    f"{sql_first(sql_clean('text', False), lx.ARABIZI_LEXICON)} END, 'Global_experience') AS criteria "
    "FROM documents"
)

# Two label columns to compare: the label of the source and another lexicon's guess.
def predictions(spark: SparkSession, directory: str) -> DataFrame:
    """``(id, y_true, y_pred)``: the corpus label against the shared French lexicon's."""
    cleaned = labelled_corpus(spark, directory).withColumn("c", clean_review(F.col("text"), True))
    guess = F.coalesce(keyword_hint(F.col("c"), lx.FRENCH_LEXICON), F.lit(lx.FALLBACK))
    return cleaned.select("id", F.col("criteria").alias("y_true"), guess.alias("y_pred"))


PREDICTIONS_SQL = (
    f"SELECT id, criteria AS y_true, coalesce({sql_first(sql_clean('text', True), lx.FRENCH_LEXICON)}, "
    f"'Global_experience') AS y_pred FROM ({LABELLED_SQL})"
)

# Prompt and two answers per document: its first line, the rest, and the rest as another
# hand would have written it.
PAIR_SQL = (
    "SELECT doc_id AS id, split_part(text, chr(10), 1) AS prompt, "
    "concat(chr(10), substring(text, length(split_part(text, chr(10), 1)) + 2)) AS chosen, "
    "replace(substring(text, length(split_part(text, chr(10), 1)) + 2), 'e', 'ee ') AS rejected "
    "FROM documents"
)


def pairs(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    first = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, chr(10), 1)) + 2)")
    return docs.select(
        F.col("doc_id").alias("id"),
        first.alias("prompt"),
        F.concat(F.lit("\n"), rest).alias("chosen"),
        F.replace(rest, F.lit("e"), F.lit("ee ")).alias("rejected"),
    )
