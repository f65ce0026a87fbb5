"""Labelling of review tables, label repair and corpus building."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import labels as lb
from opinara.functions import lexicons as lx
from opinara.functions.prompts import (
    annotation_prompt,
    context_block,
    expansion_prompt,
    scored_prompt,
)
from opinara.functions.text import clean_review, nfc, strip_ws, text_slices
from opinara.operators.filters import (
    dedupe_first,
    drop_labels,
    drop_null,
    keep_labels,
    min_length,
)
from opinara.operators.sampling import expansion_plan, shuffle_rows
from opinara.session import materialize
from opinara.sources.schema import harmonise, keep_existing, require_columns


@dataclass(frozen=True)
class SourceSpec:
    """How one review table is read and labelled."""

    text: str
    lexicon: Mapping[str, Sequence[str]]
    taxonomy: Sequence[str]
    accents: bool = True
    context: Sequence[str] = ()
    language: str = ""
    fallback: str = lx.FALLBACK
    extra: Sequence[str] = field(default_factory=tuple)


FRENCH = SourceSpec(
    "text", lx.FRENCH_LEXICON, lx.SHARED_TAXONOMY, context=("sentiment",), language="French"
)
ENGLISH = SourceSpec(
    "review_text",
    lx.ENGLISH_LEXICON,
    lx.ENGLISH_TAXONOMY,
    accents=False,
    context=(
        "sentiment", "customer_rating", "response_time_hours", "issue_resolved",
        "complaint_registered",
    ),
    language="English",
)
ARABIZI = SourceSpec(
    "InputText",
    lx.ARABIZI_LEXICON,
    lx.SHARED_TAXONOMY,
    accents=False,
    language="Arabizi",
    extra=("SentimentLabel",),
)

Labeler = Callable[[pd.Series], pd.Series]


def with_hints(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Add ``clean`` and ``hint``; two projections, so the text is cleaned once."""
    cleaned = df.withColumn("clean", clean_review(F.col(spec.text), spec.accents))
    return cleaned.withColumn("hint", lb.keyword_hint(F.col("clean"), spec.lexicon))


def with_prompts(df: DataFrame, spec: SourceSpec) -> DataFrame:
    context = context_block({c: F.col(c) for c in spec.context if c in df.columns})
    return df.withColumn(
        "prompt",
        annotation_prompt(
            F.col(spec.text), F.col("clean"), F.col("hint"), context,
            spec.taxonomy, spec.language, spec.fallback,
        ),
    )


def ask(df: DataFrame, labeler: Labeler, prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Answers of a user callable, a slice of an Arrow batch of prompts at a time.

    A slice whose call fails is asked row by row; a row that fails has no answer.
    """

    def one(text: str) -> str | None:
        try:
            return labeler(pd.Series([text])).iloc[0]
        except Exception:
            return None

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for prompts in text_slices(batch):
                try:
                    yield pd.Series(list(labeler(prompts)), index=prompts.index, dtype="object")
                except Exception:
                    yield prompts.map(one)

    call = F.pandas_udf(answers, "string")
    return df.withColumn(out, call(F.col(prompt)))


def label_reviews(
    df: DataFrame,
    spec: SourceSpec,
    labeler: Labeler | None = None,
    responses: DataFrame | None = None,
    key: str = "id",
) -> DataFrame:
    """Text and ``criteria`` of every review.

    Answers come from ``labeler``, or from a stored ``responses(key, raw)`` table; with
    neither the keyword hint is the label. Whatever is not in the taxonomy, or has no
    answer, takes the fallback.
    """
    require_columns(df, [spec.text])
    hinted = with_hints(df, spec)
    if labeler is not None:
        hinted = ask(with_prompts(hinted, spec), labeler)
        criteria = lb.parse_label(F.col("answer"), spec.taxonomy, spec.fallback)
    elif responses is not None:
        stored = responses.select(key, F.col("raw").alias("answer"))
        hinted = hinted.join(stored, key, "left")
        criteria = lb.parse_label(F.col("answer"), spec.taxonomy, spec.fallback)
    else:
        criteria = F.coalesce(F.col("hint"), F.lit(spec.fallback))
    labelled = hinted.withColumn("criteria", criteria)
    return keep_existing(labelled, [key, spec.text, "criteria", *spec.extra])


def label_scored(df: DataFrame, answer: str = "answer") -> DataFrame:
    """``Critere`` and ``Score`` from ``label | score`` answers."""
    label, score = lb.parse_label_score(F.col(answer))
    return df.withColumns({"Critere": label, "Score": score}).drop(answer)


def label_scored_reviews(
    df: DataFrame,
    labeler: Labeler,
    text: str = "text",
    lexicon: Mapping[str, Sequence[str]] = lx.OLD_FRENCH_LEXICON,
    taxonomy: Sequence[str] = lx.STRICT_TAXONOMY_FR,
) -> DataFrame:
    """``Critere`` and ``Score`` of every review, asked for together.

    The hint is looked up in the lower-cased raw text. Columns of these names are
    replaced; an answer without a ``|`` line takes the fallback.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    hinted = df.drop("Critere", "Score").withColumn("__hint", lb.keyword_hint(F.lower(raw), lexicon))
    asked = hinted.withColumn("__prompt", scored_prompt(raw, F.col("__hint"), taxonomy, lx.FALLBACK_FR))
    answered = ask(asked, labeler, "__prompt", "__answer")
    return label_scored(answered, "__answer").drop("__hint", "__prompt")


def expand_corpus(
    df: DataFrame,
    generator: Labeler,
    target: int,
    languages: Sequence[str],
    seed: int,
    label: str = "criteria",
    text: str = "text",
    key: str = "id",
    least: int = 5,
) -> DataFrame:
    """The corpus with generated reviews, ``(key, text, label, shuffle_pos)``.

    Every label gets the same number of prompts, each with an exemplar and a language.
    Answers lose their double quotes; those of at most ``least`` characters, and rows
    that failed, are left out. A new row's key is its label and number. The corpus is
    written once and read from there, since sizes, exemplars and both passes of the
    shuffle need it, however dear its rows are.
    """
    df = materialize(df.select(key, text, label), "corpus")
    plan = expansion_plan(df, label, text, key, target, list(languages), seed)
    prompt = expansion_prompt(F.coalesce(F.col(label), F.lit("")), F.col("exemplar"), F.col("language"))
    asked = ask(plan.withColumn("__prompt", prompt), generator, "__prompt", "__answer")
    written = F.replace(strip_ws(F.col("__answer")), F.lit('"'), F.lit(""))
    fresh = asked.select(
        F.concat_ws("#", F.col(label), F.col("row").cast("string")).alias(key),
        written.alias(text),
        F.col(label),
    ).where(F.length(text) > least)
    known = df.select(F.col(key).cast("string").alias(key), text, label)
    return shuffle_rows(known.unionByName(fresh), seed, key)


def repair_labels(df: DataFrame, text: str = "text", label: str = "Critere") -> DataFrame:
    """Rows with a text whose label could be repaired."""
    repaired = drop_null(df, [text]).withColumn(label, lb.repair_label(F.col(label)))
    return drop_null(repaired, [label])


def normalised_corpus(
    df: DataFrame, key: str = "id", text: str = "text", label: str = "Critere"
) -> DataFrame:
    """First copy of each raw text, composed and stripped, with a tidied label.

    Copies are removed before the text is normalised, so texts that only become equal
    by it stay apart.
    """
    first = dedupe_first(drop_null(df, [text]), text, key)
    tidy = min_length(first.withColumn(text, strip_ws(nfc(F.col(text)))), text)
    return drop_null(tidy, [label]).withColumn(label, lb.fix_label(F.col(label)))


def clean_corpus(
    df: DataFrame,
    valid_labels: Sequence[str] = lx.STRICT_TAXONOMY_FR,
    key: str = "id",
    text: str = "text",
    label: str = "Critere",
) -> DataFrame:
    return keep_labels(normalised_corpus(df, key, text, label), label, valid_labels)


def polish_corpus(
    df: DataFrame,
    junk: Sequence[str] = lx.GHOST_LABELS,
    fixes: Mapping[str, str] = lx.LABEL_FIXES,
    label: str = "Critere",
) -> DataFrame:
    """Drop ghost labels, then replace misspelt ones."""
    return drop_labels(df, label, junk).replace(dict(fixes), subset=[label])


def combine_sources(
    sources: Sequence[tuple[DataFrame, str]],
    seed: int = 42,
    key: str = "id",
    label: str = "criteria",
    sort: bool = False,
) -> DataFrame:
    """Union of ``(table, text column)`` sources with a label, in a seeded shuffle order.

    Ids must be unique over all sources.
    """
    parts = []
    for df, text in sources:
        require_columns(df, [key, text, label])
        parts.append(harmonise(df, {text: "text"}, [key, "text", label]))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return shuffle_rows(drop_null(union, [label]), seed, key, sort=sort)
