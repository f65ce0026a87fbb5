"""Prompt texts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.functions.text import render

# Turn marks of the ChatML format and of the header format.
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
HEADER_START, HEADER_END, TURN_END = "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
ASSISTANT_MARK = f"{IM_START}assistant\n"

CLASSIFY = (
    "Assign the customer review to one criterion.\n"
    f"Criteria: {', '.join(lx.EVALUATION_TAXONOMY)}.\n"
    "Reply with the name of the criterion only."
)
CLASSIFY_SCORED = "Give the criterion and the score of this review as: criterion | score."
CLASSIFY_MULTI = (
    "Name up to three criteria of this review, separated by commas.\n"
    f"List: {', '.join(lx.STRICT_TAXONOMY_FR)}"
)

ANNOTATION = (
    "Label one {language} customer review.\n"
    "Review: {text}\n"
    "Cleaned review: {clean}\n"
    "{context}{hint}"
    "Criteria: {taxonomy}\n"
    "Use {fallback} only when no other criterion fits. Reply with one criterion."
)
HINT = "The review uses words of the criterion '{hint}'; prefer it over '{fallback}'.\n"


SCORED_ANNOTATION = (
    "Label one customer review with its most specific criterion and a score from 1 to 5.\n"
    "Review: {text}\n"
    "{hint}"
    "Criteria: {taxonomy}\n"
    "Reply on one line: criterion | score."
)
EXPANSION = (
    "Write one new customer review.\n"
    "Criterion: {label}\n"
    "In the style of: {exemplar}\n"
    "Language: {language}\n"
    "Do not name the criterion. Reply with the review only."
)


def chatml(system: str, user: Column, answer: Column | None = None) -> Column:
    """System, user and assistant turns; without an answer the prompt stays open."""
    head = F.concat(
        F.lit(f"{IM_START}system\n{system}{IM_END}\n{IM_START}user\n"),
        user,
        F.lit(f"{IM_END}\n{ASSISTANT_MARK}"),
    )
    return head if answer is None else F.concat(head, answer, F.lit(IM_END))


def hint_sentence(hint: Column, fallback: str = lx.FALLBACK) -> Column:
    filled = render(HINT.replace("{fallback}", fallback), hint=hint)
    return F.when(hint.isNotNull(), filled).otherwise("")


def context_block(fields: Mapping[str, Column]) -> Column:
    """One line per context column, empty where the value is missing."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")), F.lit("\n"))
        for name, c in fields.items()
    ]
    return F.concat(*lines) if lines else F.lit("")


def annotation_prompt(
    text: Column,
    clean: Column,
    hint: Column,
    context: Column,
    taxonomy: Sequence[str],
    language: str = "",
    fallback: str = lx.FALLBACK,
) -> Column:
    return render(
        ANNOTATION,
        language=F.lit(language),
        text=text,
        clean=clean,
        hint=hint_sentence(hint, fallback),
        context=context,
        taxonomy=F.lit(", ".join(taxonomy)),
        fallback=F.lit(fallback),
    )

def scored_prompt(text: Column, hint: Column, taxonomy: Sequence[str], fallback: str) -> Column:
    """Asks for ``criterion | score``."""
    listed = F.lit(", ".join(taxonomy))
    return render(SCORED_ANNOTATION, text=text, hint=hint_sentence(hint, fallback), taxonomy=listed)


def expansion_prompt(label: Column, exemplar: Column, language: Column) -> Column:
    return render(EXPANSION, label=label, exemplar=exemplar, language=language)
