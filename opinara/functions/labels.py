"""Label rules as column expressions: hints, answer parsing, repair, normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.functions.text import (
    bind,
    contains_any,
    holds_any,
    last_line_token,
    last_line_with,
    minimal_words,
    split_pair,
    split_words,
    strip_ws,
)


def first_match(c: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Name of the first group with a word inside the text, else null.

    Words that an earlier group would always catch first are left out, which keeps the
    expression short without changing its value.
    """

    def pick(s: Column) -> Column:
        tested: list[str] = []
        branch: Column | None = None
        for name, words in groups.items():
            deciding = minimal_words(words, tested)
            if not deciding:
                continue
            test = holds_any(s, deciding)
            branch = F.when(test, name) if branch is None else branch.when(test, name)
            tested += deciding
        return branch

    return bind(c, pick)


def keyword_hint(c: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    return first_match(c, lexicon)


def fix_label(c: Column) -> Column:
    """Strip, drop leading bullets, keep the text before the first bar."""
    bare = F.regexp_replace(strip_ws(c), "(?U)^[-\\s*]+", "")
    return strip_ws(F.substring_index(bare, "|", 1))


def is_separator(c: Column) -> Column:
    return c.rlike("(?U)^[-\\s=]+$")


def title_case(c: Column) -> Column:
    """Capital after every character that has no case.

    ``initcap`` only looks at blanks, so a marked blank is put after each such
    character and taken out again.
    """
    spaced = F.regexp_replace(F.lower(c), "([^\\p{Lu}\\p{Ll}\\p{Lt}])", "$1\u0001 ")
    return F.replace(F.initcap(spaced), F.lit("\u0001 "), F.lit(""))


def title_label(c: Column, max_words: int = 4) -> Column:
    """One to ``max_words`` words in title case; null for none or more."""
    words = split_words(c)
    fits = F.size(words).between(1, max_words)
    return F.when(fits, title_case(F.array_join(words, " ")))


def canonical_label(c: Column) -> Column:
    """First line of an answer with blanks and hyphens as underscores."""
    line = strip_ws(F.substring_index(strip_ws(c), "\n", 1))
    return F.translate(line, " -", "__")


def normalize_prediction(
    c: Column,
    taxonomy: Sequence[str] = lx.EVALUATION_TAXONOMY,
    aliases: Mapping[str, str] = lx.PREDICTION_ALIASES,
    fallback: str = lx.FALLBACK,
) -> Column:
    """Known label, else alias, else the fallback; case matters."""
    label = canonical_label(c)
    known = F.when(label.isin(list(taxonomy)), label)
    for alias, target in aliases.items():
        known = known.when(label == alias, target)
    return known.otherwise(fallback)


def parse_label(
    c: Column,
    taxonomy: Sequence[str] = lx.SHARED_TAXONOMY,
    fallback: str = lx.FALLBACK,
) -> Column:
    """Label at the start of the last answer line, else the fallback."""
    token = last_line_token(c)
    return F.when(token.isin(list(taxonomy)), token).otherwise(fallback)


def parse_label_score(
    c: Column, fallback: str = f"{lx.FALLBACK_FR} | 3"
) -> tuple[Column, Column]:
    """Label and score of the last ``label | score`` line."""
    return split_pair(F.coalesce(last_line_with(c, "|"), F.lit(fallback)))


def repair_label(
    c: Column, groups: Mapping[str, Sequence[str]] = lx.REPAIR_GROUPS
) -> Column:
    """Map a messy label to an official one, a global one, a short title, or null.

    A null label stays null.
    """
    low = F.lower(c)
    return (
        F.when(is_separator(low), F.lit(None))
        .otherwise(
            F.coalesce(
                first_match(low, groups),
                F.when(contains_any(low, lx.REPAIR_GLOBAL), lx.FALLBACK_FR),
                title_label(low),
            )
        )
        .cast("string")
    )


def multi_label(c: Column, taxonomy: Sequence[str], k: int = 3) -> Column:
    """First ``k`` exact taxonomy names of a comma-separated answer."""
    names = F.transform(F.split(c, ","), strip_ws)
    return F.slice(F.filter(names, lambda n: n.isin(list(taxonomy))), 1, k)
