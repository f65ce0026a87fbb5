"""String functions on review texts and model answers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters Unicode-aware string trimming removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The characters a cleaned review keeps besides white space.
ASCII_KEPT = "abcdefghijklmnopqrstuvwxyz0123456789.'!?"
ACCENT_KEPT = ASCII_KEPT + "àâçéèêëîïôûùüÿñæœ"


def char_class(spans: Iterable[tuple[int, int]]) -> str:
    """Regex class written as ranges only: the regex engine tests one about 1.5 times
    faster than a negated class or one that lists single characters."""
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in spans) + "]"


def outside(chars: str) -> str:
    """All characters but these."""
    edges = [-1, *sorted(ord(c) for c in set(chars)), 0x110000]
    return char_class((a + 1, b - 1) for a, b in zip(edges, edges[1:]) if a + 1 < b)


def inside(chars: str) -> str:
    """These characters, neighbours merged into one range."""
    points = sorted(ord(c) for c in set(chars))
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    return char_class(zip(starts, ends))


VISIBLE = outside(WHITESPACE)
BLANK = inside(WHITESPACE)
WORD_PATTERN = "[\\p{L}\\p{N}_]{2,}"


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


SLICE_CHARS = 1_000_000  # of text that a user callable gets at a time


def text_slices(values: pd.Series, size: Callable = len) -> Iterator[pd.Series]:
    """Runs of values whose texts take about ``SLICE_CHARS``; at least one value each."""
    low, total = 0, 0
    for i, value in enumerate(values):
        n = 0 if value is None else size(value)
        if i > low and total + n > SLICE_CHARS:
            yield values.iloc[low:i]
            low, total = i, 0
        total += n
    if low < len(values):
        yield values.iloc[low:]


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """NFC form. Code points below U+0300 are composed already, so only texts that hold
    a higher one are sent to the Arrow UDF; all others cross as nulls."""
    suspect = F.when(c.rlike("[^\\x{0}-\\x{2FF}]"), c)
    return F.coalesce(_compose(suspect), c)


def clean_review(c: Column, accents: bool) -> Column:
    """Lower-case text without links, mentions, hashtags and symbols.

    A link, mention or hashtag blanks the rest of its word, and every run of characters
    outside the kept set (white space included) becomes one space, so two passes over
    the text do the work. Null gives the empty string.
    """
    noise = outside(ACCENT_KEPT if accents else ASCII_KEPT)

    def unlinked(s: Column) -> Column:
        marked = s.contains("http") | s.contains("@") | s.contains("#")
        plain = F.regexp_replace(s, f"(?:http|[@#]){VISIBLE}+", " ")
        return F.when(marked, plain).otherwise(s)

    words = bind(F.lower(c), unlinked)
    spaced = F.regexp_replace(words, f"{noise}+", " ")
    return F.coalesce(F.trim(spaced), F.lit(""))


def split_words(c: Column) -> Column:
    """Maximal runs of non-space characters."""
    return F.array_remove(F.split(c, f"{BLANK}+"), "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def first_word(c: Column) -> Column:
    """First non-space run; empty when there is none."""
    return F.regexp_extract(c, f"{VISIBLE}+", 0)


def last_line_token(c: Column) -> Column:
    """First word of the last non-blank line.

    The stripped text ends in a visible character, so its last line is never blank.
    """
    return first_word(F.substring_index(strip_ws(c), "\n", -1))


def last_line_with(c: Column, mark: str) -> Column:
    """Last line that holds ``mark``, stripped; null when none does."""
    lines = F.filter(F.split(c, "\n"), lambda line: line.contains(mark))
    return strip_ws(F.try_element_at(lines, F.lit(-1)))


def between_markers(c: Column, start: str, end: str) -> Column:
    """Text after the last ``start`` and before the ``end`` that follows it."""
    tail = F.substring_index(c, start, -1)
    return strip_ws(F.substring_index(tail, end, 1))


def drop_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def holds_any(c: Column, words: Sequence[str]) -> Column:
    """Substring test of a bound value. The word list is one literal, so a lexicon of any
    length adds no generated code; a chain of ``or`` soon exceeds the method size limit."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.exists(listed, lambda w: c.contains(w))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Substring test against a word list; a word that holds another one is redundant."""
    return bind(c, lambda s: holds_any(s, minimal_words(words)))


def minimal_words(words: Sequence[str], seen: Sequence[str] = ()) -> list[str]:
    """The words that can decide a substring test: repeats and words that contain an
    earlier-tested or shorter word of the list never change its outcome."""
    unique = list(dict.fromkeys(words))
    return [
        w
        for w in unique
        if not any(s in w for s in seen) and not any(o in w for o in unique if o != w)
    ]


def split_pair(c: Column, sep: str = "|") -> tuple[Column, Column]:
    """Both sides of the first ``sep``, stripped; the right side is null without it."""
    left = strip_ws(F.substring_index(c, sep, 1))
    cut = F.instr(c, sep)
    right = F.when(cut > 0, strip_ws(F.substr(c, cut + F.lit(len(sep)))))
    return left, right


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns; a null fills as empty text."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)
