"""Functions on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_tokens(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def truncate_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def keep_end(tokens: Column, n: int) -> Column:
    """The last ``n`` tokens."""
    size = F.size(tokens)
    return F.when(size > n, F.slice(tokens, -n, n)).otherwise(tokens)


def ensure_eos(tokens: Column, eos: Column | str) -> Column:
    last = F.try_element_at(tokens, F.lit(-1))
    return F.when(last.eqNullSafe(F.lit(eos)), tokens).otherwise(F.array_append(tokens, F.lit(eos)))


def ensure_bos(tokens: Column, bos: Column | str) -> Column:
    first = F.try_element_at(tokens, F.lit(1))
    return F.when(first.eqNullSafe(F.lit(bos)), tokens).otherwise(F.array_prepend(tokens, F.lit(bos)))


def ensure_text_eos(text: Column, eos: str) -> Column:
    return F.when(F.endswith(text, F.lit(eos)), text).otherwise(F.concat(text, F.lit(eos)))


def ensure_text_bos(text: Column, bos: str) -> Column:
    return F.when(F.startswith(text, F.lit(bos)), text).otherwise(F.concat(F.lit(bos), text))


def double_bos(text: Column, bos: str) -> Column:
    """True when a tokenizer that adds ``bos`` would put it a second time."""
    return F.startswith(text, F.lit(bos))


def repeat(value: Column, n: Column) -> Column:
    return F.array_repeat(value, n.cast("int"))


def completion_mask(n_prompt: Column, n_all: Column) -> Column:
    """Zeros over the prompt, ones over the rest."""
    zeros = F.least(n_prompt, n_all)
    return F.concat(repeat(F.lit(0), zeros), repeat(F.lit(1), n_all - zeros))


def masked_labels(prompt: Column, answer: Column, pad: Column | str = "-100") -> Column:
    """Answer tokens behind one ``pad`` per prompt token."""
    return F.concat(repeat(F.lit(pad), F.size(prompt)), answer)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest shared start of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first == 0, a).otherwise(F.slice(a, F.lit(1), (first - 1).cast("int")))
