"""Brute-force counterparts and awkward inputs."""

import re

SPACED = "[^\x20\x09-\x0D]+"
ALNUM = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# extra columns, named like columns the operators make
EXTRA = "counts string, uid string, h string, name string, row_key string, x0 string, cid string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(SPACED, lower(text))


def alnum(text):
    return re.findall(ALNUM, lower(text))


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    """Documents of ``(doc_id, text)`` or longer rows, with extra columns."""
    width = len(schema.split(","))
    full = [tuple(r) + (None,) * (width - len(r)) + ("x", None, "1", "n", "k", "0", "c") for r in rows]
    return spark.createDataFrame(full, f"{schema}, {EXTRA}")


AWKWARD = [
    (1, "One two three four five six seven."),
    (2, "one TWO three four five six seven."),
    (3, ""),
    (4, None),
    (5, " \n\t "),
    (6, "naïve café — “quoted” 日本語 don't İstanbul <|endoftext|> x"),
    (None, "no key here at all"),
    (7, "short"),
    (7, "short"),
    (8, "word " * 30000),
    (9, "a\x0bb\x0cc\x1cd e f"),
]
