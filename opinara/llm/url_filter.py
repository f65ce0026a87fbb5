"""URL verdicts: fixed host rules, then association rules mined from labelled URLs.

Spark's FP-growth finds token combinations that occur together with bad labels. A
combination of at most ``longest`` tokens becomes a rule if it is frequent enough and the
share of bad URLs among those that have it reaches the confidence. Rules are indexed by
their rarest token; a URL looks its tokens up and the rules found are checked in full.
Everything runs on DataFrame functions. URLs with the same tokens are looked up once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
BAD = "label=bad"

# Host rules of the registered query: a host, then how the path must start.
HOST_RULES = (
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
)


@dataclass(frozen=True)
class Settings:
    support: float = 0.002  # of labelled URLs that have the tokens and are bad
    least_rows: int = 10  # such URLs at least
    confidence: float = 0.5
    longest: int = 3


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the URL is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule, null if none fits; of equally long ones the first listed."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):  # the last one wins
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: scheme, host labels, path segments and query keys, numbers
    as N; an empty array if the URL is null or has no ``://``."""
    text = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    rest = after_scheme(text)
    there = F.instr(text, "://") > 0
    scheme = F.array(F.concat(F.lit("scheme="), F.substring_index(text, "://", 1)))
    host = F.transform(F.split(host_of(text), r"\."), lambda x: F.concat(F.lit("host="), x))
    path = F.transform(
        F.filter(F.split(path_of(text), "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "N")),
    )
    query = F.transform(
        F.filter(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)),
    )
    every = F.array_sort(F.array_distinct(F.concat(scheme, host, path, query)))
    return F.when(there, every).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, s: Settings) -> DataFrame:
    """Rules ``(rule, tokens, first, confidence)`` from ``(tokens, bad)`` rows.

    ``first`` is a rule's rarest token, the smaller one of equals. Rules are as many as
    there are frequent combinations, which the support bounds at any table size.
    """
    empty = "tokens array<string>, first string, confidence double"
    spark = labelled.sparkSession
    n = labelled.count()
    least = max(s.least_rows, math.ceil(s.support * n))
    if n < least:
        return spark.createDataFrame([], empty)
    items = labelled.select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")
    )
    # half a row less than the least count, so that no rounding can raise it
    growth = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=0.0)
    found = growth.fit(items).freqItemsets.where(F.size("items") <= s.longest + 1)
    sets = materialize(found.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("bad")
    )
    rules = (
        with_bad.join(sets.withColumnRenamed("items", "tokens"), "tokens")
        .withColumn("confidence", F.col("bad") / F.col("freq"))
        .where(F.col("confidence") >= s.confidence)
    )
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("first"), F.col("freq").alias("n"))
    rarest = (
        rules.select("tokens", "confidence", F.explode("tokens").alias("first"))
        .join(single, "first")
        .groupBy("tokens", "confidence")
        .agg(F.min_by("first", F.struct("n", "first")).alias("first"))
    )
    return rarest.select("tokens", "first", "confidence")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    host_rules=HOST_RULES,
    settings: Settings = Settings(),
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)``, one row per input row.

    ``labelled`` has ``url`` and ``bad`` (boolean; null rows are left out). A null URL or
    one without ``://`` has an empty host and path, no tokens, and is allowed. Where no
    host rule fits, a URL that an association rule matches is blocked, any other allowed;
    ``confidence`` is of the surest rule, null if none matches. Repeated rows stay.
    """
    known = labelled.where("bad IS NOT NULL").select(url_tokens(F.col(url)).alias("tokens"), "bad")
    rules = materialize(mine(known, settings), "url_rules")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.select(
        "page_id",
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        url_tokens(F.col("url")).alias("tokens"),
    )
    index = rules.select(F.col("first"), F.col("tokens").alias("rule_tokens"), "confidence")
    matched = (
        rows.select("tokens")
        .distinct()
        .select("tokens", F.explode("tokens").alias("first"))
        .join(index, "first")
        .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("confidence"))
    )
    judged = rows.join(matched, "tokens", "left")
    rule = longest_rule(F.col("host"), F.col("path"), host_rules)
    by_rule = F.lit(None).cast("string")
    for name, verdict in host_rules:
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    by_method = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, by_method).alias("verdict"), "confidence"
    )
