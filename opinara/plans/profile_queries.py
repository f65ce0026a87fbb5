"""Column profiles, distributions, correlations and outliers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from opinara.operators import correlation as co
from opinara.operators import outliers as ol
from opinara.operators import profiling as pf
from opinara.operators.sampling import top_values
from opinara.plans.base import documents, query, quoted, table

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TYPES = dict.fromkeys(LINE_COLS, "double")


def _sql_missing(name: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(c)} AS \"column\", count(*) - count({c}) AS missing_count, "
        f"CASE WHEN count(*) > 0 THEN 100.0 * (count(*) - count({c})) / count(*) ELSE 0 END::DOUBLE AS missing_pct FROM {name}"
        for c in cols
    )


JOINED = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
JOINED_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def joined(spark, d):
    docs = documents(spark, d).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select(*JOINED_COLS)


@query("a1_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def a1(spark, d):
    return top_values(documents(spark, d), "lang")


@query("a2_distinct_values", "SELECT DISTINCT source FROM documents")
def a2(spark, d):
    return documents(spark, d).select("source").distinct()


@query(
    "a3_missing_summary",
    f'SELECT "column", missing_count, round(missing_pct, 6) AS missing_pct FROM ({_sql_missing(JOINED, JOINED_COLS)})',
)
def a3(spark, d):
    return pf.missing_summary(joined(spark, d)).withColumn("missing_pct", F.round("missing_pct", 6))


def _sql_profile(name: str, types: dict[str, str], numeric: set[str]) -> str:
    rows = []
    for c, kind in types.items():
        x = f"{c}::DOUBLE"
        if c in numeric:
            stats = (
                f"round(avg({x}), 7) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, max({x}) AS max, "
                f"round(coalesce(skewness({x}), 0), 6) AS skew, round(coalesce(kurtosis({x}), 0), 6) AS kurtosis, "
                f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS median, "
                f"round(quantile_cont({x}, 0.75), 6) AS q75, NULL::VARCHAR AS mode"
            )
        else:
            stats = ", ".join(
                f"NULL::DOUBLE AS {s}" for s in ("mean", "std", "min", "max", "skew", "kurtosis", "q25", "median", "q75")
            ) + f", (SELECT v FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS mode"
        rows.append(
            f"SELECT {quoted(c)} AS \"column\", {quoted(kind)} AS dtype, count(*) - count({c}) AS n_missing, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS missing_pct, count(DISTINCT {c}) AS n_unique, "
            f"count(DISTINCT {c}) <= 1 AS is_constant, {stats} FROM {name}"
        )
    return " UNION ALL ".join(rows)


def _rounded(profiled):
    cols = ["missing_pct", "mean", "std", "skew", "kurtosis", "q25", "median", "q75"]
    rounded = {c: F.round(c, 6) for c in cols}
    # Means of two-digit prices end in ...5 at six digits; seven are safe to compare.
    return profiled.withColumns(rounded | {"mean": F.round("mean", 7)})


TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


@query(
    "a4_profile_reviews",
    _sql_profile(JOINED, TYPES, {"doc_id", "n_chars", "quality", "toxic"}),
)
def a4(spark, d):
    return _rounded(pf.profile(joined(spark, d)))


LINE_KEYS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
LINE_WORDS = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
LINE_PROFILE = LINE_KEYS | LINE_TYPES | LINE_WORDS


@query("a4_profile_lineitem", _sql_profile("lineitem", LINE_PROFILE, {*LINE_KEYS, *LINE_COLS}))
def a4_lineitem(spark, d):
    return _rounded(pf.profile(table(spark, d, "lineitem")))


def _sql_moments(name: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(c)} AS col, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, "
        f"max({c})::DOUBLE AS max, round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis, "
        f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 FROM {name}"
        for c in cols
    )


@query("a5_numeric_summary", _sql_moments("events", ["value"]) + " UNION ALL " + _sql_moments("events", ["user_id"]))
def a5(spark, d):
    events = table(spark, d, "events").select("value", "user_id")
    both = pf.numeric_moments(events, ["value", "user_id"]).join(
        pf.quartile_table(events, ["value", "user_id"]), "col"
    )
    return both.withColumns({c: F.round(c, 6) for c in ("mean", "std", "skew", "kurtosis", "q25", "median", "q75")})


@query(
    "a6_column_modes",
    " UNION ALL ".join(
        f"SELECT {quoted(c)} AS col, (SELECT count(DISTINCT {c}) FROM {JOINED}) AS n_unique, "
        f"(SELECT v FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {JOINED} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS mode"
        for c in JOINED_COLS
    ),
)
def a6(spark, d):
    return pf.column_modes(joined(spark, d), JOINED_COLS)


KINDED = f"(SELECT *, 'review' AS kind FROM {JOINED})"


@query(
    "a7_profile_flags",
    " UNION ALL ".join(
        [f"""SELECT "column", 'high_missing' AS flag FROM ({_sql_missing(KINDED, [*JOINED_COLS, "kind"])}) WHERE missing_pct > 50"""]
        + [f"SELECT {quoted(c)}, 'high_cardinality' FROM {KINDED} HAVING count(DISTINCT {c}) > 100" for c in ("text", "lang", "source", "kind")]
        + [f"SELECT {quoted(c)}, 'constant' FROM {KINDED} HAVING count(DISTINCT {c}) <= 1" for c in (*JOINED_COLS, "kind")]
    ),
)
def a7(spark, d):
    return pf.profile_flags(pf.profile(joined(spark, d).withColumn("kind", F.lit("review"))))


HISTOGRAM = """WITH s AS (SELECT count({c}) AS n, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
    quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, skewness({c}) AS skew, kurtosis({c}) AS kurt FROM {t}),
  w AS (SELECT *, (hi - lo) / (log2(n) + 1) AS sturges, 2 * iqr / pow(n, 1.0/3) AS fd FROM s),
  b AS (SELECT *, greatest(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END), 1)::BIGINT AS k FROM w),
  g AS (SELECT unnest(range(0, (SELECT k FROM b))) AS bin),
  f AS (SELECT least(floor(({c} - lo) * k / (hi - lo)), k - 1)::BIGINT AS bin, count(*) AS n FROM {t}, b WHERE {c} IS NOT NULL GROUP BY 1)
  SELECT g.bin, round(lo + g.bin * (hi - lo) / k, 6) AS low, round(lo + (g.bin + 1) * (hi - lo) / k, 6) AS high,
    coalesce(f.n, 0) AS n, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis FROM b, g LEFT JOIN f ON f.bin = g.bin"""


@query("a8_histogram", HISTOGRAM.format(c="o_totalprice", t="orders"))
def a8(spark, d):
    bins = pf.histogram(table(spark, d, "orders"), "o_totalprice")
    return bins.withColumns({c: F.round(c, 6) for c in ("low", "high", "skew", "kurtosis")})


@query(
    "a9_density",
    """WITH s AS (SELECT count(n_chars) AS n, min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE - min(n_chars) AS span,
      stddev_samp(n_chars) * pow(count(n_chars), -0.2) AS h FROM documents),
    c AS (SELECT n_chars::DOUBLE AS v, count(*) AS k FROM documents WHERE n_chars IS NOT NULL GROUP BY 1),
    p AS (SELECT unnest(range(0, 200)) AS point)
    SELECT point::INTEGER AS point, round(lo + span * point / 199, 6) AS x,
      round(sum(k * exp(-pow((lo + span * point / 199 - v) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 9) AS density
    FROM s, c, p GROUP BY point, lo, span""",
)
def a9(spark, d):
    curve = pf.density(documents(spark, d), "n_chars")
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


BOX = " UNION ALL ".join(
    f"""SELECT {quoted(c)} AS col, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75,
      min({c}) FILTER ({c} >= lo)::DOUBLE AS whisker_low, max({c}) FILTER ({c} <= hi)::DOUBLE AS whisker_high,
      count(*) FILTER ({c} < lo OR {c} > hi) AS n_outside
    FROM {t}, (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q25,
      quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75 FROM {t})) GROUP BY q25, median, q75"""
    for t, c in (("events", "value"), ("documents", "n_chars"))
)


@query("a10_box_summary", BOX)
def a10(spark, d):
    parts = [
        pf.box_summary(table(spark, d, t), [c]) for t, c in (("events", "value"), ("documents", "n_chars"))
    ]
    both = parts[0].unionByName(parts[1])
    return both.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75")})


@query(
    "a11_top_categories",
    f"SELECT quality, count(*) AS n FROM {JOINED} GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 20",
)
def a11(spark, d):
    return top_values(joined(spark, d), "quality", 20, include_null=True)


def _sql_pearson(name: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(a)} AS a, {quoted(b)} AS b, round(corr({a}, {b}), 6) AS r FROM {name}" for a, b in combinations(cols, 2)
    )


@query("a12_pearson", _sql_pearson("lineitem", LINE_COLS))
def a12(spark, d):
    out = co.correlations(table(spark, d, "lineitem"), LINE_COLS)
    return out.withColumn("r", F.round("r", 6))


def _sql_ranks(name: str, cols) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols
    )
    return f"(SELECT {ranks} FROM {name})"


@query("a13_spearman", _sql_pearson(_sql_ranks("lineitem", LINE_COLS), LINE_COLS))
def a13(spark, d):
    out = co.correlations(table(spark, d, "lineitem"), LINE_COLS, "spearman")
    return out.withColumn("r", F.round("r", 6))


KENDALL_COLS = ["l_quantity", "l_discount", "l_tax"]


def _sql_kendall(name: str, x: str, y: str) -> str:
    return f"""(WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS n FROM {name} GROUP BY 1, 2),
      s AS (SELECT sum(p.n * q.n * CASE WHEN p.y < q.y THEN 1 WHEN p.y > q.y THEN -1 ELSE 0 END) AS s FROM c p JOIN c q ON p.x < q.x),
      t AS (SELECT sum(n) AS n FROM c), tx AS (SELECT sum(k * (k - 1) / 2) AS k FROM (SELECT sum(n) AS k FROM c GROUP BY x)),
      ty AS (SELECT sum(k * (k - 1) / 2) AS k FROM (SELECT sum(n) AS k FROM c GROUP BY y))
      SELECT {quoted(x)} AS a, {quoted(y)} AS b, round(s / sqrt((t.n * (t.n - 1) / 2 - tx.k) * (t.n * (t.n - 1) / 2 - ty.k)), 6) AS r FROM s, t, tx, ty)"""


@query(
    "a14_kendall",
    " UNION ALL ".join(_sql_kendall("lineitem", a, b) for a, b in combinations(KENDALL_COLS, 2)),
)
def a14(spark, d):
    out = co.correlations(table(spark, d, "lineitem"), KENDALL_COLS, "kendall")
    return out.withColumn("r", F.round("r", 6))


@query("a14_kendall_all")
def a14_all(spark, d):
    """With the continuous column; its pairwise SQL is too slow, tests hold it to brute force."""
    out = co.correlations(table(spark, d, "lineitem"), [*KENDALL_COLS, "l_extendedprice"], "kendall")
    return out.withColumn("r", F.round("r", 6))


PART_COLS = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "a15_strong_pairs",
    f"SELECT a, b, round(abs(r), 6) AS r FROM ({_sql_pearson('part', PART_COLS)}) WHERE abs(r) > 0.7 LIMIT 10",
)
def a15(spark, d):
    strong = co.strong_pairs(co.pearson(table(spark, d, "part"), PART_COLS), PART_COLS)
    return strong.withColumn("r", F.round("r", 6))


@query(
    "a17_payload_bytes",
    """SELECT 'doc_id' AS "column", 8 * count(doc_id) AS bytes FROM documents
    UNION ALL SELECT 'text', sum(strlen(text))::BIGINT FROM documents UNION ALL SELECT 'lang', sum(strlen(lang))::BIGINT FROM documents
    UNION ALL SELECT 'source', sum(strlen(source))::BIGINT FROM documents
    UNION ALL SELECT 'n_chars', 8 * count(n_chars) FROM documents""",
)
def a17(spark, d):
    return pf.payload_bytes(documents(spark, d).select("doc_id", "text", "lang", "source", "n_chars"))


OUT_COLS = ["l_quantity", "l_extendedprice"]
FENCES = ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo{i}, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi{i}"
    for i, c in enumerate(["n_chars", "doc_id"])
)


@query(
    "o1_iqr_outliers",
    f"""SELECT doc_id, n_chars, n_flags FROM (SELECT doc_id, n_chars, (n_chars < lo0 OR n_chars > hi0)::INTEGER
      + (doc_id < lo1 OR doc_id > hi1)::INTEGER AS n_flags FROM documents, (SELECT {FENCES} FROM documents)) WHERE n_flags > 0""",
)
def o1(spark, d):
    return ol.iqr_outliers(documents(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"])


@query("o2_isolation_forest")
def o2(spark, d):
    out = ol.isolation_forest(table(spark, d, "events"), ["user_id", "value"], "event_id")
    return out.where("iso_label = -1")


@query(
    "o2_forest_totals",
    """SELECT count(*) AS rows, count(*) AS signed, true AS within FROM events
    WHERE user_id IS NOT NULL AND value IS NOT NULL""",
)
def o2_totals(spark, d):
    """Labels follow the score's sign; at most the share asked for is flagged."""
    label = F.when(F.col("iso_score") < 0, -1).otherwise(1)
    scored = ol.isolation_forest(table(spark, d, "events"), ["user_id", "value"], "event_id")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("iso_label") == label).alias("signed"),
        (F.count_if(F.col("iso_label") == -1) <= 0.05 * F.count(F.lit(1)) + 1).alias("within"),
    )
