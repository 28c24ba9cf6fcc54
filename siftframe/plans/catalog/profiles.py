"""Column profiles, data quality, histograms, correlations and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.expressions import rounded
from ...functions.roles import numeric_columns
from ...operators import correlation as C
from ...operators import outliers as O
from ...operators import profiling as P
from ...operators import statistics as S
from ..report import category_charts, profile_bundle
from .registry import EVENTS_WITH_GAPS, Tables, query

# Columns of events_with_gaps: name, type as Spark names it.
_EVENT_COLUMNS = [
    ("event_id", "bigint"),
    ("ts", "timestamp_ntz"),
    ("user_id", "bigint"),
    ("event_type", "string"),
    ("value", "double"),
    ("props", "string"),
]
_CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
_NULLS = " + ".join(f"COUNT(*) - COUNT({c})" for c, _ in _EVENT_COLUMNS)

# A projection with repeated rows and with gaps.
_REPEATS = f"(SELECT user_id, event_type, round(value / 50, 0) AS level FROM {EVENTS_WITH_GAPS}) AS r"


def _repeats(t: Tables):
    return t.events_with_gaps.select(
        "user_id", "event_type", F.round(F.col("value") / 50, 0).alias("level")
    )


_REPEAT_NULLS = "3 * COUNT(*) - COUNT(user_id) - COUNT(event_type) - COUNT(level)"
_REPEAT_DISTINCT = f"(SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {_REPEATS}))"


@query(
    "overview",
    f"""SELECT COUNT(*) AS row_count, 3 AS column_count,
               COUNT(*) - {_REPEAT_DISTINCT} AS duplicate_rows,
               {_REPEAT_NULLS} AS total_missing_cells,
               round(100.0 * ({_REPEAT_NULLS}) / (3 * COUNT(*)), 3) AS missing_cell_pct,
               2 AS numeric_column_count, 1 AS categorical_column_count,
               0 AS datetime_column_count
        FROM {_REPEATS}""",
)
def _(t):
    return P.overview(_repeats(t))


@query(
    "overview_documents",
    """SELECT COUNT(*) AS row_count, 3 AS column_count,
              COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang, source FROM documents))
                AS duplicate_rows,
              CAST(0 AS BIGINT) AS total_missing_cells, CAST(0 AS DOUBLE) AS missing_cell_pct,
              0 AS numeric_column_count, 3 AS categorical_column_count, 0 AS datetime_column_count
       FROM documents""",
)
def _(t):
    """Whole long texts decide what a duplicate is."""
    return P.overview(t.documents.select("text", "lang", "source"))


@query(
    "duplicate_rows",
    f"SELECT COUNT(*) - {_REPEAT_DISTINCT} AS duplicate_rows FROM {_REPEATS}",
)
def _(t):
    return P.duplicate_rows(_repeats(t))


@query(
    "missing_cells",
    f"""SELECT CAST({_NULLS} AS BIGINT) AS total_missing_cells,
               round(100.0 * ({_NULLS}) / (6 * COUNT(*)), 3) AS missing_cell_pct
        FROM {EVENTS_WITH_GAPS}""",
)
def _(t):
    return P.missing_cells(t.events_with_gaps)


@query(
    "missing_chart",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count,
              round(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 3) AS missing_pct
            FROM {EVENTS_WITH_GAPS} HAVING COUNT(*) > COUNT({c})"""
        for c, _ in _EVENT_COLUMNS
    ),
)
def _(t):
    return P.missing_chart(t.events_with_gaps)


def _quality_sql(columns, table: str) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS data_type,
              COUNT(*) AS total_rows, COUNT(*) - COUNT({c}) AS null_count,
              COUNT(DISTINCT {c}) AS distinct_count FROM {table}"""
        for i, (c, kind) in enumerate(columns)
    )
    return f"""
  WITH c AS ({rows})
  SELECT CAST(position AS INTEGER) AS position, column_name, data_type, total_rows, null_count,
         round(null_count * 100.0 / total_rows, 1) AS missing_pct, distinct_count,
         round(distinct_count * 100.0 / total_rows, 1) AS distinct_pct,
         round((total_rows - null_count) * 100.0 / total_rows, 1) AS completeness_pct,
         CASE WHEN null_count = total_rows THEN 'Critical'
              WHEN null_count * 100.0 / total_rows >= 20 THEN 'Needs attention'
              WHEN null_count > 0 THEN 'Review' ELSE 'Good' END AS quality_status
  FROM c"""


_QUALITY = _quality_sql(_EVENT_COLUMNS, EVENTS_WITH_GAPS)


@query("data_quality", _QUALITY)
def _(t):
    return P.data_quality(t.events_with_gaps)


@query(
    "data_quality_documents",
    _quality_sql(
        [
            ("doc_id", "bigint"),
            ("text", "string"),
            ("lang", "string"),
            ("source", "string"),
            ("n_chars", "bigint"),
        ],
        "documents",
    ),
)
def _(t):
    return P.data_quality(t.documents)


@query("dq_missing_only", f"SELECT * FROM ({_QUALITY}) AS q WHERE null_count > 0")
def _(t):
    return P.dq_missing_only(P.data_quality(t.events_with_gaps))


@query(
    "dq_most_distinct",
    f"SELECT * FROM ({_QUALITY}) AS q ORDER BY distinct_count DESC, position LIMIT 5",
)
def _(t):
    return P.dq_most_distinct(P.data_quality(t.events_with_gaps))


@query("dq_attention", f"SELECT * FROM ({_QUALITY}) AS q WHERE quality_status <> 'Good'")
def _(t):
    return P.dq_attention(P.data_quality(t.events_with_gaps))


@query(
    "dq_totals",
    f"""SELECT COUNT(*) AS total_rows, 3 AS total_columns,
               {_REPEAT_NULLS} AS total_nulls, COUNT(*) - {_REPEAT_DISTINCT} AS duplicate_rows,
               round((3 * COUNT(*) - ({_REPEAT_NULLS})) * 100.0 / (3 * COUNT(*)), 1)
                 AS overall_completeness_pct
        FROM {_REPEATS}""",
)
def _(t):
    return P.dq_totals(_repeats(t))


def _profile_sql(columns, table: str) -> str:
    rows = []
    for i, (c, kind) in enumerate(columns):
        numeric = kind in ("bigint", "int", "double")
        stats = (
            f"""CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
              round(AVG({c}), 4) AS mean, round(CAST(MEDIAN({c}) AS DOUBLE), 4) AS median,
              round(STDDEV_SAMP({c}), 4) AS std, round(QUANTILE_CONT({c}, 0.25), 4) AS q25,
              round(QUANTILE_CONT({c}, 0.75), 4) AS q75"""
            if numeric
            else "NULL AS min, NULL AS max, NULL AS mean, NULL AS median, NULL AS std, "
            "NULL AS q25, NULL AS q75"
        )
        rows.append(
            f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{kind}' AS dtype,
              '{"numeric" if numeric else "categorical"}' AS type,
              COUNT(*) - COUNT({c}) AS missing_count,
              round(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 3) AS missing_pct,
              COUNT(DISTINCT {c}) AS distinct_count, {stats} FROM {table}"""
        )
    return " UNION ALL ".join(rows)


@query("column_profiles", _profile_sql(_EVENT_COLUMNS, EVENTS_WITH_GAPS))
def _(t):
    return rounded(P.column_profiles(t.events_with_gaps))


@query("column_profiles_counting", _profile_sql(_CUSTOMER_COLUMNS, "customer"))
def _(t):
    """The passes used for large inputs, whatever the size of this one."""
    return rounded(P.column_profiles(t.customer, method="counting"))


@query(
    "column_minmax",
    " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name,
              CAST(MIN({c}) AS VARCHAR) AS minimum, CAST(MAX({c}) AS VARCHAR) AS maximum
            FROM {EVENTS_WITH_GAPS}"""
        for i, (c, _) in enumerate(_EVENT_COLUMNS)
    ),
)
def _(t):
    return P.column_minmax(t.events_with_gaps)


@query(
    "categorical_columns_for_charts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count
            FROM {EVENTS_WITH_GAPS} HAVING COUNT(DISTINCT {c}) BETWEEN 2 AND 50"""
        for c in ("ts", "event_type", "props")
    ),
)
def _(t):
    return P.categorical_columns_for_charts(t.events_with_gaps)


@query(
    "category_charts",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS count FROM part
              WHERE (SELECT COUNT(DISTINCT {c}) FROM part) BETWEEN 2 AND 50
              GROUP BY {c} ORDER BY count DESC, value LIMIT 15)"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(t):
    return category_charts(t.part)


@query(
    "profile_bundle",
    """SELECT 'overview' AS part, CAST(1 AS BIGINT) AS rows
       UNION ALL SELECT 'columns', 6
       UNION ALL SELECT 'missing', 0
       UNION ALL SELECT 'sample', LEAST(20, (SELECT COUNT(*) FROM part))
       UNION ALL SELECT 'histograms', 60
       UNION ALL SELECT 'categories', """
    + " + ".join(
        f"""(SELECT CASE WHEN COUNT(DISTINCT {c}) BETWEEN 2 AND 50
               THEN LEAST(15, COUNT(DISTINCT {c})) ELSE 0 END FROM part)"""
        for c in ("p_name", "p_brand", "p_type")
    )
    + " UNION ALL SELECT 'correlation', 9",
)
def _(t):
    out = None
    for name, part in profile_bundle(t.part, ["p_partkey"]).items():
        row = part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


_PART_NUMBERS = ("p_partkey", "p_size", "p_retailprice")


@query(
    "profile_bundle_contents",
    """SELECT 'overview' AS part, 'row_count' AS item, CAST(COUNT(*) AS DOUBLE) AS value FROM part
       UNION ALL SELECT 'overview', 'duplicate_rows',
         (SELECT COUNT(*) FROM part) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM part))
       UNION ALL SELECT 'sample', CAST(p_partkey AS VARCHAR), p_retailprice
         FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20)"""
    + "".join(
        f""" UNION ALL SELECT 'columns', '{c}', COUNT(DISTINCT {c}) FROM part"""
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    )
    + "".join(
        f""" UNION ALL SELECT 'categories', concat('{c}=', v), n FROM (
              SELECT {c} AS v, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS place
              FROM part GROUP BY 1)
            WHERE place <= 15 AND (SELECT COUNT(DISTINCT {c}) FROM part) BETWEEN 2 AND 50"""
        for c in ("p_name", "p_brand", "p_type")
    )
    + "".join(
        f" UNION ALL SELECT 'histograms', '{c}', COUNT({c}) FROM part" for c in _PART_NUMBERS
    )
    + "".join(
        f""" UNION ALL SELECT 'correlation', '{a},{b}', COALESCE(round(corr({a}, {b}), 4), 0) FROM part"""
        for a in _PART_NUMBERS
        for b in _PART_NUMBERS
    ),
)
def _(t):
    """The contents of the parts in long form."""
    parts = profile_bundle(t.part, ["p_partkey"])
    number = {c: F.col(c).cast("double") for c in ("row_count", "duplicate_rows")}

    def rows(name, item, value, df=None):
        df = parts[name] if df is None else df
        return df.select(F.lit(name).alias("part"), item.alias("item"), value.cast("double").alias("value"))

    bins = parts["histograms"].groupBy("column_name").agg(F.sum("count").alias("n"))
    out = rows("overview", F.lit("row_count"), number["row_count"])
    for more in (
        rows("overview", F.lit("duplicate_rows"), number["duplicate_rows"]),
        rows("sample", F.col("p_partkey").cast("string"), F.col("p_retailprice")),
        rows("columns", F.col("column_name"), F.col("distinct_count")),
        rows("categories", F.concat_ws("=", "column_name", "value"), F.col("count")),
        rows("histograms", F.col("column_name"), F.col("n"), bins),
        rows("correlation", F.concat_ws(",", "row", "column"), F.col("correlation")),
    ):
        out = out.unionByName(more)
    return out


_MERGED = ("event_id", "user_id", "value")


@query(
    "merged_statistics",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, COUNT({c}) AS n,
              CAST(MIN({c}) AS DOUBLE) AS minimum, CAST(MAX({c}) AS DOUBLE) AS maximum, round(AVG({c}), 4) AS mean,
              round(stddev_samp({c}), 4) AS stddev, round(corr({c}, value), 6) AS with_value
            FROM {EVENTS_WITH_GAPS}"""
        for c in _MERGED
    ),
)
def _(t):
    """Statistics of three parts of the events, put together."""
    events = t.events_with_gaps
    part = F.pmod(F.col("event_id"), F.lit(3))
    stats = S.merge_statistics(*[S.column_statistics(events.where(part == k)) for k in range(3)])
    stats = S.merge_statistics(stats)
    r = S.correlations_of(stats, list(_MERGED)).where(F.col("j") == 2)
    names = F.array(*[F.lit(c) for c in _MERGED])
    r = r.select(F.get(names, F.col("i")).alias("column_name"), F.round("r", 6).alias("with_value"))
    plain = stats.where(F.col("column_name").isin(*_MERGED)).select(
        "column_name", "rows", "nulls", "n", "minimum", "maximum", F.round("mean", 4).alias("mean"),
        F.round(F.sqrt(F.col("m2") / (F.col("n") - 1)), 4).alias("stddev"),
    )
    return plain.join(F.broadcast(r), "column_name")


# -- histograms --------------------------------------------------------------


def _histogram_sql(column: str, table: str, bins: str = "20") -> str:
    return f"""
  SELECT '{column}' AS column_name, CAST(g.b AS INTEGER) AS bin,
         round(lo + g.b * w, 6) AS lower, round(CASE WHEN lo = hi THEN hi ELSE lo + (g.b + 1) * w END, 6) AS upper,
         COALESCE(n, 0) AS count
  FROM (SELECT *, (hi - lo) / bins AS w FROM
         (SELECT lo, hi, CASE WHEN lo = hi THEN 1 ELSE bins END AS bins FROM
           (SELECT CAST(MIN({column}) AS DOUBLE) AS lo, CAST(MAX({column}) AS DOUBLE) AS hi,
                   {bins} AS bins FROM {table}))) AS s
  JOIN generate_series(0, 63) AS g(b) ON g.b < s.bins
  LEFT JOIN (
    SELECT b, COUNT(*) AS n FROM (
      SELECT CASE WHEN lo = hi THEN 0 ELSE
               LEAST(CAST(FLOOR(({column} - lo) / ((hi - lo) / bins)) AS INTEGER), bins - 1) END AS b
      FROM {table}, (SELECT CAST(MIN({column}) AS DOUBLE) AS lo, CAST(MAX({column}) AS DOUBLE) AS hi,
                            {bins} AS bins FROM {table}) AS r
      WHERE {column} IS NOT NULL) GROUP BY b) AS c ON c.b = g.b"""


@query("histogram", _histogram_sql("l_extendedprice", "lineitem"))
def _(t):
    return P.histogram(t.lineitem, "l_extendedprice")


@query(
    "histogram_all_columns",
    " UNION ALL ".join(
        _histogram_sql(c, EVENTS_WITH_GAPS) for c in ("event_id", "user_id", "value")
    ),
)
def _(t):
    return P.histograms(t.events_with_gaps)


_SQRT = "LEAST(12, GREATEST(5, CAST({f}(sqrt(COUNT({c}))) AS INTEGER)))"


@query(
    "histogram_sqrt_bins",
    " UNION ALL ".join(
        f"""SELECT h.*, (SELECT MEDIAN({c}) FROM part) AS median FROM (
              {_histogram_sql(c, "part", _SQRT.format(f="floor", c=c))}) AS h"""
        for c in ("p_size", "p_retailprice")
    ),
)
def _(t):
    return P.histogram_sqrt_bins(t.part, ["p_size", "p_retailprice"])


# -- correlations ------------------------------------------------------------

_CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLUMNS) for b in _CORR_COLUMNS[i + 1 :]]
_STRENGTH = """CASE WHEN correlation IS NULL THEN 'unavailable'
  WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.4 THEN 'moderate'
  ELSE 'weak' END"""


@query(
    "corr_pair", f"SELECT round({_corr('l_quantity', 'l_extendedprice')}, 6) AS correlation FROM lineitem"
)
def _(t):
    return rounded(C.corr_pair(t.lineitem, "l_quantity", "l_extendedprice"), 6)


@query(
    "corr_pairs",
    f"""SELECT column_x, column_y, round(correlation, 6) AS correlation, {_STRENGTH} AS strength
        FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, {_corr(a, b)} AS correlation FROM lineitem"
        for a, b in _PAIRS
    )
    + ") AS p",
)
def _(t):
    return rounded(C.corr_pairs(t.lineitem, _CORR_COLUMNS), 6)


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "row", '{b}' AS "column",
              COALESCE(round({_corr(a, b)}, 4), 0) AS correlation FROM {EVENTS_WITH_GAPS}"""
        for a in ("event_id", "user_id", "value")
        for b in ("event_id", "user_id", "value")
    ),
)
def _(t):
    return C.corr_matrix(t.events_with_gaps)


@query(
    "corr_ranked",
    "SELECT column_x, column_y, round(correlation, 6) AS correlation FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, {_corr(a, b)} AS correlation FROM lineitem"
        for a, b in _PAIRS
    )
    + ") AS p WHERE correlation IS NOT NULL",
)
def _(t):
    return rounded(C.corr_ranked(t.lineitem, _CORR_COLUMNS), 6)


_WORDS = {
    "story": """CASE WHEN r >= 0.9 THEN 'very strong' WHEN r >= 0.7 THEN 'strong'
        WHEN r >= 0.5 THEN 'moderate' WHEN r >= 0.3 THEN 'weak' ELSE 'very weak' END""",
    "heatmap": """CASE WHEN r >= 0.8 THEN 'Very strong' WHEN r >= 0.6 THEN 'Strong'
        WHEN r >= 0.4 THEN 'Moderate' WHEN r >= 0.2 THEN 'Weak' ELSE 'Very weak' END""",
}


@query(
    "corr_strength",
    f"""SELECT column_x, column_y, {_WORDS['story']} AS story, {_WORDS['heatmap']} AS heatmap,
               CASE WHEN c > 0 THEN 'positive' WHEN c < 0 THEN 'negative' ELSE 'no' END AS direction
        FROM (SELECT *, abs(c) AS r FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, corr({a}, {b}) AS c FROM lineitem"
        for a, b in _PAIRS
    )
    + "))",
)
def _(t):
    r = F.col("correlation")
    return C.corr_pairs(t.lineitem, _CORR_COLUMNS).select(
        "column_x",
        "column_y",
        C.corr_strength(r, "story").alias("story"),
        C.corr_strength(r, "heatmap").alias("heatmap"),
        C.corr_direction(r).alias("direction"),
    )


@query(
    "linear_fit",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
              round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""",
)
def _(t):
    return rounded(C.linear_fit(t.lineitem, "l_quantity", "l_extendedprice"), 3)


# -- outliers ----------------------------------------------------------------


def _outlier_sql(column: str, table: str) -> str:
    return f"""
  WITH s AS (SELECT QUANTILE_CONT({column}, 0.25) AS q1, QUANTILE_CONT({column}, 0.75) AS q3
             FROM {table})
  SELECT b.*, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM {table.replace(' AS events_with_gaps', '')} AS b, s
  WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)"""


def _rounded_quartiles(df):
    return df.withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)})


@query("iqr_outliers", _outlier_sql("value", EVENTS_WITH_GAPS))
def _(t):
    return _rounded_quartiles(O.iqr_outliers(t.events_with_gaps, "value"))


@query("iqr_outliers_counting", _outlier_sql("value", "events"))
def _(t):
    """The passes used for large inputs, whatever the size of this one."""
    return _rounded_quartiles(O.iqr_outliers(t.events, "value", method="counting"))


@query(
    "zscore",
    """SELECT p_partkey, p_size,
              round((p_size - (SELECT AVG(p_size) FROM part))
                / (SELECT STDDEV_POP(p_size) FROM part), 4) AS z_score FROM part""",
)
def _(t):
    return rounded(O.zscore(t.part.select("p_partkey", "p_size"), "p_size"))


def _box_sql(column: str, table: str) -> str:
    return f"""
  SELECT '{column}' AS column_name, round((q1 - m) / s, 4) AS q1, round((q2 - m) / s, 4) AS median,
         round((q3 - m) / s, 4) AS q3,
         round((LEAST(q1, (SELECT MIN({column}) FROM {table} WHERE {column} >= q1 - 1.5 * (q3 - q1))) - m) / s, 4) AS whisker_low,
         round((GREATEST(q3, (SELECT MAX({column}) FROM {table} WHERE {column} <= q3 + 1.5 * (q3 - q1))) - m) / s, 4) AS whisker_high,
         (SELECT COUNT(*) FROM {table} WHERE {column} < q1 - 1.5 * (q3 - q1)
            OR {column} > q3 + 1.5 * (q3 - q1)) AS fliers
  FROM (SELECT AVG({column}) AS m, STDDEV_POP({column}) AS s, QUANTILE_CONT({column}, 0.25) AS q1,
               MEDIAN({column}) AS q2, QUANTILE_CONT({column}, 0.75) AS q3 FROM {table}) AS x"""


@query(
    "boxplot_stats",
    " UNION ALL ".join(_box_sql(c, EVENTS_WITH_GAPS) for c in ("event_id", "user_id", "value")),
)
def _(t):
    return rounded(O.boxplot_stats(t.events_with_gaps, numeric_columns(t.events_with_gaps)))
