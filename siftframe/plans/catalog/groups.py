"""Groups, rankings, shares, filters and calendar trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.expressions import rounded
from ...operators import grouping as G
from ...operators import selection as S
from ...operators import timeseries as T
from .registry import EVENTS_WITH_GAPS, LINES_WITH_GAPS, query


def _grouped_sql(agg: str, order: str, limit: str = "", table: str = LINES_WITH_GAPS) -> str:
    return f"""
  SELECT l_returnflag, round({agg}, 4) AS value FROM {table}
  WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
  ORDER BY {agg} {order} NULLS LAST, l_returnflag {limit}"""


@query("group_agg", _grouped_sql("AVG(l_discount)", "DESC"))
def _(t):
    return rounded(G.group_agg(t.lines_with_gaps, "l_returnflag", "l_discount", "AVG"))


@query("group_agg_median", _grouped_sql("MEDIAN(l_extendedprice)", "DESC"))
def _(t):
    return rounded(G.group_agg(t.lines_with_gaps, "l_returnflag", "l_extendedprice", "MEDIAN"))


@query("group_agg_median_counting", _grouped_sql("MEDIAN(l_discount)", "DESC"))
def _(t):
    """The passes used for large inputs, whatever the size of this one."""
    return rounded(
        G.group_agg(
            t.lines_with_gaps, "l_returnflag", "l_discount", "MEDIAN", method="counting"
        )
    )


@query(
    "group_agg_default",
    """SELECT l_linestatus, round(SUM(l_extendedprice), 2) AS value FROM lineitem
       GROUP BY l_linestatus""",
)
def _(t):
    sales = t.lineitem.withColumnRenamed("l_extendedprice", "revenue")
    return rounded(G.group_agg(sales, "l_linestatus", "revenue"), 2)


@query(
    "group_agg_default_avg",
    """SELECT c_mktsegment, round(AVG(c_acctbal), 4) AS value FROM customer
       GROUP BY c_mktsegment""",
)
def _(t):
    return rounded(G.group_agg(t.customer, "c_mktsegment", "c_acctbal"))


_COUNTS = """
  SELECT l_returnflag, COUNT(*) AS count FROM {t} WHERE l_returnflag IS NOT NULL
  GROUP BY l_returnflag ORDER BY count {order}, l_returnflag {limit}"""


@query("group_count", _COUNTS.format(t=LINES_WITH_GAPS, order="DESC", limit=""))
def _(t):
    return G.group_count(t.lines_with_gaps, "l_returnflag")


@query(
    "group_distribution",
    "SELECT event_type, COUNT(*) AS count FROM events GROUP BY event_type",
)
def _(t):
    return G.group_distribution(t.events, "event_type")


@query("group_most_records", _COUNTS.format(t=LINES_WITH_GAPS, order="DESC", limit="LIMIT 1"))
def _(t):
    return G.group_most_records(t.lines_with_gaps, "l_returnflag")


@query("group_fewest_records", _COUNTS.format(t=LINES_WITH_GAPS, order="ASC", limit="LIMIT 1"))
def _(t):
    return G.group_fewest_records(t.lines_with_gaps, "l_returnflag")


_RANKED = """
  SELECT l_suppkey, round({agg}, 2) AS value FROM lineitem GROUP BY l_suppkey
  ORDER BY {agg} {order} NULLS LAST, l_suppkey {limit}"""


@query("top_n_groups", _RANKED.format(agg="SUM(l_extendedprice)", order="DESC", limit="LIMIT 10"))
def _(t):
    return rounded(G.top_n_groups(t.lineitem, "l_suppkey", "l_extendedprice", "SUM", 10), 2)


@query("bottom_n_groups", _RANKED.format(agg="AVG(l_quantity)", order="ASC", limit="LIMIT 5"))
def _(t):
    return rounded(G.bottom_n_groups(t.lineitem, "l_suppkey", "l_quantity", "AVG", 5), 2)


@query("group_sorted", _RANKED.format(agg="MAX(l_extendedprice)", order="ASC", limit=""))
def _(t):
    return rounded(
        G.group_sorted(t.lineitem, "l_suppkey", "l_extendedprice", "MAX", ascending=True), 2
    )


@query("top_contributor", _RANKED.format(agg="SUM(l_quantity)", order="DESC", limit="LIMIT 1"))
def _(t):
    return rounded(G.top_contributor(t.lineitem, "l_suppkey", "l_quantity"), 2)


@query(
    "top_categories",
    """SELECT p_type AS value, COUNT(*) AS count FROM part WHERE p_type IS NOT NULL
       GROUP BY p_type ORDER BY count DESC, value LIMIT 15""",
)
def _(t):
    return G.top_categories(t.part, "p_type")


@query(
    "category_counts_with_null",
    f"""WITH s AS (SELECT COALESCE(CAST(l_returnflag AS VARCHAR), '(null)') AS value,
                          COUNT(*) AS count
                   FROM {LINES_WITH_GAPS} GROUP BY 1 ORDER BY count DESC, value LIMIT 8)
        SELECT value, count, round(count * 100.0 / SUM(count) OVER (), 4) AS percentage FROM s""",
)
def _(t):
    return rounded(G.category_counts_with_null(t.lines_with_gaps, "l_returnflag"))


@query(
    "pie_top8",
    """WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, SUM(l_quantity) AS value
                  FROM lineitem GROUP BY l_suppkey),
            s AS (SELECT * FROM g WHERE value > 0 ORDER BY value DESC, label LIMIT 8)
       SELECT label, round(value, 4) AS value,
              round(value * 100.0 / SUM(value) OVER (), 4) AS percentage FROM s""",
)
def _(t):
    grouped = G.group_agg(t.lineitem, "l_suppkey", "l_quantity", "SUM")
    return rounded(G.pie_slices(grouped, "l_suppkey", "value"))


@query(
    "record_share",
    f"""SELECT l_returnflag, COUNT(*) AS count,
               round(COUNT(*) * 100.0 / NULLIF((SELECT COUNT(*) FROM {LINES_WITH_GAPS}
                 WHERE l_returnflag IS NOT NULL), 0), 4) AS percentage
        FROM {LINES_WITH_GAPS} WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""",
)
def _(t):
    return rounded(G.record_share(t.lines_with_gaps, "l_returnflag"))


@query(
    "metric_share",
    f"""WITH g AS (SELECT l_returnflag, SUM(l_extendedprice) AS value FROM {LINES_WITH_GAPS}
                   WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag),
             s AS (SELECT SUM(value) AS total FROM g)
        SELECT l_returnflag, round(value, 2) AS value,
               round(CASE WHEN total = 0 THEN 0 ELSE value * 100.0 / total END, 2) AS percentage
        FROM g, s""",
)
def _(t):
    return rounded(G.metric_share(t.lines_with_gaps, "l_returnflag", "l_extendedprice"), 2)


_BY_SUPPLIER = "SELECT l_suppkey AS label, SUM(l_extendedprice) AS value FROM lineitem GROUP BY 1"


@query(
    "explain_groups",
    f"""WITH g AS ({_BY_SUPPLIER}),
             r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS up,
                          row_number() OVER (ORDER BY value, label DESC) AS down FROM g)
        SELECT MAX(label) FILTER (up = 1) AS top_label,
               round(MAX(value) FILTER (up = 1), 2) AS top_value,
               MAX(label) FILTER (down = 1) AS lowest_label,
               round(MAX(value) FILTER (down = 1), 2) AS lowest_value,
               round(MAX(value) * 100.0 / SUM(value), 2) AS top_share_pct FROM r""",
)
def _(t):
    grouped = G.group_agg(t.lineitem, "l_suppkey", "l_extendedprice", "SUM", ordered=False)
    return rounded(G.explain_groups(grouped, "l_suppkey"), 2)


@query(
    "group_spread",
    f"""WITH g AS ({_BY_SUPPLIER}),
             r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS up,
                          row_number() OVER (ORDER BY value, label DESC) AS down FROM g)
        SELECT COUNT(*) AS groups, MAX(label) FILTER (up = 1) AS highest_label,
               round(MAX(value), 2) AS highest_value,
               MAX(label) FILTER (down = 1) AS lowest_label,
               round(MIN(value), 2) AS lowest_value, round(MAX(value) - MIN(value), 2) AS spread,
               round((MAX(value) - MIN(value)) * 100.0 / NULLIF(abs(MIN(value)), 0), 2)
                 AS spread_pct_of_lowest,
               round(MAX(value) * 100.0 / SUM(value), 2) AS highest_share_pct FROM r""",
)
def _(t):
    grouped = G.group_agg(t.lineitem, "l_suppkey", "l_extendedprice", "SUM", ordered=False)
    return rounded(G.group_spread(grouped, "l_suppkey"), 2)


# -- filters, samples --------------------------------------------------------

_CONDITIONS = [("l_quantity", ">=", 45), ("l_discount", "<", 0.05), ("l_tax", "!=", 0)]
_WHERE = "WHERE l_quantity >= 45 AND l_discount < 0.05 AND l_tax <> 0"
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("filter_rows", f"SELECT * FROM lineitem {_WHERE}")
def _(t):
    return S.filter_rows(t.lineitem, _CONDITIONS)


@query(
    "filter_page",
    f"SELECT * FROM lineitem {_WHERE} ORDER BY {', '.join(_LINE_ORDER)} LIMIT 100",
)
def _(t):
    return S.filter_page(t.lineitem, _CONDITIONS, _LINE_ORDER)


@query("filter_count", f"SELECT COUNT(*) AS count FROM lineitem {_WHERE}")
def _(t):
    return S.filter_count(t.lineitem, _CONDITIONS)


@query(
    "filter_between",
    "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000.5",
)
def _(t):
    return S.filter_between(t.orders, "o_totalprice", 100000, 120000.5)


@query("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def _(t):
    return S.sample_rows(t.orders, order_by=["o_orderkey"])


@query(
    "preview_rows",
    """SELECT CASE WHEN length(CAST(p_partkey AS VARCHAR)) > 16
                   THEN concat(substr(CAST(p_partkey AS VARCHAR), 1, 15), '...')
                   ELSE CAST(p_partkey AS VARCHAR) END AS p_partkey,
              CASE WHEN length(p_name) > 16 THEN concat(substr(p_name, 1, 15), '...')
                   ELSE p_name END AS p_name,
              CASE WHEN length(p_type) > 16 THEN concat(substr(p_type, 1, 15), '...')
                   ELSE p_type END AS p_type
       FROM part ORDER BY part.p_partkey LIMIT 12""",
)
def _(t):
    return S.preview_rows(t.part.select("p_partkey", "p_name", "p_type"), ["p_partkey"])


@query(
    "preview_rows_with_gaps",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d') AS ts,
               COALESCE(event_type, '-') AS event_type,
               COALESCE(CAST(value AS VARCHAR), '-') AS value
        FROM (SELECT * FROM {EVENTS_WITH_GAPS} ORDER BY event_id DESC LIMIT 12)""",
)
def _(t):
    rows = t.events_with_gaps.select("event_id", "ts", "event_type", "value")
    return S.preview_rows(rows, [F.desc("event_id")])


def _by_hash(column: str, table: str, key: str, limit: int) -> str:
    return f"""SELECT {column} FROM (
        SELECT {column}, row_number() OVER (ORDER BY md5(concat('0:', CAST({key} AS VARCHAR)))) AS k FROM {table})
      WHERE k <= {limit}"""


@query(
    "numeric_samples_by_hash",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM ("
        + _by_hash(c, f"(SELECT * FROM {EVENTS_WITH_GAPS} WHERE {c} IS NOT NULL)", "event_id", 700)
        + ")"
        for c in ("event_id", "user_id", "value")
    ),
)
def _(t):
    """A sample of every numeric column, from the same two scans."""
    return S.keyed_samples(t.events_with_gaps, None, "event_id", 700)


@query("pair_sample_by_hash", _by_hash("p_size AS x, p_retailprice AS y", "part", "p_partkey", 1000).replace(
    "SELECT p_size AS x, p_retailprice AS y FROM (", "SELECT CAST(x AS DOUBLE) AS x, y FROM (", 1))
def _(t):
    return S.pair_sample(t.part, "p_size", "p_retailprice", key="p_partkey")


_FREQUENT = """SELECT {c} AS value, COUNT(*) AS count FROM {t} WHERE {c} IS NOT NULL
  GROUP BY 1 ORDER BY count DESC, value LIMIT {n}"""


@query("top_categories_skewed", _FREQUENT.format(c="v", t="""(
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' WHEN l_orderkey % 5 = 0 THEN concat('warm', l_linenumber)
              ELSE concat('cold', l_orderkey) END AS v FROM lineitem)""", n=6))  # fmt: skip
def _(t):
    """Few frequent values among very many rare ones: only the frequent ones are counted."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber").cast("string")
    v = F.when(key % 3 == 0, F.lit("hot")).when(key % 5 == 0, F.concat(F.lit("warm"), number))
    rows = t.lineitem.select(v.otherwise(F.concat(F.lit("cold"), key.cast("string"))).alias("v"))
    return G.top_categories(rows, "v", 6)


@query("top_categories_flat", _FREQUENT.format(c="c_name", t="customer", n=15))
def _(t):
    """Unique values: all tie, and all are counted."""
    return G.top_categories(t.customer, "c_name")


@query(
    "numeric_sample",
    "SELECT value FROM events WHERE value IS NOT NULL ORDER BY event_id LIMIT 5000",
)
def _(t):
    return S.numeric_sample(t.events, "value", ["event_id"])


@query(
    "pair_sample",
    f"""SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
        ORDER BY {', '.join(_LINE_ORDER)} LIMIT 1000""",
)
def _(t):
    return S.pair_sample(t.lineitem, "l_quantity", "l_extendedprice", _LINE_ORDER)


_POINT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_POINT_PAIRS = [
    (a, b) for i, a in enumerate(_POINT_COLUMNS) for b in _POINT_COLUMNS[i + 1 :]
]


@query(
    "top_correlated_points",
    "WITH r AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_x, '{b}' AS column_y, abs(corr({a}, {b})) AS r FROM lineitem"
        for a, b in _POINT_PAIRS
    )
    + "), best AS (SELECT column_x, column_y FROM r ORDER BY r DESC LIMIT 3), points AS ("
    + " UNION ALL ".join(
        f"""(SELECT '{a}' AS column_x, '{b}' AS column_y, {a} AS x, {b} AS y FROM lineitem
             ORDER BY {', '.join(_LINE_ORDER)} LIMIT 1000)"""
        for a, b in _POINT_PAIRS
    )
    + ") SELECT column_x, column_y, x, y FROM points JOIN best USING (column_x, column_y)",
)
def _(t):
    return S.top_correlated_points(t.lineitem, _POINT_COLUMNS, _LINE_ORDER)


@query(
    "readonly_sql",
    """WITH ranked AS (
         SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                row_number() OVER (PARTITION BY l_returnflag
                  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place
         FROM lineitem)
       SELECT l_returnflag, COUNT(*) AS lines, MIN(l_shipdate) AS first_ship FROM ranked
       WHERE place > 1 GROUP BY l_returnflag""",
)
def _(t):
    return S.readonly_sql(
        t.lineitem,
        """```sql
        WITH ranked AS (  -- never a drop, only a ranking
          SELECT l_returnflag, l_shipdate,
                 row_number() OVER (PARTITION BY l_returnflag
                   ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place
          FROM main_table)
        SELECT l_returnflag, COUNT(*) AS lines, MIN(l_shipdate) AS first_ship FROM ranked
        WHERE place > 1 GROUP BY l_returnflag;
        ```""",
    )


# -- time --------------------------------------------------------------------

_TREND = """
  SELECT CAST(date_trunc('{grain}', CAST(o_orderdate AS DATE)) AS DATE) AS period,
         round({agg}(o_totalprice), 2) AS value
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1"""

for _grain in T.GRAINS:
    query(f"trend_{_grain}", _TREND.format(grain=_grain, agg="SUM"))(
        lambda t, grain=_grain: rounded(T.trend(t.orders, "o_orderdate", "o_totalprice", grain), 2)
    )


@query("trend_month_avg", _TREND.format(grain="month", agg="AVG"))
def _(t):
    return rounded(T.trend(t.orders, "o_orderdate", "o_totalprice", "month", "AVG"), 2)


@query(
    "daily_series",
    """SELECT CAST(ts AS DATE) AS day, round(SUM(value), 4) AS value FROM events
       WHERE ts IS NOT NULL GROUP BY 1""",
)
def _(t):
    return rounded(T.daily_series(t.events, "ts", "value"))


@query(
    "daily_series_count",
    "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1",
)
def _(t):
    return T.daily_series(t.events, "ts")


_DAILY = """d AS (SELECT CAST(ts AS DATE) AS day, COALESCE(SUM(value), 0) AS a,
                   CAST(SUM(user_id) AS DOUBLE) AS b, CAST(SUM(1) AS DOUBLE) AS c,
                   CAST(SUM(event_id) AS DOUBLE) AS e
                  FROM events WHERE ts IS NOT NULL GROUP BY 1)"""


@query(
    "normalized_series",
    f"WITH {_DAILY} "
    + " UNION ALL ".join(
        f"""SELECT day, '{name}' AS metric, round({c}, 4) AS value,
              round(COALESCE(({c} - (SELECT MIN({c}) FROM d))
                / NULLIF((SELECT MAX({c}) - MIN({c}) FROM d), 0), 0), 4) AS normalized FROM d"""
        for name, c in (("value", "a"), ("user_id", "b"), ("one", "c"), ("event_id", "e"))
    ),
)
def _(t):
    return rounded(
        T.normalized_series(
            t.events.withColumn("one", F.lit(1)), "ts", ["value", "user_id", "one", "event_id"]
        )
    )


@query(
    "series_peak_low",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS v FROM events GROUP BY 1),
            r AS (SELECT *, row_number() OVER (ORDER BY v DESC, day) AS up,
                         row_number() OVER (ORDER BY v, day) AS down FROM d)
       SELECT MAX(day) FILTER (up = 1) AS peak_period,
              CAST(MAX(v) FILTER (up = 1) AS DOUBLE) AS peak_value,
              MAX(day) FILTER (down = 1) AS low_period,
              CAST(MAX(v) FILTER (down = 1) AS DOUBLE) AS low_value FROM r""",
)
def _(t):
    return T.series_peak_low(T.daily_series(t.events, "ts", ordered=False))


@query(
    "trend_change",
    """WITH m AS (SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS p,
                         SUM(o_totalprice) AS v FROM orders GROUP BY 1),
            e AS (SELECT arg_min(v, p) AS f, arg_max(v, p) AS l FROM m)
       SELECT round(f, 2) AS first_value, round(l, 2) AS last_value,
              round((l - f) / NULLIF(abs(f), 0) * 100, 2) AS change_pct,
              CASE WHEN (l - f) / NULLIF(abs(f), 0) * 100 > 1 THEN 'increased'
                   WHEN (l - f) / NULLIF(abs(f), 0) * 100 < -1 THEN 'decreased'
                   WHEN f <> 0 THEN 'stable' END AS direction FROM e""",
)
def _(t):
    return rounded(T.trend_change(
            T.trend(t.orders, "o_orderdate", "o_totalprice", "month", ordered=False)
        ), 2)


@query(
    "linear_forecast",
    """WITH d AS (SELECT CAST(ts AS DATE) AS x, SUM(value) AS y FROM events GROUP BY 1),
            l AS (SELECT regr_slope(y, date_diff('day', DATE '1970-01-01', x)) AS slope,
                         regr_intercept(y, date_diff('day', DATE '1970-01-01', x)) AS base,
                         MAX(x) AS last_day FROM d)
       SELECT x, round(y, 2) AS y, CAST(NULL AS DOUBLE) AS forecast FROM d
       UNION ALL
       SELECT last_day + CAST(step AS INTEGER), NULL,
              round(base + slope * date_diff('day', DATE '1970-01-01',
                last_day + CAST(step AS INTEGER)), 2)
       FROM l, generate_series(1, 7) AS g(step)""",
)
def _(t):
    return rounded(T.linear_forecast(t.events, "ts", "value"), 2)


def _forecast_sql(weekday: bool) -> str:
    """Least squares per event type over all its days; with a level for each weekday, the
    slope is the one within weekdays."""
    line = """SELECT k, regr_slope(y, t) AS slope, regr_intercept(y, t) AS base, MAX(x) AS last FROM dense GROUP BY k"""
    level = "base"
    if weekday:
        line = """SELECT k, SUM(ty) / SUM(tt) AS slope, MAX(last) AS last FROM (
            SELECT k, dayofweek(x) AS w, covar_pop(t, y) * COUNT(*) AS ty, var_pop(t) * COUNT(*) AS tt, MAX(x) AS last
            FROM dense GROUP BY ALL) GROUP BY k"""
        level = """(SELECT AVG(y) - slope * AVG(t) FROM dense d WHERE d.k = l.k
                    AND dayofweek(d.x) = dayofweek(l.last + CAST(step AS INTEGER)))"""
    return f"""
      WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS x, SUM(value) AS y FROM events
                 WHERE event_id % 5 <> 0 OR user_id % 2 = 0 GROUP BY ALL),
      span AS (SELECT k, MIN(x) AS a, MAX(x) AS b FROM d GROUP BY k),
      dense AS (SELECT span.k, CAST(g.x AS DATE) AS x, COALESCE(d.y, 0) AS y, date_diff('day', DATE '1970-01-01', CAST(g.x AS DATE)) AS t
                FROM span, LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS x) AS g
                LEFT JOIN d ON d.k = span.k AND d.x = CAST(g.x AS DATE)),
      l AS ({line})
      SELECT k AS event_type, x, round(y, 6) AS y, CAST(NULL AS DOUBLE) AS forecast FROM dense
      UNION ALL SELECT k, last + CAST(step AS INTEGER), NULL,
        round({level} + slope * date_diff('day', DATE '1970-01-01', last + CAST(step AS INTEGER)), 6)
      FROM l, generate_series(1, 10) AS g(step)"""


def _some_events(t):
    return t.events.where((F.col("event_id") % 5 != 0) | (F.col("user_id") % 2 == 0))


@query("forecast_groups", _forecast_sql(False))
def _(t):
    return rounded(T.forecast_groups(_some_events(t), "ts", "value", ["event_type"], 10), 6)


@query("forecast_groups_by_weekday", _forecast_sql(True))
def _(t):
    return rounded(T.forecast_groups(_some_events(t), "ts", "value", ["event_type"], 10, weekday=True), 6)
