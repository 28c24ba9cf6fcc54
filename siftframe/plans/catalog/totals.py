"""Whole-table aggregates, comparisons, KPIs and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.expressions import rounded
from ...operators import aggregates as A
from ...operators import kpis as K
from ...operators import profiling as P
from ..report import findings, summary_blocks
from .registry import EVENTS_WITH_GAPS, SALES, query


@query("row_count", "SELECT COUNT(*) AS count FROM lineitem")
def _(t):
    return A.row_count(t.lineitem)


@query("count_column", f"SELECT COUNT(value) AS count FROM {EVENTS_WITH_GAPS}")
def _(t):
    return A.count_column(t.events_with_gaps, "value")


@query("scalar_agg", "SELECT round(SUM(l_extendedprice), 2) AS sum_value FROM lineitem")
def _(t):
    return rounded(A.scalar_agg(t.lineitem, "l_extendedprice", "SUM"), 2)


@query("scalar_agg_avg", "SELECT round(AVG(c_acctbal), 4) AS avg_value FROM customer")
def _(t):
    return rounded(A.scalar_agg(t.customer, "c_acctbal", "AVG"))


@query(
    "scalar_agg_min", "SELECT MIN(CAST(p_retailprice AS DOUBLE)) AS min_value FROM part"
)
def _(t):
    return A.scalar_agg(t.part, "p_retailprice", "MIN")


@query("scalar_agg_max", "SELECT MAX(CAST(p_size AS DOUBLE)) AS max_value FROM part")
def _(t):
    return A.scalar_agg(t.part, "p_size", "MAX")


@query(
    "scalar_agg_median",
    "SELECT round(MEDIAN(l_extendedprice), 4) AS median_value FROM lineitem",
)
def _(t):
    return rounded(A.scalar_agg(t.lineitem, "l_extendedprice", "MEDIAN"))


@query(
    "multi_agg",
    """SELECT round(AVG(l_quantity), 4) AS avg_l_quantity,
              round(AVG(l_extendedprice), 4) AS avg_l_extendedprice,
              round(AVG(l_tax), 4) AS avg_l_tax
       FROM lineitem""",
)
def _(t):
    return rounded(A.multi_agg(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], "AVG"))


@query(
    "multi_agg_grouped",
    """SELECT l_linestatus, round(SUM(l_quantity), 2) AS sum_l_quantity,
              round(SUM(l_extendedprice), 2) AS sum_l_extendedprice
       FROM lineitem GROUP BY l_linestatus""",
)
def _(t):
    return rounded(
        A.multi_agg(t.lineitem, ["l_quantity", "l_extendedprice"], "SUM", ["l_linestatus"]), 2
    )


@query(
    "numeric_range",
    f"""SELECT COUNT(value) AS count, MIN(value) AS minimum, MAX(value) AS maximum
        FROM {EVENTS_WITH_GAPS}""",
)
def _(t):
    return A.numeric_range(t.events_with_gaps, "value")


_STATS = """
  SELECT COUNT({c}) AS count, round(AVG({c}), 4) AS mean, round(STDDEV_SAMP({c}), 4) AS stddev,
         round(VAR_SAMP({c}), 2) AS variance, CAST(MIN({c}) AS DOUBLE) AS min,
         CAST(MAX({c}) AS DOUBLE) AS max, round(QUANTILE_CONT({c}, 0.25), 4) AS q1,
         round(MEDIAN({c}), 4) AS median, round(QUANTILE_CONT({c}, 0.75), 4) AS q3
  FROM {t}"""


def _rounded_stats(df):
    return rounded(df).withColumn("variance", F.round("variance", 2))


@query("stat_summary", _STATS.format(c="l_extendedprice", t="lineitem"))
def _(t):
    return _rounded_stats(P.stat_summary(t.lineitem, "l_extendedprice"))


@query("stat_summary_with_nulls", _STATS.format(c="value", t=EVENTS_WITH_GAPS))
def _(t):
    return _rounded_stats(P.stat_summary(t.events_with_gaps, "value"))


@query("stat_summary_counting", _STATS.format(c="o_totalprice", t="orders"))
def _(t):
    """The passes used for large inputs, whatever the size of this one."""
    return _rounded_stats(P.stat_summary(t.orders, "o_totalprice", method="counting"))


# -- comparisons -------------------------------------------------------------

_AB = "(SELECT AVG(l_extendedprice) AS a, AVG(l_quantity) AS b FROM lineitem) AS x"
_FIRST = "round(a, 4) AS first, round(b, 4) AS second"


@query(
    "compare_columns",
    """WITH x AS (SELECT AVG(l_quantity) AS a, AVG(l_linenumber) AS b, AVG(l_tax) AS c FROM lineitem),
            y AS (SELECT 'l_quantity' AS column_name, a AS value FROM x
                  UNION ALL SELECT 'l_linenumber', b FROM x UNION ALL SELECT 'l_tax', c FROM x)
       SELECT column_name, round(value, 4) AS value,
              value = (SELECT MAX(value) FROM y) AS is_highest,
              value = (SELECT MIN(value) FROM y) AS is_lowest FROM y""",
)
def _(t):
    return rounded(A.compare_columns(t.lineitem, ["l_quantity", "l_linenumber", "l_tax"]))


@query("compare_ratio", f"SELECT {_FIRST}, round(a / NULLIF(b, 0), 4) AS ratio FROM {_AB}")
def _(t):
    return rounded(A.compare_ratio(t.lineitem, "l_extendedprice", "l_quantity"))


@query(
    "compare_pct_higher",
    f"SELECT {_FIRST}, round((a - b) / NULLIF(abs(b), 0) * 100, 4) AS pct_higher FROM {_AB}",
)
def _(t):
    return rounded(A.compare_pct_higher(t.lineitem, "l_extendedprice", "l_quantity"))


@query(
    "compare_pct_lower",
    f"SELECT {_FIRST}, round((b - a) / NULLIF(abs(a), 0) * 100, 4) AS pct_lower FROM {_AB}",
)
def _(t):
    return rounded(A.compare_pct_lower(t.lineitem, "l_extendedprice", "l_quantity"))


@query(
    "compare_pct_diff",
    f"""SELECT {_FIRST}, round(abs(a - b) / NULLIF((abs(a) + abs(b)) / 2, 0) * 100, 4) AS pct_diff
        FROM {_AB}""",
)
def _(t):
    return rounded(A.compare_pct_diff(t.lineitem, "l_extendedprice", "l_quantity"))


@query("compare_abs_diff", f"SELECT {_FIRST}, round(abs(a - b), 4) AS abs_diff FROM {_AB}")
def _(t):
    return rounded(A.compare_abs_diff(t.lineitem, "l_extendedprice", "l_quantity"))


@query(
    "scenario",
    """SELECT round(SUM(o_totalprice), 2) AS current_total,
              round(SUM(o_totalprice) * 1.1, 2) AS projected_total FROM orders""",
)
def _(t):
    return rounded(A.scenario(t.orders, "o_totalprice", "increase", 10), 2)


@query(
    "scenario_decrease",
    """SELECT round(SUM(o_totalprice), 2) AS current_total,
              round(SUM(o_totalprice) * 0.75, 2) AS projected_total FROM orders""",
)
def _(t):
    return rounded(A.scenario(t.orders, "o_totalprice", "reduce", 25), 2)


# -- KPIs --------------------------------------------------------------------

_KPIS = {
    "kpi_roi": (
        "(SUM(revenue) - SUM(cost)) * 100.0 / NULLIF(SUM(cost), 0)",
        K.kpi_roi,
    ),
    "kpi_profit_margin": (
        "(SUM(revenue) - SUM(cost)) * 100.0 / NULLIF(SUM(revenue), 0)",
        K.kpi_profit_margin,
    ),
    "kpi_conversion_rate": (
        "SUM(conversions) * 100.0 / NULLIF(SUM(leads), 0)",
        K.kpi_conversion_rate,
    ),
    "kpi_cost_per_lead": (
        "SUM(cost) / NULLIF(SUM(leads), 0)",
        K.kpi_cost_per_lead,
    ),
    "kpi_revenue_per_conversion": (
        "SUM(revenue) / NULLIF(SUM(conversions), 0)",
        K.kpi_revenue_per_conversion,
    ),
    "kpi_profit": ("SUM(revenue) - SUM(cost)", K.kpi_profit),
}
for _name, (_formula, _run) in _KPIS.items():
    query(_name, f"SELECT round({_formula}, 3) AS value FROM {SALES}")(
        lambda t, run=_run: rounded(run(t.sales), 3)
    )


@query(
    "kpi_by_group",
    f"""SELECT campaign, round((SUM(revenue) - SUM(cost)) * 100.0 / NULLIF(SUM(cost), 0), 4) AS value
        FROM {SALES} GROUP BY campaign""",
)
def _(t):
    return rounded(K.kpi_by_group(t.sales, "campaign", "roi", "revenue", "cost"))


@query(
    "best_roi_group",
    f"""SELECT campaign, round((SUM(revenue) - SUM(cost)) * 100.0 / NULLIF(SUM(cost), 0), 4) AS value
        FROM {SALES} WHERE campaign IS NOT NULL GROUP BY campaign
        ORDER BY (SUM(revenue) - SUM(cost)) * 100.0 / NULLIF(SUM(cost), 0) DESC NULLS LAST, campaign
        LIMIT 1""",
)
def _(t):
    return rounded(K.best_roi_group(t.sales))


_SUMMARY = """
  WITH s AS (
    SELECT COUNT(*) AS records, SUM(revenue) AS revenue, SUM(marketing_spend) AS spend,
           SUM(cost) AS cost, SUM(units_sold) AS units, SUM(returns) AS returns,
           SUM(leads) AS leads, SUM(conversions) AS conversions,
           AVG(customer_rating) AS rating, {profit} AS profit, {net} AS net
    FROM {sales})
  SELECT records, round(revenue, 2) AS total_revenue, round(net, 2) AS total_net_revenue,
         round(profit, 2) AS total_profit, round(spend, 2) AS total_marketing_spend,
         round(cost, 2) AS total_cost, round(units, 2) AS total_units_sold,
         round(returns, 2) AS total_returns, round(leads, 2) AS total_leads,
         round(CAST(conversions AS DOUBLE), 2) AS total_conversions,
         round(rating, 2) AS average_customer_rating,
         round(profit * 100.0 / NULLIF(COALESCE(NULLIF(net, 0), revenue), 0), 2) AS profit_margin_percent,
         round(returns * 100.0 / NULLIF(units, 0), 2) AS return_rate_percent,
         round(profit / NULLIF(spend, 0), 2) AS profit_to_marketing_spend_ratio,
         round(profit * 100.0 / NULLIF(cost, 0), 2) AS roi_percent,
         round(conversions * 100.0 / NULLIF(leads, 0), 2) AS conversion_rate_percent
  FROM s"""


@query(
    "executive_summary",
    _SUMMARY.format(
        profit="SUM(revenue) - SUM(cost)", net="CAST(NULL AS DOUBLE)", sales=SALES
    ),
)
def _(t):
    return rounded(K.executive_summary(t.sales), 2)


@query(
    "executive_summary_stored_profit",
    _SUMMARY.format(
        profit="SUM(revenue - marketing_spend)", net="SUM(revenue - returns)", sales=SALES
    ),
)
def _(t):
    stored = t.sales.withColumn("profit", F.col("revenue") - F.col("marketing_spend")).withColumn(
        "net_revenue", F.col("revenue") - F.col("returns")
    )
    return rounded(K.executive_summary(stored), 2)


_LEADER = """SELECT * FROM (SELECT '{d}' AS dimension, {d} AS leader, round(SUM(revenue), 2) AS total
  FROM {sales} WHERE {d} IS NOT NULL GROUP BY {d} ORDER BY SUM(revenue) DESC, {d} LIMIT 1)"""


@query(
    "dimension_leaders",
    " UNION ALL ".join(
        _LEADER.format(d=d, sales=SALES) for d in ("region", "product", "channel", "campaign")
    ),
)
def _(t):
    return rounded(K.summary_leaders(t.sales), 2)


# -- findings ----------------------------------------------------------------

_PROJECTED = "(SELECT user_id, event_type, value, CAST(ts AS DATE) AS day FROM events) AS p"


def _projected(t):
    return t.events.select("user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))


_DUPLICATES = f"(SELECT (SELECT COUNT(*) FROM events) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {_PROJECTED})))"


@query(
    "findings",
    f"""
  SELECT CAST(1 AS INTEGER) AS position, 'Completeness' AS headline,
         concat(CAST(COUNT(*) FILTER (user_id IS NULL) + COUNT(*) FILTER (event_type IS NULL)
           + COUNT(*) FILTER (value IS NULL) + COUNT(*) FILTER (day IS NULL) AS VARCHAR),
           ' missing cells in 4 columns') AS text, 'good' AS level FROM {_PROJECTED}
  UNION ALL SELECT 2, 'Duplicate records',
         CASE WHEN {_DUPLICATES} = 0 THEN 'No duplicate records' ELSE 'There are duplicate records' END,
         CASE WHEN {_DUPLICATES} = 0 THEN 'good' ELSE 'critical' END
  UNION ALL SELECT 3, 'Strongest relationship',
         concat('user_id and value: r = ', format('{{:.2f}}', corr(user_id, value))), 'info' FROM events
  UNION ALL SELECT 4, 'Primary metric',
         concat('value averages ', format('{{:,.2f}}', AVG(value)), ' over ', CAST(COUNT(*) AS VARCHAR),
           ' records'), 'info' FROM events
  UNION ALL SELECT 5, 'Category diversity',
         concat('event_type has ', CAST(COUNT(DISTINCT event_type) AS VARCHAR), ' distinct values'),
         CASE WHEN COUNT(DISTINCT event_type) > 10 THEN 'warning' ELSE 'info' END FROM events
  UNION ALL SELECT 6, 'Time dimension', 'day can be used for trends', 'good'""",
)
def _(t):
    return findings(_projected(t), "value")


@query(
    "summary_blocks",
    f"""
  SELECT CAST(1 AS INTEGER) AS position, 'Dataset scale' AS headline,
         concat(CAST(COUNT(*) AS VARCHAR), ' records in 4 columns') AS text, 'info' AS level FROM events
  UNION ALL SELECT 2, 'Completeness', 'No missing values', 'good'
  UNION ALL SELECT 3, 'Structure', '2 numeric, 1 categorical, 1 time', 'info'
  UNION ALL SELECT 4, 'Primary metric',
         concat('value averages ', format('{{:,.2f}}', AVG(value))), 'info' FROM events
  UNION ALL SELECT 5, 'Correlation',
         concat('user_id and value: r = ', format('{{:+.3f}}', corr(user_id, value))), 'info' FROM events
  UNION ALL SELECT 6, 'Time dimension', 'day can be used for trends', 'info'""",
)
def _(t):
    return summary_blocks(_projected(t), "value")


@query(
    "readiness",
    f"""
  WITH s AS (SELECT COUNT(*) AS n, 4 * COUNT(*) - COUNT(user_id) - COUNT(event_type) - COUNT(value)
                    - COUNT(day) AS missing FROM {_PROJECTED})
  SELECT round((4 * n - missing) * 100.0 / (4 * n), 4) AS completeness_pct,
         round((n - {_DUPLICATES}) * 100.0 / n, 4) AS duplicate_free_pct,
         CASE WHEN missing = 0 AND {_DUPLICATES} = 0 THEN 'READY' ELSE 'REVIEW' END AS verdict
  FROM s""",
)
def _(t):
    return P.readiness(_projected(t))
