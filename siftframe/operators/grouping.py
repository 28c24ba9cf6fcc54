"""Grouped aggregates, rankings, shares and statements about groups.

Rankings put NULL results last in both directions and break ties by group, so
a limited ranking is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import percent_of, quoted
from .aggregates import aggregate, default_aggregate
from .profiling import _key

# Fixed values.
TOP_CATEGORIES = 15
CATEGORY_ROWS = 8

_TRACKED = 10_000  # values that a task's sketch of frequent values keeps


def _present(df: DataFrame, group: str, drop_null_group: bool) -> DataFrame:
    return df.where(quoted(group).isNotNull()) if drop_null_group else df


def _ranked(grouped: DataFrame, value: str, group: str, descending: bool) -> DataFrame:
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return grouped.orderBy(order, quoted(group).asc_nulls_last())


def _grouped(
    df: DataFrame, group: str, metric: str, agg: str, drop_null_group: bool, method: str = "counting"
) -> DataFrame:
    agg = default_aggregate(metric) if agg.lower() == "auto" else agg
    return aggregate(
        _present(df, group, drop_null_group), [("value", metric, agg)], [group], method
    )


def group_agg(
    df: DataFrame,
    group: str,
    metric: str,
    agg: str = "auto",
    descending: bool = True,
    drop_null_group: bool = True,
    method: str = "counting",
    ordered: bool = True,
) -> DataFrame:
    """(group, value), ordered by value.

    ``agg="auto"`` sums money and quantity metrics and averages all others.
    ``ordered=False`` saves the sort where the result is aggregated further.
    """
    grouped = _grouped(df, group, metric, agg, drop_null_group, method)
    return _ranked(grouped, "value", group, descending) if ordered else grouped


def group_sorted(df: DataFrame, group: str, metric: str, agg: str, ascending: bool) -> DataFrame:
    return group_agg(df, group, metric, agg, descending=not ascending)


def top_n_groups(
    df: DataFrame, group: str, metric: str, agg: str = "SUM", n: int = 1, lowest: bool = False
) -> DataFrame:
    """The ``n`` groups with the highest aggregate, or the lowest."""
    if n < 1:
        raise ValueError(f"n is {n}; at least one group is needed")
    return group_agg(df, group, metric, agg, descending=not lowest).limit(n)


def bottom_n_groups(
    df: DataFrame, group: str, metric: str, agg: str = "SUM", n: int = 1
) -> DataFrame:
    return top_n_groups(df, group, metric, agg, n, lowest=True)


def top_contributor(df: DataFrame, group: str, metric: str) -> DataFrame:
    """The group with the highest total."""
    return top_n_groups(df, group, metric, "SUM", 1)


def _counts(df: DataFrame, group: str) -> DataFrame:
    return (
        _present(df, group, True)
        .groupBy(quoted(group).alias(group))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def group_count(df: DataFrame, group: str, descending: bool = True) -> DataFrame:
    """(group, count) of the records in each group."""
    return _ranked(_counts(df, group), "count", group, descending)


def group_distribution(df: DataFrame, group: str) -> DataFrame:
    return group_count(df, group)


def frequent_candidates(df: DataFrame, column: str, limit: int) -> list[int] | None:
    """A job: hashes of the values among which the ``limit`` most frequent ones are, ties
    included, or None where a sketch can't prove it.

    The sketch counts up to ``_TRACKED`` values per task; what it leaves out, and the error
    of what it reports, is at most ``error``: seven rows in ``_TRACKED``, twice the bound
    of the sketch itself. If the last estimate wanted is above two errors, any value
    outside is rarer than it, and so is one whose estimate is an error below it.
    """
    value = quoted(column)
    item = F.xxhash64(_key(df, column))
    found = df.where(value.isNotNull()).agg(
        F.call_function("approx_top_k", item, F.lit(_TRACKED), F.lit(_TRACKED)).alias("top"), F.count(F.lit(1)).alias("n")
    ).head()
    error = 7 * found["n"] / _TRACKED
    counts = sorted((r["count"] for r in found["top"]), reverse=True)
    if len(counts) < limit or counts[limit - 1] <= 2 * error:
        return None
    return [r["item"] for r in found["top"] if r["count"] >= counts[limit - 1] - error]


def _most_frequent(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(value, count) of the most frequent values, ties by value.

    A sketch first finds the candidates (see :func:`frequent_candidates`); then only these
    are counted, exactly. Where the sketch can't tell, as with flat or unique values, all
    values are counted.
    """
    candidates = frequent_candidates(df, column, limit)
    if candidates is not None:
        df = df.where(quoted(column).isNotNull() & F.xxhash64(_key(df, column)).isin(candidates))
    return _counts(df, column).orderBy(F.desc("count"), quoted(column)).limit(limit)


def group_most_records(df: DataFrame, group: str) -> DataFrame:
    return _most_frequent(df, group, 1)


def group_fewest_records(df: DataFrame, group: str) -> DataFrame:
    return group_count(df, group, descending=False).limit(1)


def top_categories(df: DataFrame, column: str, limit: int = TOP_CATEGORIES) -> DataFrame:
    """(value, count) of the most frequent values, found by a sketch and counted exactly."""
    if limit < 1:
        raise ValueError(f"limit is {limit}; at least one value is needed")
    return _most_frequent(df, column, limit).select(quoted(column).alias("value"), "count")


def _with_share_of_shown(shown: DataFrame, value: str) -> DataFrame:
    # ``shown`` is already cut to its few display rows, so one window is enough.
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))
    return shown.withColumn("percentage", percent_of(F.col(value), total))


def category_counts_with_null(
    df: DataFrame, column: str, limit: int = CATEGORY_ROWS
) -> DataFrame:
    """Most frequent values, NULL shown as "(null)", in percent of the rows shown."""
    shown = (
        df.groupBy(F.coalesce(quoted(column).cast("string"), F.lit("(null)")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(limit)
    )
    return _with_share_of_shown(shown, "count")


def pie_slices(
    grouped: DataFrame, label: str, value: str, limit: int = CATEGORY_ROWS
) -> DataFrame:
    """The first positive slices of a grouped result and their share of what is shown."""
    slices = (
        grouped.select(quoted(label).cast("string").alias("label"), F.col(value).alias("value"))
        .where((F.col("value") > 0) & (F.col("label") != ""))
        .orderBy(F.desc("value"), "label")
        .limit(limit)
    )
    return _with_share_of_shown(slices, "value")


# --------------------------------------------------------------------------
# shares
# --------------------------------------------------------------------------


def _total(grouped: DataFrame, value: str) -> Column:
    """The sum over a grouped result as a scalar subquery.

    It reads the same shuffle as the groups themselves, so the table is
    scanned once and nothing is joined.
    """
    return grouped.agg(F.sum(value)).scalar()


def record_share(df: DataFrame, group: str) -> DataFrame:
    """(group, count, percentage) of the records whose group is known."""
    grouped = _counts(df, group)
    shares = grouped.withColumn(
        "percentage", percent_of(F.col("count"), _total(grouped, "count"))
    )
    return _ranked(shares, "percentage", group, True)


def metric_share(df: DataFrame, group: str, metric: str) -> DataFrame:
    """(group, value, percentage of the total metric); a zero total gives 0."""
    grouped = _grouped(df, group, metric, "SUM", True)
    shares = grouped.withColumn("_total", _total(grouped, "value")).select(
        quoted(group),
        "value",
        F.when(F.col("_total") == 0, F.lit(0.0))
        .otherwise(percent_of(F.col("value"), F.col("_total")))
        .alias("percentage"),
    )
    return _ranked(shares, "percentage", group, True)


# --------------------------------------------------------------------------
# statements about a grouped result
# --------------------------------------------------------------------------


def explain_groups(grouped: DataFrame, label: str, value: str = "value") -> DataFrame:
    """One row: strongest and weakest group and the strongest one's share."""
    v, name = F.col(value).cast("double"), quoted(label)
    ranked = grouped.where(v.isNotNull())
    high, low = _extremes(v, name)
    row = ranked.agg(
        high.getField("name").alias("top_label"),
        high.getField("v").alias("top_value"),
        low.getField("name").alias("lowest_label"),
        low.getField("v").alias("lowest_value"),
        F.sum(v).alias("_total"),
    )
    share = F.when(F.col("_total") > 0, percent_of(F.col("top_value"), F.col("_total")))
    return row.select(
        "top_label", "top_value", "lowest_label", "lowest_value", share.alias("top_share_pct")
    )


def _extremes(v: Column, name: Column) -> tuple[Column, Column]:
    """(value, name) of the highest and lowest group; ties go to the smaller name
    at the top and to the larger one at the bottom, as in a descending ranking."""
    high = F.min_by(
        F.struct(v.alias("v"), name.alias("name")), F.struct((-v).alias("v"), name.alias("name"))
    )
    low = F.max_by(
        F.struct(v.alias("v"), name.alias("name")), F.struct((-v).alias("v"), name.alias("name"))
    )
    return high, low


def group_spread(grouped: DataFrame, label: str, value: str = "value") -> DataFrame:
    """One row: highest, lowest, their gap (also in percent of the lowest) and
    the highest group's share. For two groups this is their difference."""
    v, name = F.col(value).cast("double"), quoted(label)
    ranked = grouped.where(
        v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        & name.isNotNull() & (F.trim(name.cast("string")) != "")
    )
    high, low = _extremes(v, name)
    row = ranked.agg(
        F.count(F.lit(1)).alias("groups"),
        high.getField("name").alias("highest_label"),
        high.getField("v").alias("highest_value"),
        low.getField("name").alias("lowest_label"),
        low.getField("v").alias("lowest_value"),
        F.sum(v).alias("_total"),
    )
    spread = F.col("highest_value") - F.col("lowest_value")
    return row.select(
        "groups",
        "highest_label",
        "highest_value",
        "lowest_label",
        "lowest_value",
        spread.alias("spread"),
        percent_of(spread, F.abs("lowest_value")).alias("spread_pct_of_lowest"),
        F.coalesce(percent_of(F.col("highest_value"), F.col("_total")), F.lit(0.0)).alias(
            "highest_share_pct"
        ),
    )
