"""Whole-table aggregates, column comparisons and what-if totals."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import quoted, try_numeric
from .profiling import _as_rows
from .quantiles import Quantile, aggregate_with_quantiles

AGGREGATES = ("AVG", "SUM", "MIN", "MAX", "MEDIAN", "COUNT")
_PLAIN = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}

# Metric names whose usual reading is a total.
TOTAL_METRICS = {
    "revenue", "net revenue", "sales", "turnover", "income",
    "profit", "net profit", "gross profit",
    "cost", "spend", "expense", "expenses",
    "marketing spend", "units sold", "quantity", "units",
    "returns", "returned units",
}


def default_aggregate(metric: str) -> str:
    """SUM for money and quantity names, AVG for anything else."""
    words = " ".join(metric.lower().replace("_", " ").replace("-", " ").split())
    return "SUM" if words in TOTAL_METRICS else "AVG"


def _checked(agg: str) -> str:
    agg = agg.upper()
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; one of {', '.join(AGGREGATES)}")
    return agg


def aggregate(
    df: DataFrame,
    wanted: list[tuple[str, str, str]],
    by: list[str] | None = None,
    method: str = "counting",
) -> DataFrame:
    """(alias, column, aggregate) triples in one pass, per group if ``by`` is given."""
    plain, quantiles = {}, []
    for alias, column, agg in wanted:
        agg, v = _checked(agg), try_numeric(df, column)
        if agg == "MEDIAN":
            quantiles.append(Quantile(alias, v, 0.5))
        else:
            plain[alias] = _PLAIN[agg](quoted(column) if agg == "COUNT" else v)
    out = aggregate_with_quantiles(df, plain, quantiles, by, method)
    return out.select(*map(quoted, [*(by or []), *[alias for alias, _, _ in wanted]]))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def count_column(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(quoted(column)).alias("count"))


def scalar_agg(df: DataFrame, column: str, agg: str, method: str = "counting") -> DataFrame:
    return aggregate(df, [(f"{agg.lower()}_value", column, agg)], method=method)


def multi_agg(df: DataFrame, columns: list[str], agg: str, by: list[str] | None = None):
    """One aggregate over several columns, aliased ``<agg>_<column>``."""
    taken: set[str] = set(by or [])
    wanted = []
    for column in columns:
        base = f"{agg}_{re.sub('[^a-zA-Z0-9]+', '_', column).strip('_')}".lower()
        spare = (f"{base}_{k}" for k in itertools.count(2))
        alias = base if base not in taken else next(a for a in spare if a not in taken)
        taken.add(alias)
        wanted.append((alias, column, agg))
    return aggregate(df, wanted, by)


def numeric_range(df: DataFrame, column: str) -> DataFrame:
    v = try_numeric(df, column)
    return df.agg(
        F.count(v).alias("count"), F.min(v).alias("minimum"), F.max(v).alias("maximum")
    )


# --------------------------------------------------------------------------
# comparisons
# --------------------------------------------------------------------------


def compare_columns(df: DataFrame, columns: list[str], agg: str = "AVG") -> DataFrame:
    """One aggregate over each column and which of them is highest and lowest."""
    agg = "AVG" if _checked(agg) == "COUNT" else agg
    wide = aggregate(df, [(f"v{i}", c, agg) for i, c in enumerate(columns)])
    values = F.array(*[F.col(f"v{i}") for i in range(len(columns))])
    # On a tie the column named first wins.
    best = F.array_position(values, F.array_max(values))
    worst = F.array_position(values, F.array_min(values))
    return _as_rows(
        wide,
        [
            {
                "column_name": F.lit(c),
                "value": F.col(f"v{i}"),
                "is_highest": F.coalesce(best == i + 1, F.lit(False)),
                "is_lowest": F.coalesce(worst == i + 1, F.lit(False)),
            }
            for i, c in enumerate(columns)
        ],
    )


def _compare(df: DataFrame, first: str, second: str, agg: str, alias: str, formula) -> DataFrame:
    agg = "AVG" if _checked(agg) == "COUNT" else agg
    wide = aggregate(df, [("first", first, agg), ("second", second, agg)])
    result: Column = formula(F.col("first"), F.col("second"))
    return wide.select("first", "second", result.alias(alias))


def compare_ratio(df: DataFrame, first: str, second: str, agg: str = "AVG") -> DataFrame:
    """first / second."""
    return _compare(df, first, second, agg, "ratio", F.try_divide)


def compare_pct_higher(df: DataFrame, first: str, second: str, agg: str = "AVG") -> DataFrame:
    """How much higher the first is, in percent of the second."""
    return _compare(
        df,
        first,
        second,
        agg,
        "pct_higher",
        lambda a, b: F.try_divide(a - b, F.abs(b)) * F.lit(100.0),
    )


def compare_pct_lower(df: DataFrame, first: str, second: str, agg: str = "AVG") -> DataFrame:
    """How much lower the second is, in percent of the first."""
    return _compare(
        df,
        first,
        second,
        agg,
        "pct_lower",
        lambda a, b: F.try_divide(b - a, F.abs(a)) * F.lit(100.0),
    )


def compare_pct_diff(df: DataFrame, first: str, second: str, agg: str = "AVG") -> DataFrame:
    """The difference in percent of the mean size of both."""
    return _compare(
        df,
        first,
        second,
        agg,
        "pct_diff",
        lambda a, b: F.try_divide(F.abs(a - b), (F.abs(a) + F.abs(b)) / F.lit(2.0))
        * F.lit(100.0),
    )


def compare_abs_diff(df: DataFrame, first: str, second: str, agg: str = "AVG") -> DataFrame:
    return _compare(df, first, second, agg, "abs_diff", lambda a, b: F.abs(a - b))


# --------------------------------------------------------------------------
# what-if
# --------------------------------------------------------------------------

# Verbs and the sign of their change.
SCENARIO_VERBS = {
    "increase": 1, "raise": 1, "grow": 1, "decrease": -1, "reduce": -1, "drop": -1,
}


def scenario(df: DataFrame, metric: str, verb: str, percent: float) -> DataFrame:
    """The current total of a metric and the total after a change in percent."""
    factor = 1.0 + SCENARIO_VERBS[verb] * percent / 100.0
    return df.agg(F.sum(try_numeric(df, metric)).alias("current_total")).withColumn(
        "projected_total", F.col("current_total") * F.lit(factor)
    )
