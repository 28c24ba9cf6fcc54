"""Pearson correlations, all pairs from a single scan, and least-squares lines.

Every row becomes one row per column, with the other columns beside it, and one
aggregation by column has an aggregate for each of the others. The plan so has
as many aggregates as there are columns, not pairs of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ladder, pearson, try_numeric
from ..functions.roles import numeric_columns
from .profiling import _as_rows

# Words for |r|, highest threshold first.
STRENGTH_SCALES = {
    "pairs": ([(0.7, "strong"), (0.4, "moderate")], "weak"),
    "story": (
        [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")],
        "very weak",
    ),
    "heatmap": (
        [(0.8, "Very strong"), (0.6, "Strong"), (0.4, "Moderate"), (0.2, "Weak")],
        "Very weak",
    ),
}


def corr_strength(r: Column, scale: str = "pairs") -> Column:
    """The word for a correlation; "unavailable" where there is none."""
    steps, otherwise = STRENGTH_SCALES[scale]
    return F.when(r.isNull(), F.lit("unavailable")).otherwise(ladder(F.abs(r), steps, otherwise))


def corr_direction(r: Column) -> Column:
    return F.when(r > 0, F.lit("positive")).when(r < 0, F.lit("negative")).otherwise(F.lit("no"))


def corr_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pearson(try_numeric(df, x), try_numeric(df, y)).alias("correlation"))


def _correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, r) of every two of the columns, in both orders and with themselves."""
    rows = df.select(F.array(*[try_numeric(df, c) for c in columns]).alias("_v"))
    rows = rows.select("_v", F.posexplode("_v").alias("i", "_x")).where(F.col("_x").isNotNull())
    r = [pearson(F.col("_x"), F.get("_v", F.lit(j))).alias(f"r{j}") for j in range(len(columns))]
    wide = rows.groupBy("i").agg(*r)
    return wide.select("i", F.posexplode(F.array(*[F.col(f"r{j}") for j in range(len(columns))])).alias("j", "r"))


def _names(columns: list[str], number: str) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col(number))


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, column_x, column_y, correlation) for i < j."""
    if len(columns) < 2:
        raise ValueError("correlations need at least two numeric columns")
    # Columns without a value have no group; their pairs are there, without correlation.
    size = F.lit(len(columns) - 1)
    every = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), size)).alias("i"))
    every = every.select("i", F.explode(F.sequence(F.lit(0), size)).alias("j")).where("i < j")
    found = _correlations(df, columns).where("i < j")
    # One row per pair of columns on either side: the schema bounds the broadcast.
    return every.join(F.broadcast(found), ["i", "j"], "left").select(
        "i",
        "j",
        _names(columns, "i").alias("column_x"),
        _names(columns, "j").alias("column_y"),
        F.col("r").alias("correlation"),
    )


def corr_pairs(
    df: DataFrame, columns: list[str] | None = None, scale: str = "pairs"
) -> DataFrame:
    """Every pair of numeric columns once, with a word for its strength."""
    pairs = _pairs(df, numeric_columns(df) if columns is None else columns)
    return pairs.select(
        "column_x",
        "column_y",
        "correlation",
        corr_strength(F.col("correlation"), scale).alias("strength"),
    )


def corr_ranked(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs with a correlation, strongest first."""
    pairs = _pairs(df, numeric_columns(df) if columns is None else columns)
    return (
        pairs.where(F.col("correlation").isNotNull())
        .orderBy(F.abs("correlation").desc(), "i", "j")
        .select("column_x", "column_y", "correlation")
    )


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full matrix in long form (row, column, correlation), four digits.

    Pairs without a correlation, and the diagonal of a column that is constant,
    are 0.0. A single column correlates with itself at 1.0.
    """
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) < 2:
        return _as_rows(
            df.sparkSession.range(1),
            [
                {"row": F.lit(c), "column": F.lit(c), "correlation": F.lit(1.0)}
                for c in columns
            ],
        )
    return matrix_of(_correlations(df, columns), columns)


def matrix_of(found: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix of correlations (i, j, r), numbered in the order of ``columns``."""
    size = F.lit(len(columns) - 1)
    every = found.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), size)).alias("i"))
    every = every.select("i", F.explode(F.sequence(F.lit(0), size)).alias("j"))
    # One value for both orders of a pair; a column by itself is 1 unless it is constant.
    found = found.where("i <= j").select("i", "j", F.round("r", 4).alias("r"))
    near, far = F.least("i", "j"), F.greatest("i", "j")
    every = every.select(F.col("i").alias("row"), F.col("j").alias("column"), near.alias("i"), far.alias("j"))
    return every.join(F.broadcast(found), ["i", "j"], "left").select(
        _names(columns, "row").alias("row"),
        _names(columns, "column").alias("column"),
        F.coalesce("r", F.lit(0.0)).alias("correlation"),
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of ``y`` on ``x`` over all rows."""
    xv, yv = try_numeric(df, x), try_numeric(df, y)
    return df.agg(
        F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept")
    )
