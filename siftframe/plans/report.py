"""Results put together from several operators: findings and the dashboard set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import quoted, try_numeric
from ..functions.roles import categorical_columns, datetime_columns, numeric_columns
from ..operators.correlation import corr_ranked, matrix_of
from ..operators.profiling import (
    CHART_MAX_CATEGORIES,
    _counts_of,
    _missing_chart,
    _overview,
    _profiles,
    column_counts,
    column_table,
    null_counts,
    overview,
    surely_more_than,
    value_census,
)
from ..operators.selection import sample_rows
from ..operators.statistics import (
    column_statistics,
    correlations_of,
    histograms_of,
    null_counts_of,
    numeric_counts_of,
    summary_of,
)
from ..sources.scratch import stored

# How much of a table the dashboard shows.
MAX_HISTOGRAMS, MAX_CATEGORY_CHARTS, CATEGORY_ROWS, SAMPLE_ROWS = 12, 8, 15, 20
MANY_CATEGORIES = 10


def _lines(source: DataFrame, *lines: tuple[int, str, Column, Column]) -> DataFrame:
    """One output row per (position, headline, text, level) from a one-row source."""
    return source.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(position).alias("position"),
                        F.lit(headline).alias("headline"),
                        text.alias("text"),
                        level.alias("level"),
                    )
                    for position, headline, text, level in lines
                ]
            )
        )
    )


def _line(source: DataFrame, position: int, headline: str, text: Column, level: Column):
    return _lines(source, (position, headline, text, level))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _union(lines: list[DataFrame]) -> DataFrame:
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out.orderBy("position")


def findings(
    df: DataFrame, metric: str | None = None, max_categories: int | None = 1
) -> DataFrame:
    """Observations: (position, headline, text, level).

    ``level`` is "good", "info", "warning" or "critical". The diversity of the
    first ``max_categories`` category columns is told, of all if it is None.
    """
    numeric, dates = numeric_columns(df), datetime_columns(df)
    categories = categorical_columns(df, include_datetime=False)
    facts = overview(df)
    missing, copies = F.col("total_missing_cells"), F.col("duplicate_rows")
    lines = [
        _lines(
            facts,
            (
                1,
                "Completeness",
                _said(missing, f" missing cells in {len(df.columns)} columns"),
                F.when(missing == 0, F.lit("good")).otherwise(F.lit("warning")),
            ),
            (
                2,
                "Duplicate records",
                F.when(copies == 0, F.lit("No duplicate records")).otherwise(
                    F.lit("There are duplicate records")
                ),
                F.when(copies == 0, F.lit("good")).otherwise(F.lit("critical")),
            ),
        )
    ]
    if len(numeric) > 1:
        lines.append(
            _line(
                corr_ranked(df, numeric).limit(1),
                3,
                "Strongest relationship",
                _said(
                    F.col("column_x"), " and ", F.col("column_y"), ": r = ",
                    F.format_number("correlation", 2),
                ),
                F.lit("info"),
            )
        )
    if metric:
        lines.append(
            _line(
                df.agg(
                    F.avg(try_numeric(df, metric)).alias("mean"), F.count(F.lit(1)).alias("rows")
                ),
                4,
                "Primary metric",
                _said(
                    f"{metric} averages ", F.format_number("mean", 2), " over ", F.col("rows"),
                    " records",
                ),
                F.lit("info"),
            )
        )
    if categories:
        distinct = F.col("distinct_count")
        lines.append(
            _line(
                column_counts(df, categories[:max_categories]),
                5,
                "Category diversity",
                _said(F.col("column_name"), " has ", distinct, " distinct values"),
                F.when(distinct > MANY_CATEGORIES, F.lit("warning")).otherwise(F.lit("info")),
            )
        )
    if dates:
        lines.append(
            _line(
                df.sparkSession.range(1),
                6,
                "Time dimension",
                F.lit(f"{dates[0]} can be used for trends"),
                F.lit("good"),
            )
        )
    return _union(lines)


def summary_blocks(df: DataFrame, metric: str | None = None) -> DataFrame:
    """The closing summary: size, completeness, structure, metric, correlation, time."""
    numeric, dates = numeric_columns(df), datetime_columns(df)
    categories = categorical_columns(df, include_datetime=False)
    # Sizes and nulls only: no need for the shuffle that finds duplicates.
    facts = null_counts(df).agg(
        F.max("total_rows").alias("row_count"),
        F.sum("null_count").alias("total_missing_cells"),
    )
    missing, info = F.col("total_missing_cells"), F.lit("info")
    lines = [
        _lines(
            facts,
            (
                1, "Dataset scale",
                _said(F.col("row_count"), f" records in {len(df.columns)} columns"), info,
            ),
            (
                2, "Completeness",
                F.when(missing == 0, F.lit("No missing values")).otherwise(
                    _said(missing, " missing cells")
                ),
                F.when(missing == 0, F.lit("good")).otherwise(F.lit("warning")),
            ),
        ),
        _line(
            df.sparkSession.range(1), 3, "Structure",
            F.lit(f"{len(numeric)} numeric, {len(categories)} categorical, {len(dates)} time"),
            info,
        ),
    ]
    if metric:
        mean = df.agg(F.avg(try_numeric(df, metric)).alias("mean"))
        lines.append(
            _line(
                mean, 4, "Primary metric",
                _said(f"{metric} averages ", F.format_number("mean", 2)), info,
            )
        )
    if len(numeric) > 1:
        r = F.col("correlation")
        lines.append(
            _line(
                corr_ranked(df, numeric).limit(1), 5, "Correlation",
                _said(
                    F.col("column_x"), " and ", F.col("column_y"), ": r = ",
                    F.when(r >= 0, F.lit("+")).otherwise(F.lit("")), F.format_number(r, 3),
                ),
                info,
            )
        )
    if dates:
        lines.append(
            _line(
                df.sparkSession.range(1), 6, "Time dimension",
                F.lit(f"{dates[0]} can be used for trends"), info,
            )
        )
    return _union(lines)


def category_charts(
    df: DataFrame,
    max_charts: int | None = MAX_CATEGORY_CHARTS,
    max_categories: int = CHART_MAX_CATEGORIES,
    rows: int = CATEGORY_ROWS,
) -> DataFrame:
    """(column_name, value, count): the most frequent values of the first columns
    that have few enough categories; of all such columns, if ``max_charts`` is None.

    A job with a sketch per column finds those with far more values, which go; the
    values of the others are counted exactly, so a column of long unique texts never
    travels.
    """
    columns = categorical_columns(df)
    if not columns:
        raise ValueError("the table has no categorical column")
    many = surely_more_than(df, columns, max_categories)
    columns = [c for c in columns if c not in many]
    if not columns:
        none = column_table(df, df.columns[:1]).where(F.lit(False))
        return none.select("column_name", F.lit("").alias("value"), F.lit(0).cast("bigint").alias("count"))
    counts = column_counts(df, columns)
    few = (F.col("distinct_count") > 1) & (F.col("distinct_count") <= max_categories)
    # At most one row per column from here on.
    chosen = counts.where(few).select("position", "column_name")
    if max_charts is not None:
        chosen = chosen.orderBy("position").limit(max_charts)
    values = (
        df.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("position"), quoted(c).cast("string").alias("value")
                        )
                        for i, c in enumerate(columns)
                    ]
                )
            )
        )
        .where(F.col("value").isNotNull())
        .join(F.broadcast(chosen), "position")
        .groupBy("position", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # At most ``max_categories`` rows per column reach the ranking.
    place = F.row_number().over(
        Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"))
    )
    return (
        values.withColumn("_place", place)
        .where(F.col("_place") <= rows)
        .select("column_name", "value", "count")
    )


def profile_bundle(
    df: DataFrame,
    order_by: list[str] | None = None,
    max_histograms: int | None = MAX_HISTOGRAMS,
    max_category_charts: int | None = MAX_CATEGORY_CHARTS,
) -> dict[str, DataFrame]:
    """Everything the dashboard shows, each part a DataFrame of its own.

    Histograms and category charts are drawn for the first columns of their
    kind; None as a maximum means all of them.

    ``df`` is scanned twice for overview, columns, missing, histograms and correlation
    together, when this is called: once for the statistics of all columns, once for a
    census of values and rows. Both are stored in the scratch folder (one row per column,
    and one per distinct value) and the five parts are read from there. The sample and
    the category charts, which need texts, read ``df`` when they are asked for.
    """
    numeric = numeric_columns(df)
    stats = stored(column_statistics(df), "statistics")
    census = stored(value_census(df, rows=True), "census")
    copies = F.when(F.col("position") == -1, F.col("occurrences") - 1)
    totals = census.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("duplicates"))
    sizes = stats.agg(F.max("rows").alias("rows"), F.sum("nulls").alias("missing"))
    totals = sizes.select("*", totals.scalar().alias("duplicates"))
    columns = census.where(F.col("position") >= 0).drop("as_row")
    counts = _counts_of(columns, column_table(df))
    parts = {
        "overview": _overview(totals, df),
        "missing": _missing_chart(null_counts_of(stats)),
        "sample": sample_rows(df, SAMPLE_ROWS, order_by),
    }
    if numeric:
        values = numeric_counts_of(columns, df, numeric)
        parts["columns"] = _profiles(counts, numeric, summary_of(stats, values, numeric))
        parts["histograms"] = histograms_of(stats, values, numeric, numeric[:max_histograms])
    else:
        parts["columns"] = _profiles(counts, numeric, None)
    if categorical_columns(df):
        parts["categories"] = category_charts(df, max_charts=max_category_charts)
    if len(numeric) > 1:
        parts["correlation"] = matrix_of(correlations_of(stats, numeric), numeric)
    return parts
