"""Interquartile outliers, z-scores and box-plot statistics over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite, try_numeric
from ..functions.roles import numeric_columns
from .profiling import _as_rows, _chunks, _union
from .quantiles import Quantile, aggregate_with_quantiles, summaries

_FENCE = 1.5  # fixed value: whisker length in interquartile ranges


def iqr_outliers(df: DataFrame, column: str, method: str = "counting") -> DataFrame:
    """Rows outside the 1.5 IQR fences, with the quartiles q1 and q3.

    The fences enter as a scalar subquery: the rows are filtered where they are
    read and nothing is joined or shuffled.
    """
    v = try_numeric(df, column)
    quartiles = [Quantile("q1", v, 0.25), Quantile("q3", v, 0.75)]
    reach = (F.col("q3") - F.col("q1")) * _FENCE
    fences = (
        aggregate_with_quantiles(df, {}, quartiles, method=method)
        .select(
            F.struct(
                "q1", "q3", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")
            )
        )
        .scalar()
    )
    outside = (v < fences.getField("low")) | (v > fences.getField("high"))
    return df.where(outside).select(
        "*", fences.getField("q1").alias("q1"), fences.getField("q3").alias("q3")
    )


def zscore(df: DataFrame, column: str) -> DataFrame:
    """All rows with ``z_score`` by population deviation; a constant column gives 0."""
    v = finite(try_numeric(df, column))
    stats = df.agg(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))).scalar()
    z = F.coalesce(F.try_divide(v - stats.getField("mean"), stats.getField("std")), F.lit(0.0))
    return df.withColumn("z_score", F.when(v.isNotNull(), z))


def boxplot_stats(
    df: DataFrame, columns: list[str] | None = None, method: str = "counting"
) -> DataFrame:
    """Per column, on z-scores: q1, median, q3, whiskers and the number of fliers.

    The whiskers end at the most extreme values within 1.5 IQR of the box. A z-score
    is a rising linear function of its value, so quartiles are taken on the
    values and rescaled; the table is not rewritten.
    """
    columns = numeric_columns(df) if columns is None else columns
    frames = []
    for chunk in _chunks(columns):
        values = [finite(try_numeric(df, c)) for c in chunk]
        found = summaries(df, [(v, None) for v in values], [0.25, 0.5, 0.75], method)
        box = {"m": F.col("mean"), "s": F.col("std_pop")}
        box |= {n: F.get("quantiles", F.lit(k)) for k, n in enumerate("abc")}
        first = found.agg(
            *[F.max(F.when(F.col("lane") == i, c)).alias(f"{n}{i}") for i in range(len(chunk)) for n, c in box.items()]
        )
        boxes = first.select(F.struct("*")).scalar()
        # The boxes become one column, so that the many uses below read it.
        boxed = df.select(
            *[v.alias(f"_v{i}") for i, v in enumerate(values)], boxes.alias("_box")
        )
        aggs = [F.first("_box").alias("f")]
        for i in range(len(chunk)):
            v, q1, q3 = F.col(f"_v{i}"), F.col(f"_box.a{i}"), F.col(f"_box.c{i}")
            reach = (q3 - q1) * _FENCE
            inside = (v >= q1 - reach) & (v <= q3 + reach)
            aggs += [
                F.min(F.when(inside, v)).alias(f"lo{i}"),
                F.max(F.when(inside, v)).alias(f"hi{i}"),
                F.count(F.when(~inside, 1)).alias(f"out{i}"),
            ]
        wide = boxed.agg(*aggs)
        rows = []
        for i, c in enumerate(chunk):
            mean, std = F.col(f"f.m{i}"), F.col(f"f.s{i}")

            def scaled(x: Column, mean: Column = mean, std: Column = std) -> Column:
                z = F.coalesce(F.try_divide(x - mean, std), F.lit(0.0))
                return F.when(x.isNotNull(), z)

            # A whisker never ends inside the box, even if no value lies beyond it.
            rows.append(
                {
                    "column_name": F.lit(c),
                    "q1": scaled(F.col(f"f.a{i}")),
                    "median": scaled(F.col(f"f.b{i}")),
                    "q3": scaled(F.col(f"f.c{i}")),
                    "whisker_low": scaled(F.least(F.col(f"lo{i}"), F.col(f"f.a{i}"))),
                    "whisker_high": scaled(F.greatest(F.col(f"hi{i}"), F.col(f"f.c{i}"))),
                    "fliers": F.col(f"out{i}"),
                }
            )
        frames.append(_as_rows(wide, rows).where(F.col("median").isNotNull()))
    return _union(frames)
