"""Mergeable statistics of all columns of a table, from one scan.

``column_statistics`` gives one row per column: rows, nulls, extremes, moments, sketches
of distinct values (HyperLogLog) and of ranks (KLL), and the co-moments with every
numeric column. All of that can be merged, so the statistics of a table that grows by
parts are those of its parts put together with ``merge_statistics``, without reading the
old rows again. Counts, extremes, moments and correlations are exact; distinct values
and ranks are approximate here, and narrow down what an exact second scan has to do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import finite, quoted, try_numeric
from ..functions.roles import numeric_columns
from .profiling import LOG_SKETCH, _chunks, column_table, value_hash
from .quantiles import State, quantiles_of_counts, read_states, sketch_of

_CO = ("n", "mx", "my", "m2x", "m2y", "c")
_CO_TYPE = "struct<n:bigint,mx:double,my:double,m2x:double,m2y:double,c:double>"
_MOMENT_TYPE = "struct<n:bigint,mean:double,m2:double>"


def _co_moments(x: Column, y: Column) -> Column:
    """Counts, means and sums of squares and products of the rows that have both."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    n = F.count(x)
    parts = (n, F.avg(x), F.avg(y), F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n)
    return F.struct(*[p.alias(name) for p, name in zip(parts, _CO, strict=True)])


def column_statistics(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, rows, nulls, n, minimum, maximum, low, high,
    finite, mean, m2, distinct_state, rank_state, co_moments), one row per column.

    ``n`` to ``m2`` and ``rank_state`` are of the numeric value (n is 0 for other columns);
    ``low`` and ``high`` are the extremes of its ``finite`` values, ``m2`` the sum of
    squared deviations. ``co_moments`` are those with each numeric column, in their order.
    One scan: a row becomes one narrow row per column, counted with map-side combining.
    """
    numeric = numeric_columns(df)
    none = F.lit(None).cast("double")
    frames = []
    for chunk in _chunks(list(enumerate(df.columns))):
        entries = [
            F.struct(
                F.lit(i).alias("position"),
                quoted(c).isNull().cast("int").alias("null"),
                (try_numeric(df, c) + F.lit(0.0) if c in numeric else none).alias("x"),
                value_hash(df, c).alias("h"),
            )
            for i, c in chunk
        ]
        values = F.array(*[try_numeric(df, c) + F.lit(0.0) for c in numeric]) if numeric else F.array().cast("array<double>")
        rows = df.select(values.alias("v"), F.inline(F.array(*entries)))
        x, real = F.col("x"), finite(F.col("x"))
        co = [_co_moments(x, F.get("v", F.lit(j))) for j in range(len(numeric))]
        frames.append(
            rows.groupBy("position").agg(
                F.count(F.lit(1)).alias("rows"), F.sum("null").alias("nulls"), F.count(x).alias("n"),
                F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.min(real).alias("low"),
                F.max(real).alias("high"), F.count(real).alias("finite"), F.avg(x).alias("mean"),
                (F.var_pop(x) * F.count(x)).alias("m2"),
                F.hll_sketch_agg("h", F.lit(LOG_SKETCH)).alias("distinct_state"),
                sketch_of(x).alias("rank_state"),
                (F.array(*co) if co else F.array().cast(f"array<{_CO_TYPE}>")).alias("co_moments"),
            )
        )
    found = reduce(DataFrame.unionByName, frames)
    # One row per column on either side. A table without rows has a row per column too.
    out = column_table(df).join(F.broadcast(found), "position", "left")
    return out.na.fill(0, ["rows", "nulls", "n", "finite"])


def _fold(parts: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Put the parts that have rows together, two at a time."""
    some = F.filter(parts, lambda p: p["n"] > 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(None).cast(kind), lambda a, b: F.when(a.isNull(), b).otherwise(step(a, b))))


def _add_moments(a: Column, b: Column) -> Column:
    n, d = a["n"] + b["n"], b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"),
        (a["mean"] + d * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"),
    )


def _add_co_moments(a: Column, b: Column) -> Column:
    n, dx, dy = a["n"] + b["n"], b["mx"] - a["mx"], b["my"] - a["my"]
    weight = a["n"] * (b["n"] / n)
    return F.struct(
        n.alias("n"),
        (a["mx"] + dx * b["n"] / n).alias("mx"),
        (a["my"] + dy * b["n"] / n).alias("my"),
        (a["m2x"] + b["m2x"] + dx * dx * weight).alias("m2x"),
        (a["m2y"] + b["m2y"] + dy * dy * weight).alias("m2y"),
        (a["c"] + b["c"] + dx * dy * weight).alias("c"),
    )


def merge_statistics(*tables: DataFrame) -> DataFrame:
    """Statistics of the rows of all tables together; they must have the same columns.

    What is gathered per column is one entry for each table merged."""
    if not tables:
        raise ValueError("at least one table of statistics is needed")
    if len({t.schema.simpleString() for t in tables}) != 1:
        raise ValueError("these are not tables of statistics of the same form")
    parts = reduce(DataFrame.unionByName, tables)
    merged = parts.groupBy("position", "column_name", "data_type").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "n", "finite")],
        *[F.min(c).alias(c) for c in ("minimum", "low")],
        *[F.max(c).alias(c) for c in ("maximum", "high")],
        F.collect_list(F.struct("n", "mean", "m2")).alias("moments"),
        F.collect_list("co_moments").alias("co"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.kll_merge_agg_double("rank_state").alias("rank_state"),
    )
    total = _fold(F.col("moments"), _MOMENT_TYPE, _add_moments)
    nothing = F.struct(*[F.lit(0 if n == "n" else None).cast("bigint" if n == "n" else "double").alias(n) for n in _CO])
    by_column = F.transform(
        F.sequence(F.lit(0), F.size(F.get("co", F.lit(0))) - 1),
        lambda j: F.coalesce(_fold(F.transform("co", lambda c: F.get(c, j)), _CO_TYPE, _add_co_moments), nothing),
    )
    has = F.size(F.get("co", F.lit(0))) > 0
    merged = merged.withColumn("total", total).select(
        "*",
        F.col("total.mean").alias("mean"),
        F.col("total.m2").alias("m2"),
        F.when(has, by_column).otherwise(F.get("co", F.lit(0))).alias("co_moments"),
    )
    return merged.select(*tables[0].columns)


# --------------------------------------------------------------------------
# what the statistics say
# --------------------------------------------------------------------------


def null_counts_of(stats: DataFrame) -> DataFrame:
    """(position, column_name, total_rows, null_count)."""
    return stats.select("position", "column_name", F.col("rows").alias("total_rows"), F.col("nulls").alias("null_count"))


def correlations_of(stats: DataFrame, numeric: list[str]) -> DataFrame:
    """(i, j, r) of every two numeric columns, numbered in their order."""
    number = F.create_map(*[x for i, c in enumerate(numeric) for x in (F.lit(c), F.lit(i))])
    rows = stats.where(F.col("column_name").isin(*numeric)).select(
        F.element_at(number, F.col("column_name")).alias("i"), F.posexplode("co_moments").alias("j", "co")
    )
    r = F.try_divide(F.col("co.c"), F.sqrt(F.col("co.m2x")) * F.sqrt(F.col("co.m2y")))
    return rows.select("i", "j", F.when(~F.isnan(r), r).alias("r"))


def approximate_profiles(stats: DataFrame) -> DataFrame:
    """(position, column_name, missing_count, distinct_count, median, ...) without another
    scan: distinct values to about 2 %, quartiles to about a thousandth of the rows."""
    ranks = F.kll_sketch_get_quantile_double("rank_state", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    quartiles = F.when(F.col("n") > 0, ranks)
    deviation = F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1))
    return stats.select(
        "position",
        "column_name",
        F.col("data_type").alias("dtype"),
        F.col("nulls").alias("missing_count"),
        F.coalesce(F.hll_sketch_estimate("distinct_state"), F.lit(0)).alias("distinct_count"),
        F.col("minimum").alias("min"),
        F.col("maximum").alias("max"),
        F.round("mean", 4).alias("mean"),
        F.round(deviation, 4).alias("std"),
        *[F.get(quartiles, F.lit(k)).alias(n) for k, n in enumerate(("q25", "median", "q75"))],
    )


def numeric_counts_of(census: DataFrame, df: DataFrame, numeric: list[str]) -> DataFrame:
    """(lane, v, n): how often each value of the numeric columns of ``df`` occurs, by its census."""
    slots = {"as_double": "as_double", "as_long": "as_long", "as_text": "as_text"}
    here = [F.col(s).cast("double") for s in slots if s in census.columns]
    if "as_text" in census.columns and not any(isinstance(df.schema[c].dataType, T.DecimalType) for c in numeric):
        here = here[:-1]
    at = {df.columns.index(c): i for i, c in enumerate(numeric)}
    number = F.create_map(*[x for place, i in at.items() for x in (F.lit(place), F.lit(i))])
    rows = census.where(F.col("position").isin(*at))
    return rows.select(
        F.element_at(number, F.col("position")).alias("lane"), F.coalesce(*here).alias("v"), F.col("occurrences").alias("n")
    )


def summary_of(stats: DataFrame, counts: DataFrame, numeric: list[str]) -> DataFrame:
    """(column_name, count, minimum, maximum, mean, stddev, variance, q1, median, q3) from the
    statistics and the counts of the values. A job reads the sketches of the statistics."""
    probs = [0.25, 0.5, 0.75]
    number = F.create_map(*[x for i, c in enumerate(numeric) for x in (F.lit(c), F.lit(i))])
    below = lambda k: F.try_divide(F.col("m2"), F.col("n") - k)
    states = stats.where(F.col("column_name").isin(*numeric)).select(
        F.element_at(number, F.col("column_name")).alias("lane"), "n", F.col("n").alias("raw"), "minimum", "maximum",
        "mean", F.sqrt(below(1)).alias("stddev"), below(1).alias("variance"), F.sqrt(below(0)).alias("std_pop"),
        F.col("rank_state").alias("sketch"),
    )
    found: list[State] = read_states(states, [probs] * len(numeric))
    ranks = quantiles_of_counts(counts, probs, found)
    # One row per numeric column on either side.
    return states.join(F.broadcast(ranks), "lane", "left").select(
        F.get(F.array(*[F.lit(c) for c in numeric]), F.col("lane")).alias("column_name"),
        F.col("n").alias("count"), "minimum", "maximum", "mean", "stddev", "variance",
        *[F.get("quantiles", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))],
    )


def histograms_of(stats: DataFrame, counts: DataFrame, numeric: list[str], shown: list[str], bins: int = 20) -> DataFrame:
    """(column_name, bin, lower, upper, count) with ``bins`` equal-width bins, from the
    extremes in the statistics and the counts of the values."""
    number = F.create_map(*[x for i, c in enumerate(numeric) for x in (F.lit(c), F.lit(i))])
    sizes = stats.where(F.col("column_name").isin(*shown) & F.col("low").isNotNull()).select(
        F.element_at(number, F.col("column_name")).alias("lane"), "column_name", "low", "high",
        F.when(F.col("low") == F.col("high"), F.lit(1)).otherwise(F.lit(bins)).alias("bins"),
    )
    sizes = sizes.withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    # One row per column, then at most ``bins`` rows per column.
    values = counts.where(finite(F.col("v")).isNotNull()).join(F.broadcast(sizes), "lane")
    at = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")).cast("int"), F.col("bins") - 1)
    place = F.when(F.col("low") == F.col("high"), F.lit(0)).otherwise(at)
    filled = values.groupBy("lane", place.alias("bin")).agg(F.sum("n").alias("count"))
    frame = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    upper = F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width"))
    return frame.join(F.broadcast(filled), ["lane", "bin"], "left").select(
        "column_name",
        "bin",
        F.round(F.col("low") + F.col("bin") * F.col("width"), 6).alias("lower"),
        F.round(upper, 6).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
