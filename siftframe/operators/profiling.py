"""Completeness, duplicates, distinct values and per-column statistics.

Every profile covers all columns in a fixed number of scans; there is no loop
that starts one job per column.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import finite, quoted, try_numeric
from ..functions.roles import (
    categorical_columns,
    datetime_columns,
    numeric_columns,
)
from .quantiles import Quantile, aggregate_with_quantiles, summaries

_LONG_TEXT = 64  # longer values are compared by digest, so they are not shuffled whole
_QUARTILES = [0.25, 0.5, 0.75]
LOG_SKETCH = 12  # 4,096 registers of a distinct sketch: a relative error of 0.016 (one deviation)
_DISTINCT_SLACK = 0.1  # six deviations
_COLUMNS_PER_SCAN = 40  # keeps the generated aggregation code small on wide tables

# Fixed values.
CHART_MAX_CATEGORIES = 50
MISSING_CHART_ROWS = 25
QUALITY_ATTENTION_PCT = 20.0


# --------------------------------------------------------------------------
# keys and unpivoting
# --------------------------------------------------------------------------


def _digest_long(text: Column) -> Column:
    """Equal exactly where the texts are: a digest is longer than any text kept."""
    return F.when(F.length(text) > _LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(
        text
    )


def _key(df: DataFrame, name: str) -> Column:
    """A value Spark can group by that is equal exactly where ``name`` is."""
    dt, col = df.schema[name].dataType, quoted(name)
    if isinstance(dt, T.MapType):
        return F.array_sort(F.map_entries(col))
    return _digest_long(col) if isinstance(dt, T.StringType) else col


def _chunks(items: list, size: int = _COLUMNS_PER_SCAN) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _as_rows(wide: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """One output row per entry of ``rows`` from every (aggregated) input row."""
    return wide.select(
        F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows]))
    )


def column_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column_name, data_type) from the schema, one row per column."""
    columns = df.columns if columns is None else columns
    rows = [
        {
            "position": F.lit(i),
            "column_name": F.lit(c),
            "data_type": F.lit(df.schema[c].dataType.simpleString()),
        }
        for i, c in enumerate(columns)
    ]
    return _as_rows(df.sparkSession.range(1), rows)


def _lane(df: DataFrame, name: str) -> tuple[str, str, Column]:
    """The typed slot a value is carried in: (slot, slot type, value)."""
    dt, col = df.schema[name].dataType, quoted(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "as_double", "double", col.cast("double")
    if isinstance(dt, T.IntegralType) or isinstance(dt, T.BooleanType):
        return "as_long", "bigint", col.cast("bigint")
    if isinstance(dt, T.DateType):
        return "as_long", "bigint", F.unix_date(col).cast("bigint")
    if isinstance(dt, T.TimestampType):
        return "as_long", "bigint", F.unix_micros(col)
    if isinstance(dt, T.TimestampNTZType):
        return "as_time", "timestamp_ntz", col
    if isinstance(dt, T.MapType):
        return "as_text", "string", _digest_long(F.to_json(F.array_sort(F.map_entries(col))))
    if isinstance(dt, (T.ArrayType, T.StructType)):
        return "as_text", "string", _digest_long(F.to_json(col))
    if isinstance(dt, T.BinaryType):
        return "as_text", "string", _digest_long(F.hex(col))
    return "as_text", "string", _digest_long(col.cast("string"))


def value_census(df: DataFrame, columns: list[str] | None = None, rows: bool = False) -> DataFrame:
    """(position, slots..., occurrences): every distinct value of every column.

    With ``rows`` the whole row is counted too, at position -1, by its digest.

    Columns are unpivoted to narrow typed rows and counted with map-side
    combining, so frequent values cost one row per task. Grouping by (column,
    value) spreads one column over all tasks, unlike a wide multi-column
    distinct aggregation.
    """
    columns = df.columns if columns is None else columns
    lanes = list(enumerate(_lane(df, c) for c in columns))
    if rows:
        lanes.append((-1, ("as_row", "binary", row_digest(df))))
    slots = {slot: slot_type for _, (slot, slot_type, _) in lanes}
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            *[
                (value if slot == own else F.lit(None).cast(slot_type)).alias(slot)
                for slot, slot_type in slots.items()
            ],
        )
        for i, (own, _, value) in lanes
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("position", *slots)
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column_name, data_type, total_rows, null_count, distinct_count)."""
    columns = df.columns if columns is None else columns
    return _counts_of(value_census(df, columns), column_table(df, columns))


def _counts_of(census: DataFrame, table: DataFrame) -> DataFrame:
    """What a census says of the columns of a table."""
    slots = [c for c in census.columns if c not in ("position", "occurrences")]
    present = reduce(operator.or_, [F.col(s).isNotNull() for s in slots])
    counted = census.groupBy("position").agg(
        F.sum("occurrences").alias("total_rows"),
        F.coalesce(F.sum(F.when(~present, F.col("occurrences"))), F.lit(0)).alias("null_count"),
        F.count(F.when(present, 1)).alias("distinct_count"),
    )
    # One row per column on either side: the schema bounds the broadcast.
    return table.join(F.broadcast(counted), "position", "left").na.fill(
        0, ["total_rows", "null_count", "distinct_count"]
    )


def value_hash(df: DataFrame, name: str) -> Column:
    """64 bits of a value, equal where Spark groups values together."""
    key = _key(df, name)
    return F.when(quoted(name).isNotNull(), F.xxhash64(key))


def distinct_sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, distinct_state, estimate): one scan in which a task keeps a few KB per column."""
    entries = [F.struct(F.lit(i).alias("position"), value_hash(df, c).alias("h")) for i, c in enumerate(columns)]
    rows = df.select(F.inline(F.array(*entries)))
    found = rows.groupBy("position").agg(F.hll_sketch_agg("h", F.lit(LOG_SKETCH)).alias("distinct_state"))
    return found.withColumn("estimate", F.hll_sketch_estimate("distinct_state"))


def surely_more_than(df: DataFrame, columns: list[str], limit: int) -> set[str]:
    """A job: the columns that have more than ``limit`` distinct values for certain.

    Columns near the limit, on either side, are not among them: those are for an exact count."""
    if not columns:
        return set()
    most = F.col("estimate") * (1 - _DISTINCT_SLACK) > limit
    return {columns[r["position"]] for r in distinct_sketches(df, columns).where(most).collect()}


# --------------------------------------------------------------------------
# completeness and duplicates
# --------------------------------------------------------------------------


def _canonical(value: Column, kind: T.DataType) -> Column:
    """Text that is equal exactly where Spark groups values together: NULL is
    marked, everything else has its length before it, -0.0 is 0.0 and NaN is NaN."""
    if isinstance(kind, T.StringType):
        body = value
    elif isinstance(kind, T.BinaryType):
        body = F.hex(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        body = (value.cast("double") + F.lit(0.0)).cast("string")
    elif isinstance(kind, T.ArrayType):
        body = F.concat_ws("", F.transform(value, lambda x: _canonical(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        # In the order of the canonical texts, as entries need not be comparable.
        texts = F.transform(F.map_entries(value), lambda e: _canonical(e, entry))
        body = F.concat_ws("", F.array_sort(texts))
    elif isinstance(kind, T.StructType):
        parts = [_canonical(value.getField(f.name), f.dataType) for f in kind.fields]
        body = F.concat(*parts) if parts else F.lit("")
    else:
        body = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.length(body).cast("string"), F.lit(":"), body)
    )


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row, equal exactly where the rows are."""
    row = F.concat(F.lit(""), *[_canonical(quoted(f.name), f.dataType) for f in df.schema.fields])
    return F.unhex(F.sha2(row, 256))


def _row_groups(df: DataFrame) -> DataFrame:
    """(copies, nulls): one row per distinct row of ``df``, told by its digest."""
    nulls = F.lit(0)
    for c in df.columns:
        nulls = nulls + quoted(c).isNull().cast("int")
    return (
        df.select(row_digest(df).alias("row"), nulls.alias("nulls"))
        .groupBy("row", "nulls")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("copies", "nulls")
    )


def _totals(df: DataFrame) -> DataFrame:
    """Row, duplicate and null totals from one scan and one shuffle of the keys."""
    return _row_groups(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.col("copies") * F.col("nulls")), F.lit(0)).alias("missing"),
    )


def _pct(part: Column, whole: Column, when_empty: float, digits: int) -> Column:
    value = F.try_divide(part * F.lit(100.0), whole.cast("double"))
    return F.coalesce(F.round(value, digits), F.lit(when_empty))


def overview(df: DataFrame) -> DataFrame:
    """One row: size, duplicates, missing cells and the count of each role."""
    return _overview(_totals(df), df)


def _overview(totals: DataFrame, df: DataFrame) -> DataFrame:
    cells = F.col("rows") * len(df.columns)
    return totals.select(
        F.col("rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.col("duplicates").alias("duplicate_rows"),
        F.col("missing").alias("total_missing_cells"),
        _pct(F.col("missing"), cells, 0.0, 3).alias("missing_cell_pct"),
        F.lit(len(numeric_columns(df))).alias("numeric_column_count"),
        F.lit(len(categorical_columns(df))).alias("categorical_column_count"),
        F.lit(len(datetime_columns(df))).alias("datetime_column_count"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one (NULLs count as equal)."""
    return _totals(df).select(F.col("duplicates").alias("duplicate_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """(position, column_name, total_rows, null_count), one scan, no big shuffle."""
    frames = []
    for chunk in _chunks(list(enumerate(df.columns)), 200):
        wide = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"c{i}") for i, c in chunk]
        )
        frames.append(
            _as_rows(
                wide,
                [
                    {
                        "position": F.lit(i),
                        "column_name": F.lit(c),
                        "total_rows": F.col("n"),
                        "null_count": F.col("n") - F.col(f"c{i}"),
                    }
                    for i, c in chunk
                ],
            )
        )
    return _union(frames)


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: total NULL cells and their share of all cells."""
    return null_counts(df).agg(
        F.sum("null_count").alias("total_missing_cells"),
        _pct(F.sum("null_count"), F.sum("total_rows"), 0.0, 3).alias("missing_cell_pct"),
    )


def missing_chart(df: DataFrame, limit: int = MISSING_CHART_ROWS) -> DataFrame:
    """Columns with missing values, the most incomplete first."""
    return _missing_chart(null_counts(df), limit)


def _missing_chart(nulls: DataFrame, limit: int = MISSING_CHART_ROWS) -> DataFrame:
    return (
        nulls.select(
            "position",
            "column_name",
            "null_count",
            _pct(F.col("null_count"), F.col("total_rows"), 0.0, 3).alias("missing_pct"),
        )
        .where(F.col("missing_pct") > 0)
        .orderBy(F.desc("missing_pct"), "position")
        .limit(limit)
        .select("column_name", "null_count", "missing_pct")
    )


# --------------------------------------------------------------------------
# data quality
# --------------------------------------------------------------------------


def data_quality(df: DataFrame) -> DataFrame:
    """One row per column: nulls, distinct values, completeness and a status."""
    total, nulls = F.col("total_rows"), F.col("null_count")
    missing = F.coalesce(F.try_divide(nulls * F.lit(100.0), total.cast("double")), F.lit(0.0))
    status = (
        F.when((total > 0) & (nulls == total), F.lit("Critical"))
        .when(missing >= QUALITY_ATTENTION_PCT, F.lit("Needs attention"))
        .when(missing > 0, F.lit("Review"))
        .otherwise(F.lit("Good"))
    )
    return column_counts(df).select(
        "position",
        "column_name",
        "data_type",
        "total_rows",
        "null_count",
        F.round(missing, 1).alias("missing_pct"),
        "distinct_count",
        _pct(F.col("distinct_count"), total, 0.0, 1).alias("distinct_pct"),
        _pct(total - nulls, total, 100.0, 1).alias("completeness_pct"),
        status.alias("quality_status"),
    )


def dq_missing_only(quality: DataFrame) -> DataFrame:
    return quality.where(F.col("null_count") > 0)


def dq_most_distinct(quality: DataFrame, n: int = 5) -> DataFrame:
    return quality.orderBy(F.desc("distinct_count"), "position").limit(n)


def dq_attention(quality: DataFrame) -> DataFrame:
    return quality.where(F.col("quality_status") != "Good")


def dq_totals(df: DataFrame) -> DataFrame:
    """One row for the table: nulls, duplicates and overall completeness."""
    cells = F.col("rows") * len(df.columns)
    return _totals(df).select(
        F.col("rows").alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.col("missing").alias("total_nulls"),
        F.col("duplicates").alias("duplicate_rows"),
        _pct(cells - F.col("missing"), cells, 100.0, 1).alias("overall_completeness_pct"),
    )


def readiness(df: DataFrame) -> DataFrame:
    """Completeness, share of rows that are no duplicates, and a verdict."""
    cells = F.col("rows") * len(df.columns)
    return _totals(df).select(
        _pct(cells - F.col("missing"), cells, 100.0, 4).alias("completeness_pct"),
        _pct(F.col("rows") - F.col("duplicates"), F.col("rows"), 100.0, 4).alias(
            "duplicate_free_pct"
        ),
        F.when((F.col("missing") == 0) & (F.col("duplicates") == 0), F.lit("READY"))
        .otherwise(F.lit("REVIEW"))
        .alias("verdict"),
    )


# --------------------------------------------------------------------------
# statistics
# --------------------------------------------------------------------------


def numeric_summary(df: DataFrame, columns: list[str] | None = None, method: str = "counting"):
    """(column_name, count, minimum, maximum, mean, stddev, variance, q1, median, q3)."""
    columns = numeric_columns(df) if columns is None else columns
    frames = []
    for chunk in _chunks(columns):
        found = summaries(df, [(try_numeric(df, c), None) for c in chunk], _QUARTILES, method)
        frames.append(
            found.select(
                F.get(F.array(*[F.lit(c) for c in chunk]), F.col("lane")).alias("column_name"),
                *("count", "minimum", "maximum", "mean", "stddev", "variance"),
                *(F.get("quantiles", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))),
            )
        )
    return _union(frames)


def column_profiles(df: DataFrame, method: str = "counting") -> DataFrame:
    """One row per column: type, missing, distinct and, if numeric, statistics."""
    numeric = numeric_columns(df)
    return _profiles(column_counts(df), numeric, numeric_summary(df, method=method) if numeric else None)


def _profiles(counts: DataFrame, numeric: list[str], stats: DataFrame | None) -> DataFrame:
    counts = counts.select(
        "position",
        F.col("column_name"),
        F.col("data_type").alias("dtype"),
        F.col("null_count").alias("missing_count"),
        _pct(F.col("null_count"), F.col("total_rows"), 0.0, 3).alias("missing_pct"),
        "distinct_count",
    )
    kind = F.when(F.col("column_name").isin(*numeric), F.lit("numeric")) if numeric else F.lit(None)
    counts = counts.withColumn("type", F.coalesce(kind, F.lit("categorical")))
    if stats is None:
        empty = [F.lit(None).cast("double").alias(c) for c in _PROFILE_STATS]
        return counts.select("*", *empty)
    stats = stats.select(
        "column_name",
        F.col("minimum").alias("min"),
        F.col("maximum").alias("max"),
        F.round("mean", 4).alias("mean"),
        "median",
        F.round("stddev", 4).alias("std"),
        F.col("q1").alias("q25"),
        F.col("q3").alias("q75"),
    )
    # One row per numeric column: bounded by the schema.
    return counts.join(F.broadcast(stats), "column_name", "left")


_PROFILE_STATS = ["min", "max", "mean", "median", "std", "q25", "q75"]


def stat_summary(df: DataFrame, column: str, method: str = "counting") -> DataFrame:
    """One row of descriptive statistics; ``count`` covers all non-null cells.

    Two scans; one with ``method="sketch"``, whose quartiles are approximate."""
    found = summaries(df, [(try_numeric(df, column), quoted(column))], _QUARTILES, method)
    return found.select(
        F.col("raw").alias("count"),
        *("mean", "stddev", "variance"),
        F.col("minimum").alias("min"),
        F.col("maximum").alias("max"),
        *(F.get("quantiles", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))),
    )


def column_minmax(df: DataFrame) -> DataFrame:
    """Smallest and largest value of each column as text (not for booleans)."""
    ordered = [
        c
        for c in df.columns
        if isinstance(df.schema[c].dataType, T.AtomicType)
        and not isinstance(df.schema[c].dataType, (T.BooleanType, T.BinaryType))
    ]
    none = F.lit(None).cast("string")
    frames = []
    for chunk in _chunks(list(enumerate(df.columns))):
        use = [(i, c) for i, c in chunk if c in ordered]
        wide = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(quoted(c)).cast("string").alias(f"lo{i}") for i, c in use],
            *[F.max(quoted(c)).cast("string").alias(f"hi{i}") for i, c in use],
        )
        frames.append(
            _as_rows(
                wide,
                [
                    {
                        "position": F.lit(i),
                        "column_name": F.lit(c),
                        "minimum": F.col(f"lo{i}") if c in ordered else none,
                        "maximum": F.col(f"hi{i}") if c in ordered else none,
                    }
                    for i, c in chunk
                ],
            )
        )
    return _union(frames)


def categorical_columns_for_charts(
    df: DataFrame, max_categories: int = CHART_MAX_CATEGORIES
) -> DataFrame:
    """Categorical columns with more than one and at most ``max_categories`` values.

    A job with a sketch per column first finds those with far more values; the values of
    the others, which are few, are counted exactly. No column of unique values is shuffled.
    """
    columns = categorical_columns(df)
    many = surely_more_than(df, columns, max_categories)
    few = [c for c in columns if c not in many]
    if not few:
        none = column_table(df, df.columns[:1]).where(F.lit(False))
        return none.select("column_name", F.lit(0).cast("bigint").alias("distinct_count"))
    return (
        column_counts(df, few)
        .where((F.col("distinct_count") > 1) & (F.col("distinct_count") <= max_categories))
        .select("column_name", "distinct_count")
    )


# --------------------------------------------------------------------------
# histograms
# --------------------------------------------------------------------------


def histograms(
    df: DataFrame, columns: list[str] | None = None, bins: int | str = 20
) -> DataFrame:
    """(column_name, bin, lower, upper, count) with ``bins`` equal-width bins.

    ``bins="sqrt"`` takes the square root of the number of values, at least 5
    and at most 12; ``"sqrt_up"`` rounds it up. A constant column gives one bin, a column
    without finite values none. All columns share one scan for their ranges
    and one for their counts.
    """
    columns = numeric_columns(df) if columns is None else columns
    return _union([_histogram_chunk(df, chunk, bins) for chunk in _chunks(columns)])


def _bin_count(bins: int | str, n: Column) -> Column:
    if isinstance(bins, int):
        return F.lit(bins)
    root = {"sqrt": F.floor, "sqrt_up": F.ceil}[bins](F.sqrt(n))
    return F.least(F.lit(12), F.greatest(F.lit(5), root.cast("int")))


def _histogram_chunk(df: DataFrame, columns: list[str], bins: int | str) -> DataFrame:
    values = {c: finite(try_numeric(df, c)) for c in columns}
    wide = df.agg(
        *[
            F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).alias(
                f"r{i}"
            )
            for i, v in enumerate(values.values())
        ]
    )
    ranges = wide.select(
        F.struct(
            *[
                F.struct(
                    F.col(f"r{i}.lo").alias("lo"),
                    F.col(f"r{i}.hi").alias("hi"),
                    F.when(F.col(f"r{i}.lo") == F.col(f"r{i}.hi"), F.lit(1))
                    .otherwise(_bin_count(bins, F.col(f"r{i}.n")))
                    .alias("bins"),
                ).alias(f"r{i}")
                for i in range(len(columns))
            ]
        )
    ).scalar()

    # The ranges become one column, so that the many uses below read it.
    frame = (
        df.sparkSession.range(1)
        .select(ranges.alias("_r"))
        .select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("column_name"), F.col(f"_r.r{i}").alias("_r"))
                        for i, c in enumerate(columns)
                    ]
                )
            )
        )
        .select("column_name", "_r.*")
        .where(F.col("lo").isNotNull())
        .select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    )
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    placed = (
        df.select(*[v.alias(f"_v{i}") for i, v in enumerate(values.values())], ranges.alias("_r"))
        .select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column_name"),
                            F.col(f"_v{i}").alias("v"),
                            F.col(f"_r.r{i}").alias("_r"),
                        )
                        for i, c in enumerate(columns)
                    ]
                )
            )
        )
        .select("column_name", "v", "_r.*")
        .where(F.col("v").isNotNull())
        .select(
            "column_name",
            F.when(F.col("lo") == F.col("hi"), F.lit(0))
            .otherwise(
                F.least(
                    F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.col("bins") - 1
                )
            )
            .alias("bin"),
        )
        .groupBy("column_name", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # At most ``bins`` rows per column: bounded by the arguments.
    return frame.join(F.broadcast(placed), ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        F.round(F.col("lo") + F.col("bin") * width, 6).alias("lower"),
        F.round(
            F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(
                F.col("lo") + (F.col("bin") + 1) * width
            ),
            6,
        ).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram(df: DataFrame, column: str, bins: int | str = 20) -> DataFrame:
    return histograms(df, [column], bins)


def histogram_sqrt_bins(
    df: DataFrame, columns: list[str] | None = None, round_up: bool = False
) -> DataFrame:
    """Report histogram: square-root bins plus the median of each column."""
    columns = numeric_columns(df) if columns is None else columns
    counts = histograms(df, columns, "sqrt_up" if round_up else "sqrt")
    quantiles = [Quantile(f"m{i}", try_numeric(df, c), 0.5) for i, c in enumerate(columns)]
    medians = _as_rows(
        aggregate_with_quantiles(df, {}, quantiles),
        [
            {"column_name": F.lit(c), "median": F.col(f"m{i}")}
            for i, c in enumerate(columns)
        ],
    )
    return counts.join(F.broadcast(medians), "column_name")
