"""Delimited text with types found from all values, and a list of what did not fit.

Every value has a kind, and the kinds of a column are merged along a lattice (whole
numbers into doubles, dates into timestamps, anything else into text). What is kept per
column is one count for each kind, so types come from one scan of the whole file and
not from its first rows. Whole numbers with leading zeros, and those beyond 64 bits,
are codes: a column that has one stays text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted
from .files import _header, unique_names, with_row_position

WRONG_FIELDS = "wrong number of fields"

_WHOLE = r"^[+-]?(?:0|[1-9]\d*)$"
_CODE = r"^[+-]?0\d+$"
_DOUBLE = r"^[+-]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?$"
_KINDS = ("boolean", "whole", "double", "date", "timestamp", "code", "text")
#: What a column may be, narrowest first, and the kinds of value that it takes in.
_LATTICE = [
    ("boolean", ("boolean",)),
    ("bigint", ("whole",)),
    ("double", ("whole", "double")),
    ("date", ("date",)),
    ("timestamp_ntz", ("date", "timestamp")),
]


@dataclass(frozen=True)
class Loaded:
    """A table, the cells and rows that are not in it, and the type of each column."""

    table: DataFrame
    rejects: DataFrame
    types: dict[str, str]


def _present(value: Column) -> Column:
    """The value without white space around it; none if nothing is left."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def value_kind(value: Column) -> Column:
    """The kind of a text value, one of seven; NULL for an empty one."""
    v = _present(value)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.lower(v).isin("true", "false"), F.lit("boolean"))
        .when(v.rlike(_CODE), F.lit("code"))
        .when(v.rlike(_WHOLE), F.when(v.try_cast("bigint").isNotNull(), F.lit("whole")).otherwise(F.lit("code")))
        .when(v.rlike(_DOUBLE), F.lit("double"))
        .when(v.rlike(_DATE) & v.try_cast("date").isNotNull(), F.lit("date"))
        .when(v.rlike(_TIMESTAMP) & v.try_cast("timestamp_ntz").isNotNull(), F.lit("timestamp"))
        .otherwise(F.lit("text"))
    )


def sniff_types(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(position, column_name, type, values, kinds): the type of each text column of ``df``.

    ``kinds`` counts the values of each kind. A column gets the narrowest type that at
    most the share ``tolerance`` of its values does not fit; codes are never given up, so
    a column that has any is text. A column without values is text. One scan.
    """
    if not 0 <= tolerance < 1:
        raise ValueError(f"tolerance is {tolerance}; it must be at least 0 and below 1")
    entries = [F.struct(F.lit(i).alias("position"), value_kind(quoted(c)).alias("kind")) for i, c in enumerate(df.columns)]
    rows = df.select(F.inline(F.array(*entries)))
    counts = rows.groupBy("position").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in _KINDS], F.count("kind").alias("values")
    )
    kind = F.lit("string")
    for name, takes in reversed(_LATTICE):
        others = sum((F.col(k) for k in _KINDS if k not in takes), F.lit(0))
        fits = (F.col("values") > 0) & (F.col("code") == 0) & (others <= F.floor(F.col("values") * tolerance))
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    return counts.select(
        "position",
        F.get(F.array(*[F.lit(c) for c in df.columns]), F.col("position")).alias("column_name"),
        kind.alias("type"),
        "values",
        F.struct(*_KINDS).alias("kinds"),
    )


def _parsed(value: Column, kind: str) -> Column:
    if kind == "string":
        return value
    v = _present(value)
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast(kind))
    if kind in ("double", "float"):
        special = F.lower(v).isin("nan", "inf", "-inf", "infinity", "-infinity")
        return F.when(v.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$") | special, v.try_cast(kind))
    if kind == "boolean":
        return F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true")
    if kind == "date":
        return F.when(v.rlike(_DATE), v.try_cast(kind))
    if kind.startswith("timestamp"):
        return F.when(v.rlike(_TIMESTAMP) | v.rlike(_DATE), v.try_cast(kind))
    return v.try_cast(kind)


def load_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    schema: dict[str, str] | None = None,
    multi_line: bool = False,
    tolerance: float = 0.0,
    position: str | None = None,
) -> Loaded:
    """A headed text file as a table and its rejects; nothing in the file is an error.

    Types are those of ``schema`` (name to type; text for names it does not have) or found
    by :func:`sniff_types`, a job over all values. In the table a cell that does not fit
    its type is NULL and listed in the rejects; a row with too many or too few fields is
    only in the rejects. Rejects are (position, column_name, value, reason): ``position``
    tells file, split and row and rises in reading order; ``column_name`` is NULL where the
    row as a whole is rejected, with its text as ``value``. With ``position`` the table has
    a column of that name to join them by. Text keeps its white space; an empty field is
    NULL. Line breaks inside quotes need ``multi_line``, a task per file.
    """
    names = unique_names(_header(spark, path, sep, multi_line))
    broken, at = "_broken_", "_at_"
    while broken in names or at in names:
        broken, at = broken + "_", at + "_"
    form = T.StructType([T.StructField(n, T.StringType()) for n in [*names, broken]])
    raw = (
        spark.read.schema(form)
        .options(sep=sep, header=True, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE")
        .options(columnNameOfCorruptRecord=broken, columnPruning=False, enforceSchema=True)
        .csv(path)
    )
    raw = with_row_position(raw, at)
    # Spark reads no file for its broken rows alone, so the test names a column too.
    first = F.substring(quoted(names[0]), 1, 0) if names else F.lit("")
    is_broken = F.length(F.concat_ws("", quoted(broken), first)) > 0
    whole = raw.where(~is_broken)
    if schema is None:
        found = sniff_types(whole.select(*[quoted(n) for n in names]), tolerance).collect() if names else []
        types = {n: "string" for n in names} | {r["column_name"]: r["type"] for r in found}  # one row per column
    else:
        unknown = set(schema) - set(names)
        if unknown:
            raise ValueError(f"the file has no column {', '.join(sorted(unknown))}")
        types = {n: schema.get(n, "string") for n in names}
    table = whole.select(
        *[_parsed(quoted(n), kind).alias(n) for n, kind in types.items()],
        *([quoted(at).alias(position)] if position else []),
    )

    def reject(name: Column, value: Column, reason: Column, when: Column) -> Column:
        return F.when(when, F.struct(name.alias("column_name"), value.alias("value"), reason.alias("reason")))

    none = F.lit(None).cast("string")
    cells = [reject(none, quoted(broken), F.lit(WRONG_FIELDS), is_broken)]
    for n, kind in types.items():
        bad = ~is_broken & _present(quoted(n)).isNotNull() & _parsed(quoted(n), kind).isNull()
        if kind != "string":
            cells.append(reject(F.lit(n), quoted(n), F.lit(f"not a {kind}"), bad))
    listed = raw.select(quoted(at).alias("position"), F.explode(F.array_compact(F.array(*cells))).alias("r"))
    return Loaded(table, listed.select("position", "r.*"), types)
