"""Column roles, read from the schema only (no job is started)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_DATETIME = tuple(
    getattr(T, name)
    for name in ("DateType", "TimestampType", "TimestampNTZType", "TimeType")
    if hasattr(T, name)
)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, _DATETIME)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def categorical_columns(df: DataFrame, include_datetime: bool = True) -> list[str]:
    """Non-numeric columns.

    Dashboard counts treat a date as categorical *and* as datetime; report
    tables do not, and pass ``include_datetime=False``.
    """
    return [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and (include_datetime or not is_datetime(f.dataType))
    ]


def role_of(data_type: T.DataType) -> str:
    if is_numeric(data_type):
        return "numeric"
    return "datetime" if is_datetime(data_type) else "categorical"


def column_roles(df: DataFrame) -> dict[str, str]:
    return {f.name: role_of(f.dataType) for f in df.schema.fields}


def list_columns(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, role), one row per column."""
    rows = [
        (i, f.name, f.dataType.simpleString(), role_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, role string"
    )
