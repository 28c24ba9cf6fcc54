"""Clean-up of tables that were typed by hand or exported from a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted, try_numeric
from ..functions.text import strip_space
from .files import clean_names, unique_names

# Fixed values.
HEADER_MARK = "s no"
HEADER_SEARCH_ROWS = 30
NUMERIC_SHARE = 0.80


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def promote_header(
    df: DataFrame,
    position: str,
    mark: str | None = None,
    search_rows: int = HEADER_SEARCH_ROWS,
) -> DataFrame:
    """Use the true header row of a headerless text table; drop all rows up to it.

    It is the first of the leading ``search_rows`` rows with a cell that starts
    with ``mark``. Without a ``mark`` it is "s no", and a table that does not
    have it begins with its header; a mark that was asked for and is not there
    is a ValueError. ``position`` is a column that rises in row order (see
    ``with_row_position``); it is dropped. Only the candidate rows are looked
    at for the header; its names come to the driver, as a schema has to be
    known there.
    """
    if search_rows < 1:
        raise ValueError(f"search_rows is {search_rows}; at least one row is needed")
    cells = [c for c in df.columns if c != position]
    head = df.orderBy(position).limit(search_rows)
    marked = F.exists(
        F.array(*[F.coalesce(F.lower(strip_space(quoted(c).cast("string"))), F.lit("")) for c in cells]),
        lambda cell: cell.startswith((HEADER_MARK if mark is None else mark).lower()),
    )
    if mark is not None:
        head = head.where(marked)
    header = head.orderBy(F.desc(marked), position).limit(1).collect()
    if not header:
        if mark is not None:
            raise ValueError(f"no cell of the first {search_rows} rows starts with {mark!r}")
        return df.drop(position)
    row = header[0]
    at = row[position]
    at = F.struct(*[F.lit(v) for v in at]) if isinstance(at, Row) else F.lit(at)
    at = at.cast(df.schema[position].dataType)
    names = unique_names([row[c] for c in cells])
    return (
        df.where(F.col(position) > at).select(*[quoted(c) for c in cells]).toDF(*names)
    )


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; one counting pass decides."""
    counts = df.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).head()
    return df.select(*[quoted(c) for i, c in enumerate(df.columns) if counts[i] > 0])


def drop_repeated_headers(df: DataFrame) -> DataFrame:
    """Without rows whose first cell is the name of the first column again."""
    first = df.columns[0]
    cell = F.lower(strip_space(quoted(first).cast("string")))
    return df.where(F.coalesce(cell != F.lit(first.strip().lower()), F.lit(True)))


def trim_strings(df: DataFrame) -> DataFrame:
    text = set(_strings(df))
    return df.select(
        *[strip_space(quoted(c)).alias(c) if c in text else quoted(c) for c in df.columns]
    )


def coerce_mostly_numeric(df: DataFrame, share: float = NUMERIC_SHARE) -> DataFrame:
    """Text columns of which at least ``share`` of the values are numbers become
    double; the other values turn NULL. One counting pass decides for all columns."""
    text = _strings(df)
    if not text:
        return df
    counts = df.agg(
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(text)],
        *[F.count(try_numeric(df, c)).alias(f"k{i}") for i, c in enumerate(text)],
    ).head()
    size = len(text)
    numeric = {
        c for i, c in enumerate(text) if counts[i] > 0 and counts[size + i] / counts[i] >= share
    }
    return df.select(
        *[try_numeric(df, c).alias(c) if c in numeric else quoted(c) for c in df.columns]
    )


def clean_table(df: DataFrame, position: str) -> DataFrame:
    """All steps in order, from a headerless text table to a typed one."""
    df = drop_empty_columns(drop_empty_rows(promote_header(df, position)))
    return coerce_mostly_numeric(trim_strings(drop_repeated_headers(clean_names(df))))
