"""Compare a Spark result with what DuckDB says for the matching SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, datetime.datetime):
        return "datetime"
    return type(value).__name__


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def table(names: list[str], rows) -> tuple[list[str], Counter, dict[str, set[str]]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    kinds: dict[str, set[str]] = {n: set() for n in names}
    counted = Counter()
    for row in rows:
        for i in order:
            if row[i] is not None:
                kinds[names[i]].add(_kind(row[i]))
        counted[tuple(_plain(row[i]) for i in order)] += 1
    return sorted(names), counted, kinds


def difference(df, con, sql: str) -> str | None:
    """None if both agree on names, kinds of values and rows; else what differs."""
    result = con.execute(sql)
    want_names, want, want_kinds = table([d[0] for d in result.description], result.fetchall())
    got_names, got, got_kinds = table(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"{sum(extra.values())} extra, {sum(lacking.values())} lacking of {sum(want.values())}: "
            f"got {list(extra)[:2]} want {list(lacking)[:2]}"
        )
    if got_kinds != want_kinds:
        return f"kinds { {n: (got_kinds[n], want_kinds[n]) for n in got_kinds if got_kinds[n] != want_kinds[n]} }"
    return None
