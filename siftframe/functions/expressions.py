"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .roles import is_datetime, is_numeric

# Plain decimal text, digits optionally grouped with single underscores, or a
# spelled-out special value. Narrower than Spark's own cast, which also takes
# Java suffixes such as "1d".
_DIGITS = r"\d+(?:_\d+)*"
NUMERIC_TEXT = (
    r"(?i)^\s*[+-]?(?:(?:" + _DIGITS + r"(?:\.(?:" + _DIGITS + r")?)?|\." + _DIGITS + r")"
    r"(?:e[+-]?" + _DIGITS + r")?|nan|inf|infinity)\s*$"
)
FULL_DATE_TEXT = r"^\s*\d{1,4}-\d{1,2}-\d{1,2}(?:$|[ T].*$)"


def quoted(name: str) -> Column:
    """A column by its literal name, even when it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def try_numeric(df: DataFrame, name: str) -> Column:
    """``name`` as double; text that is not a number, and types that have no
    numeric reading, become NULL instead of failing."""
    dt, col = data_type(df, name), quoted(name)
    if isinstance(dt, T.DoubleType):
        return col
    if is_numeric(dt) or isinstance(dt, T.BooleanType):
        return col.cast("double")
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        cleaned = F.replace(F.trim(F.regexp_replace(col, r"\s+", " ")), F.lit("_"), F.lit(""))
        return F.when(col.rlike(NUMERIC_TEXT), cleaned.try_cast("double"))
    return F.lit(None).cast("double")


def try_date(df: DataFrame, name: str) -> Column:
    """``name`` as a date; text needs year, month and day."""
    dt, col = data_type(df, name), quoted(name)
    if is_datetime(dt) and not dt.simpleString().startswith("time("):
        return col.cast("date")
    if isinstance(dt, T.StringType):
        return F.when(col.rlike(FULL_DATE_TEXT), F.trim(col).try_cast("date"))
    return F.lit(None).cast("date")


def finite(col: Column) -> Column:
    """The value where it is a finite number, else NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def percent_of(part: Column, whole: Column) -> Column:
    """``part`` / ``whole`` in percent; NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def pearson(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both sides are present.

    NULL (never an error or NaN) when a side is constant or has no rows.
    """
    a_paired = F.when(b.isNotNull(), a)
    b_paired = F.when(a.isNotNull(), b)
    r = F.try_divide(
        F.covar_pop(a, b), F.stddev_pop(a_paired) * F.stddev_pop(b_paired)
    )
    return F.when(~F.isnan(r), r)


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first threshold that ``value`` reaches."""
    chain = reduce(
        lambda acc, step: acc.when(value >= F.lit(step[0]), F.lit(step[1])),
        steps[1:],
        F.when(value >= F.lit(steps[0][0]), F.lit(steps[0][1])),
    )
    return chain.otherwise(F.lit(otherwise))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column, so results do not depend on summation order."""
    return df.select(
        *[
            F.round(quoted(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )
