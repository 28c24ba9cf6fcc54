"""Readers for CSV, TSV and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted


def unique_names(names: list[str | None]) -> list[str]:
    """White space collapsed, blank names "Unnamed", repeats numbered ``_1``, ``_2``.

    Names are told apart without regard to case, as Spark resolves them, and a
    number is never one that another name already has.
    """
    plain = [re.sub(r"\s+", " ", str(name or "")).strip() or "Unnamed" for name in names]
    written, taken, out = {name.lower() for name in plain}, set(), []
    for name in plain:
        free, n = name, 0
        while free.lower() in taken or (n and free.lower() in written):
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(free)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def _header(spark: SparkSession, path: str, sep: str, multi_line: bool) -> list[str | None]:
    """The names as written in the file; Spark's reader renames repeated ones."""
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line)
    first = reader.csv(path, header=False, inferSchema=False).head()
    return [first[i] for i in range(len(first))] if first is not None else []


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """A headed text file; integers are always ``bigint`` and names are unique.

    Types are inferred, which reads the files once more, unless a ``schema`` is
    given; its columns must be named as in the header, in the same order. A row
    with too many or too few fields, or with a value not of its type, is an
    error; other modes of Spark's reader cut, pad or drop such rows.

    Line breaks inside quotes need ``multi_line``; each file is then read by one
    task. Without it they are an error where they leave a row incomplete.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", mode)
    )
    if schema is not None:
        df = reader.option("enforceSchema", False).schema(schema).csv(path)
        names = df.columns
    else:
        reader = reader.option("inferSchema", True).option("preferDate", True)
        names = _header(spark, path, sep, multi_line)
        df = reader.csv(path)
    if len(names) == len(df.columns):
        df = df.toDF(*unique_names(names))
    return df.select(
        *[
            quoted(f.name).cast("bigint").alias(f.name)
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    return read_delimited(spark, path, ",", schema, multi_line, mode)


def read_tsv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    return read_delimited(spark, path, "\t", schema, multi_line, mode)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Read a table by its file extension."""
    readers = {".csv": read_csv, ".tsv": read_tsv, ".parquet": read_parquet}
    for extension, reader in readers.items():
        if path.lower().rstrip("/").endswith(extension):
            return reader(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def with_row_position(df: DataFrame, name: str = "_position") -> DataFrame:
    """``df``, just read from files, with a column that rises in reading order.

    It is made of the file, the place of the split in it and the place of the
    row in the split, so no task has to know how many rows come before its own.
    """
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", position.alias(name))
