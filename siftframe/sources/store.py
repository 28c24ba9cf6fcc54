"""Keep a table under an id and open it again later.

A table is written to a new folder of its own; one metadata row, written
afterwards under the next version number, makes it the current version. A writer
that dies half-way leaves the previous version in place, readers never see a
partial one, and of two writers with the same number the later one fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import quoted
from .scratch import remove_path

_METADATA = "dataset_id string, filename string, row_count bigint, folder string, version bigint"


@dataclass(frozen=True)
class Dataset:
    dataset_id: str
    filename: str
    table: DataFrame
    metadata: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.table.columns


def _base(root: str, dataset_id: str) -> str:
    if not dataset_id or "/" in dataset_id or dataset_id.startswith("."):
        raise ValueError(f"not a dataset id: {dataset_id!r}")
    return f"{root.rstrip('/')}/{dataset_id}"


def _log(spark: SparkSession, base: str) -> DataFrame | None:
    """One row per version; None if there is none."""
    try:
        return spark.read.schema(_METADATA).parquet(f"{base}/metadata/*")
    except AnalysisException:
        return None


def clustered(df: DataFrame, columns: list[str], files: int) -> DataFrame:
    """``df`` in ``files`` ranges of ``columns``, each in order, so that the smallest and
    largest values Parquet keeps of its row groups tell which ones a filter can skip.

    A value that fills more than a range is spread by a hash of the row over several.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise ValueError(f"no column to cluster by: {', '.join(missing) or 'none given'}")
    if files < 1:
        raise ValueError(f"files is {files}; at least one is needed")
    plain = [quoted(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    order = [quoted(c) for c in columns]
    return df.repartitionByRange(files, *order, F.xxhash64(*plain)).sortWithinPartitions(*order)


def persist_dataset(
    df: DataFrame,
    root: str,
    dataset_id: str,
    filename: str,
    cluster_by: list[str] | None = None,
    files: int | None = None,
    row_group_mb: int = 128,
) -> Dataset:
    """Write ``df`` as the next version of ``dataset_id`` below ``root``.

    With ``cluster_by`` the rows are written in ranges of these columns (see
    :func:`clustered`), as many as ``files`` (default: ``spark.sql.shuffle.partitions``),
    so filters on the first of them read only the row groups they need.

    AnalysisException if another writer has taken the version number meanwhile.
    """
    spark, base, folder = df.sparkSession, _base(root, dataset_id), uuid.uuid4().hex
    log = _log(spark, base)
    version = 1 if log is None else (log.agg(F.max("version")).head()[0] or 0) + 1
    if cluster_by is not None:
        df = clustered(df, cluster_by, files or int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("parquet.block.size", row_group_mb << 20).parquet(f"{base}/data/{folder}")
    # Counted from what was written: Parquet footers hold the number of rows.
    written = spark.read.parquet(f"{base}/data/{folder}")
    row = written.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(filename).alias("filename"),
        "row_count",
        F.lit(folder).alias("folder"),
        F.lit(version).cast("bigint").alias("version"),
    )
    row.coalesce(1).write.mode("errorifexists").parquet(f"{base}/metadata/{version:012d}")
    return open_dataset(spark, root, dataset_id)


def open_dataset(spark: SparkSession, root: str, dataset_id: str) -> Dataset:
    """The current version of a dataset; KeyError if there is none."""
    base = _base(root, dataset_id)
    log = _log(spark, base)
    if log is None:
        raise KeyError(dataset_id)
    latest = log.orderBy(F.desc("version")).limit(1)
    row = latest.head()
    if row is None:
        raise KeyError(dataset_id)
    return Dataset(
        dataset_id=row["dataset_id"],
        filename=row["filename"],
        table=spark.read.parquet(f"{base}/data/{row['folder']}"),
        metadata=latest.select("dataset_id", "filename", "row_count"),
    )


def vacuum(spark: SparkSession, root: str, dataset_id: str, keep: int = 1) -> int:
    """Delete all versions but the last ``keep``; how many went.

    Readers of older versions must have ended. Their metadata goes first, so no
    version is ever listed without its data.
    """
    if keep < 1:
        raise ValueError(f"keep is {keep}; the current version stays")
    base = _base(root, dataset_id)
    log = _log(spark, base)
    if log is None:
        raise KeyError(dataset_id)
    rows = log.select("version", "folder").orderBy(F.desc("version")).collect()  # one per version
    for row in rows[keep:]:
        remove_path(spark, f"{base}/metadata/{row['version']:012d}")
        remove_path(spark, f"{base}/data/{row['folder']}")
    return len(rows[keep:])
