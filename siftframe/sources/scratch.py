"""Where intermediate files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; on a cluster
    the setting is required, as a local path is not visible to executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="siftframe-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _own(spark: SparkSession) -> str:
    """The part of the scratch folder that belongs to this application."""
    return f"{scratch_root(spark)}/siftframe/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder, never used before."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it again: computed once, whatever is derived from it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has put into the scratch folder.

    To be called when no result that was built from it is needed any more, at
    the end of a session at the latest.
    """
    remove_path(spark, _own(spark))
