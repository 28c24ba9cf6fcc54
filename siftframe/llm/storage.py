"""Tables in the shared scratch folder: they cut lineage and outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.scratch import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
