"""Registered queries: a DataFrame function and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Tables derived from the given ones; the SQL below says the same.

    @property
    def events_with_gaps(self) -> DataFrame:
        """Events whose value is missing for errors, and no kind for purchases."""
        return self.events.withColumn(
            "value", F.when(F.col("event_type") != "error", F.col("value"))
        ).withColumn("event_type", F.nullif("event_type", F.lit("purchase")))

    @property
    def lines_with_gaps(self) -> DataFrame:
        """Order lines whose flag 'N' and zero discount are unknown."""
        return self.lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N"))).withColumn(
            "l_discount", F.nullif("l_discount", F.lit(0.0))
        )

    @property
    def sales(self) -> DataFrame:
        """Order lines told as a sales funnel."""
        return self.lineitem.select(
            F.col("l_returnflag").alias("region"),
            F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")).alias("product"),
            F.col("l_linestatus").alias("channel"),
            F.nullif(
                F.concat(F.lit("C"), (F.col("l_partkey") % 11).cast("string")), F.lit("C10")
            ).alias("campaign"),
            F.col("l_extendedprice").alias("revenue"),
            (F.col("l_quantity") * 900 + F.col("l_linenumber")).alias("cost"),
            F.col("l_quantity").alias("units_sold"),
            F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
            .otherwise(F.lit(0.0))
            .alias("returns"),
            (F.col("l_quantity") * 100 + F.col("l_linenumber")).alias("marketing_spend"),
            (F.col("l_quantity") + 20).alias("leads"),
            F.col("l_linenumber").alias("conversions"),
            (F.col("l_linenumber") % 5 + 1).alias("customer_rating"),
        )


EVENTS_WITH_GAPS = """(
  SELECT event_id, ts, user_id, NULLIF(event_type, 'purchase') AS event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value, props
  FROM events) AS events_with_gaps"""

LINES_WITH_GAPS = """(
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         NULLIF(l_discount, 0) AS l_discount, l_tax,
         NULLIF(l_returnflag, 'N') AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem) AS lines_with_gaps"""

SALES = """(
  SELECT l_returnflag AS region,
         concat('P', CAST(l_suppkey % 7 AS VARCHAR)) AS product,
         l_linestatus AS channel,
         NULLIF(concat('C', CAST(l_partkey % 11 AS VARCHAR)), 'C10') AS campaign,
         l_extendedprice AS revenue,
         l_quantity * 900 + l_linenumber AS cost,
         l_quantity AS units_sold,
         CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS returns,
         l_quantity * 100 + l_linenumber AS marketing_spend,
         l_quantity + 20 AS leads,
         l_linenumber AS conversions,
         l_linenumber % 5 + 1 AS customer_rating
  FROM lineitem) AS sales"""


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name`` with its SQL, if it has one."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return register
