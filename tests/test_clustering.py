"""Tables stored in order of a column, and what a filter then has to read."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftframe.operators.selection import filter_rows
from siftframe.sources import store


def row_groups(folder, column, low, high):
    """(those that may hold a value between low and high, all)"""
    hit = every = 0
    for path in glob.glob(f"{folder}/data/*/*.parquet"):
        meta = pq.ParquetFile(path).metadata
        at = meta.schema.to_arrow_schema().names.index(column)
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at).statistics
            every += 1
            hit += stats is None or not stats.has_min_max or (stats.min <= high and stats.max >= low)
    return hit, every


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if "FileScan" in node.nodeName() or node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for seq in (node.children(), node.innerChildren()):
            for i in range(seq.size()):
                child = seq.apply(i)
                if hasattr(child, "nodeName"):
                    walk(child)

    walk(plan.executedPlan() if "Adaptive" in plan.nodeName() else plan)
    return sum(found)


def table(spark):
    return spark.range(60_000).select("id", F.pmod(F.hash("id"), F.lit(10_000)).cast("double").alias("v"), F.array("id").alias("a"))


def test_reads_go_down_with_the_filter(spark, tmp_path):
    df = table(spark).repartition(8, "id")
    plain = store.persist_dataset(df, str(tmp_path), "plain", "p")
    kept = store.persist_dataset(df, str(tmp_path), "kept", "k", cluster_by=["v"], files=20)
    seen = []
    for low, high in ((0, 99), (0, 999), (0, 4999)):
        hit, every = row_groups(tmp_path / "kept", "v", low, high)
        assert every == 20 and hit <= 20 * (high + 1) / 10_000 + 2
        conditions = [("v", ">=", low), ("v", "<=", high)]
        a, b = (filter_rows(d.table, conditions) for d in (plain, kept))
        seen.append(rows_scanned(b))
        assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
        assert rows_scanned(a) == 60_000
    assert seen[0] < 0.15 * 60_000 and seen == sorted(seen)
    assert row_groups(tmp_path / "plain", "v", 0, 99) == (8, 8)


def test_a_value_of_a_third_of_the_rows_is_split(spark, tmp_path):
    df = table(spark).withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("v")))
    store.persist_dataset(df, str(tmp_path), "hot", "h", cluster_by=["v", "id"], files=12)
    sizes = [pq.ParquetFile(p).metadata.num_rows for p in glob.glob(f"{tmp_path}/hot/data/*/*.parquet")]
    assert sum(sizes) == 60_000 and max(sizes) < 2.5 * 60_000 / 12


def test_awkward_columns(spark, tmp_path):
    df = table(spark).limit(10).withColumn("n", F.lit(None).cast("string"))
    kept = store.persist_dataset(df, str(tmp_path), "few", "f", cluster_by=["n", "v"], files=3)
    assert kept.table.count() == 10
    none = store.persist_dataset(df.where("false"), str(tmp_path), "none", "f", cluster_by=["v"])
    assert none.table.count() == 0
    for bad in ([], ["zz"]):
        with pytest.raises(ValueError):
            store.persist_dataset(df, str(tmp_path), "bad", "f", cluster_by=bad)
    with pytest.raises(ValueError):
        store.clustered(df, ["v"], 0)
