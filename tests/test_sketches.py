"""Samples by hash and frequent values by sketch."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftframe.operators import grouping as G
from siftframe.operators import selection as S


def brute(rows, limit, seed=0):
    """rows: (key, value)"""
    place = lambda k: hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    return sorted(v for _, v in sorted((place(k), v) for k, v in rows if v is not None)[:limit])


@pytest.mark.parametrize("limit", [1, 10, 333, 5000, 100_000])
def test_sample_is_the_least_hashes_however_rows_lie(spark, limit):
    rows = [(i, None if i % 4 == 0 else float(i % 100)) for i in range(8000)]
    df = spark.createDataFrame(rows, "id int, v double")
    for shape in (df.repartition(1), df.repartition(13, "v"), df.orderBy(F.desc("id"))):
        got = S.numeric_sample(shape, "v", limit=limit, key="id", seed=3)
        assert sorted(r["value"] for r in got.collect()) == brute(rows, limit, 3)


def test_samples_of_equal_rows_and_null_keys(spark):
    rows = [(7, 1.0)] * 900 + [(None, 2.0)] * 30 + [(i, 3.0) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "id int, v double")
    for limit in (5, 40, 950, 2000):
        got = S.keyed_samples(df, ["v"], "id", limit).collect()
        assert sorted(r["value"] for r in got) == brute(rows, limit)
    # Without a key the whole row is hashed.
    assert S.keyed_samples(df, ["v", "id"], None, 100).groupBy("column_name").count().where("count = 100").count() == 2
    assert S.keyed_samples(df.where("false"), ["v"], "id").collect() == []
    with pytest.raises(ValueError):
        S.keyed_samples(df, ["v"], "id", 0)


def test_pairs_need_both_values(spark):
    rows = [(i, float(i) if i % 3 else None, float(-i) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = S.pair_sample(df, "a", "b", key="id", limit=50).collect()
    want = brute([(i, (a, b) if a is not None and b is not None else None) for i, a, b in rows], 50)
    assert sorted((r["x"], r["y"]) for r in got) == want


def test_a_sample_represents_an_ordered_table(spark):
    df = spark.range(200_000).select("id", (F.col("id") / 200_000).alias("v"))
    values = [r["value"] for r in S.numeric_sample(df, "v", key="id").collect()]
    assert len(values) == 5000
    assert sum(values) / 5000 == pytest.approx(0.5, abs=0.02)


def frequent(df, limit):
    return [tuple(r) for r in G.top_categories(df, "v", limit).collect()]


def plain(df, limit):
    rows = df.where("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").limit(limit)
    return [tuple(r) for r in rows.collect()]


def tables(spark):
    n = 60_000
    i = F.col("id")
    values = {
        "skewed": F.when(i % 3 == 0, F.lit(-1)).when(i % 7 == 0, i % 5).otherwise(i),
        "flat": i % 6000,
        "unique": i,
        "tied": F.when(i % 2 == 0, i % 40).otherwise(i),
        "few": i % 4,
        "one": F.lit(1),
        "missing": F.when(i % 3 != 0, F.when(i % 2 == 0, F.lit(5)).otherwise(i)),
        "all missing": F.lit(None).cast("bigint"),
    }
    return {name: spark.range(n).select(v.cast("bigint").alias("v")).repartition(5) for name, v in values.items()}


@pytest.mark.parametrize("limit", [1, 15])
def test_frequent_values_are_exact(spark, limit):
    for name, df in tables(spark).items():
        assert frequent(df, limit) == plain(df, limit), name
        text = df.select(F.concat(F.lit("value "), F.col("v").cast("string")).alias("v"))
        assert frequent(text, limit) == plain(text, limit), name


def test_only_candidates_are_counted_where_the_sketch_proves_them(spark):
    found = {name: G.frequent_candidates(df, "v", 5) for name, df in tables(spark).items()}
    assert {name for name, c in found.items() if c is not None} == {"skewed", "tied"}
    assert len(found["skewed"]) == 6 and len(found["tied"]) == 20
    assert G.frequent_candidates(spark.range(0).withColumnRenamed("id", "v"), "v", 1) is None


def test_awkward_values(spark):
    df = spark.sql("SELECT explode(array(double('nan'), double('nan'), -0.0D, 0.0D, 0.0D, null, 1.5D)) AS v")
    assert frequent(df, 1) == [(0.0, 3)]
    assert G.group_most_records(df, "v").head()["count"] == 3
    with pytest.raises(ValueError):
        G.top_categories(df, "v", 0)
