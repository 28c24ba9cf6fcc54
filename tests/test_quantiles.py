"""Exact quantiles, both ways, against NumPy and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftframe.operators import profiling as P
from siftframe.operators import quantiles as Q
from siftframe.operators.quantiles import Quantile, aggregate_with_quantiles

PROBS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]


def quantiles(df, method, by=None):
    v = F.col("v")
    wanted = [Quantile(f"q{i}", v, p) for i, p in enumerate(PROBS)]
    return aggregate_with_quantiles(df, {"n": F.count(v)}, wanted, by, method)


def samples():
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(400, 12.5), rng.normal(size=800)])
    return {
        "normal": rng.normal(0, 1e3, 1000),
        "wide": np.exp(rng.normal(0, 60, 1000)) * rng.choice([-1, 1], 1000),
        "one hot value": rng.permutation(hot),
        "close together": 1.0 + rng.integers(0, 50, 1000) * 2.0**-52,
        "integers": rng.integers(-5, 6, 999).astype(float),
        "single": np.array([42.0]),
        "two": np.array([-1.0, 2.0]),
        "tiny": np.array([5e-324, 1e-320, 0.0, -0.0, -5e-324]),
    }


@pytest.mark.parametrize("name", list(samples()))
def test_counting_matches_numpy(spark, name):
    values = samples()[name]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = quantiles(df, "counting").head()
    assert got["n"] == len(values)
    want = np.quantile(values, PROBS)
    near = max(5e-324, 1e-15 * np.abs(values).max())  # for results next to zero
    for i, w in enumerate(want):
        assert got[f"q{i}"] == pytest.approx(w, rel=1e-12, abs=near)


def test_groups_match_the_builtin(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("g"), F.col("id") % 40))
        .alias("g"),
        F.when(F.col("id") % 11 != 0, F.sin(F.col("id")) * F.col("id")).alias("v"),
    )
    df = df.unionByName(spark.sql("SELECT 'no values' AS g, CAST(NULL AS DOUBLE) AS v"))
    rows = [
        {r["g"]: r for r in quantiles(df, method, ["g"]).collect()}
        for method in ("builtin", "counting")
    ]
    assert rows[0].keys() == rows[1].keys() and None in rows[0]
    for g, builtin in rows[0].items():
        for a, b in zip(builtin[1:], rows[1][g][1:], strict=True):
            assert a == b if a is None else a == pytest.approx(b, rel=1e-12)


def test_special_values_sort_like_the_builtin(spark):
    df = spark.sql(
        "SELECT explode(array(double('nan'), double('inf'), double('-inf'), 0.0D, -1.5D, 3D, null)) AS v"
    )
    a, b = quantiles(df, "builtin").head(), quantiles(df, "counting").head()
    for x, y in zip(a, b, strict=True):
        assert x == y or (np.isnan(x) and np.isnan(y))


def test_no_values(spark):
    row = quantiles(spark.sql("SELECT CAST(NULL AS DOUBLE) AS v"), "counting").head()
    assert row["n"] == 0 and row["q0"] is None


def test_many_columns_share_the_passes(spark):
    df = spark.range(2000).select(*[(F.col("id") * (i + 1) % 97).alias(f"c{i}") for i in range(45)])
    a = {r["column_name"]: r for r in P.numeric_summary(df, method="builtin").collect()}
    b = {r["column_name"]: r for r in P.numeric_summary(df, method="counting").collect()}
    assert len(a) == 45
    for name, row in a.items():
        assert tuple(row)[1:] == pytest.approx(tuple(b[name])[1:])


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_the_size_guess_plays_no_part(spark, folder):
    rows = spark.range(100).select(F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("v"), "id")
    median = [Quantile("m", F.col("v") + F.col("id") / 1000, 0.5)]
    df = aggregate_with_quantiles(rows, {}, median)
    assert "percentile" not in final_plan(df)
    want = np.median(np.add.outer(np.arange(100) / 1000, np.arange(1, 2001)))
    assert df.head()["m"] == pytest.approx(want, rel=1e-12)


def test_one_median_takes_two_scans(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    spark.sparkContext.setJobGroup("one median", "")
    out = aggregate_with_quantiles(df, {}, [Quantile("m", F.col("l_extendedprice"), 0.5)])
    sketch_jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one median"))
    plan = final_plan(out)
    assert sketch_jobs <= 2
    assert plan.count("FileScan parquet") == 1  # the other one made the sketch
    assert len([x for x in plan.splitlines() if "Exchange" in x and "Reused" not in x]) <= 6
    assert "NestedLoop" not in plan and "SinglePartition" not in plan.split("Window", 1)[1]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one median")) <= 9


def wide_tables():
    rng = np.random.default_rng(11)
    n = 60_000
    hot = np.where(rng.random(n) < 0.34, 7.25, rng.normal(size=n))
    return {
        "normal": rng.normal(size=n),
        "a third is one value": hot,
        "few values": rng.integers(0, 9, n).astype(float),
        "heavy tail": np.exp(rng.normal(0, 40, n)),
        "close together": 1000 + rng.random(n) * 1e-6,
        "sorted": np.arange(n) / 7,
        "infinite ends": np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.3, -np.inf, rng.random(n))),
    }


def test_large_columns_have_narrow_bands_and_exact_ranks(spark):
    tables = wide_tables()
    names = list(tables)
    rows = np.stack(list(tables.values()), axis=1).tolist()
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(names)))).repartition(7)
    found = Q.summaries(df, [(F.col(f"c{i}"), None) for i in range(len(names))], PROBS).collect()
    for row in found:
        values = np.sort(tables[names[row["lane"]]])
        assert row["count"] == row["raw"] == len(values)
        assert (row["minimum"], row["maximum"]) == (values[0], values[-1])
        for p, got in zip(PROBS, row["quantiles"], strict=True):
            at = p * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = low if low == high else low * (1 - at % 1) + high * (at % 1)
            assert got == pytest.approx(want, rel=1e-12), (names[row["lane"]], p)
    for state in Q.states(df, [(F.col("c0"), [0.25, 0.5], None)]):
        for low, *_, high in state.bands:
            inside = ((tables["normal"] >= low) & (tables["normal"] <= high)).mean()
            assert 0.001 < inside < 0.02


def test_a_rank_outside_its_band_is_an_error(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    wrong = [Q.State(10_000, bands=((1.0, 2.0),))]
    with pytest.raises(Exception, match="outside the band"):
        Q._located(df, [Quantile("m", F.col("v"), 0.5)], wrong).collect()


def test_the_sketch_alone_is_near(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    row = quantiles(df, "sketch").head()
    assert [row[f"q{i}"] for i in range(len(PROBS))] == pytest.approx([1e5 * p for p in PROBS], abs=500)
    for row in quantiles(df, "sketch", ["g"]).collect():
        assert row["q4"] == pytest.approx(50_000, abs=500)
    assert quantiles(df.where("false"), "sketch").head()["q0"] is None


def test_a_group_whose_values_are_close_together_is_split(spark):
    """All values of a group in one coarse bucket: no task puts more than a step in order."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (1000 + F.rand(5)).alias("v"))
    assert df.select(Q._coarse_bucket(F.col("v"))).distinct().count() <= 2
    out = quantiles(df, "counting", ["g"])
    want, got = quantiles(df, "builtin", ["g"]).head(), out.head()
    assert tuple(got)[1:] == pytest.approx(tuple(want)[1:], rel=1e-12)
    windows = [x for x in final_plan(out).splitlines() if "Window [sum(_n" in x and "_v" in x]
    assert windows and all("_step" in x for x in windows)


def test_many_and_large_groups(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 2000).alias("g"),
        (F.hash("id") / 1000).alias("v"),
    )
    a = {r["g"]: r for r in quantiles(df, "builtin", ["g"]).collect()}
    counted = quantiles(df, "counting", ["g"])
    b = {r["g"]: r for r in counted.collect()}
    assert a.keys() == b.keys() and len(a) > 1000
    for g, row in a.items():
        assert tuple(row)[1:] == pytest.approx(tuple(b[g])[1:], rel=1e-12)
    assert "BroadcastNestedLoop" not in final_plan(counted)


def test_an_unknown_method_is_an_error(spark):
    with pytest.raises(ValueError, match="auto"):
        quantiles(spark.range(1).withColumnRenamed("id", "v"), "auto")
