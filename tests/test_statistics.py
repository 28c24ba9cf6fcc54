"""Statistics that can be merged, and the dashboard set made from them."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from siftframe.operators import correlation as C
from siftframe.operators import profiling as P
from siftframe.operators import statistics as S
from siftframe.plans.report import category_charts, profile_bundle

NAN, INF = float("nan"), float("inf")
SCHEMA = "a int, b double, t string, `odd.name` decimal(9,2), d timestamp_ntz, flag boolean, m map<string,int>, e double"


def messy(spark, n=500):
    rows = []
    for i in range(n):
        b = [NAN, INF, -0.0, None][i % 97] if i % 97 < 4 else math.sin(i) * i
        word = None if i % 11 == 0 else "w" * (i % 5) * (20 if i % 2 else 1)
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i % 40)
        rows.append((None if i % 7 == 0 else i % 23, b, word, i % 13, day, i % 3 == 0, {"k": i % 4}, None))
    rows += rows[:50]
    return spark.createDataFrame([(*r[:3], None if r[3] is None else __import__("decimal").Decimal(r[3]) / 4, *r[4:]) for r in rows], SCHEMA)


def plain(df):
    """Rows as text, doubles to twelve digits."""
    def shown(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return str(x)

    return sorted([[shown(x) for x in r] for r in df.select(*sorted(df.columns)).collect()])


def test_the_bundle_is_the_same_as_its_parts(spark):
    df = messy(spark)
    parts = profile_bundle(df, ["a", "b"])
    numeric = ["a", "b", "odd.name", "e"]
    assert plain(parts["overview"]) == plain(P.overview(df))
    assert plain(parts["missing"]) == plain(P.missing_chart(df))
    assert plain(parts["columns"]) == plain(P.column_profiles(df))
    assert plain(parts["histograms"]) == plain(P.histograms(df, numeric))
    assert plain(parts["correlation"]) == plain(C.corr_matrix(df, numeric))
    assert plain(parts["categories"]) == plain(category_charts(df))


def test_five_parts_take_two_scans(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    for name, part in profile_bundle(df, ["l_orderkey"]).items():
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert ("lineitem.parquet" in plan) == (name in ("sample", "categories")), name
    text = S.column_statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1
    assert P.value_census(df, rows=True)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_bundle_of_a_table_without_rows(spark):
    df = messy(spark).where("false")
    parts = profile_bundle(df)
    for name, want in {"overview": P.overview(df), "columns": P.column_profiles(df), "missing": P.missing_chart(df)}.items():
        assert plain(parts[name]) == plain(want)
    assert parts["histograms"].collect() == []


def test_merged_statistics_are_those_of_all_rows(spark):
    df = messy(spark).withColumn("k", F.monotonically_increasing_id() % 5)
    cut = [df.where(F.col("k") == i).drop("k") for i in range(5)] + [df.where("false").drop("k")]
    whole = S.column_statistics(df.drop("k"))
    merged = S.merge_statistics(S.merge_statistics(*[S.column_statistics(c) for c in cut[:3]]), *[S.column_statistics(c) for c in cut[3:]])
    exact = ["position", "column_name", "rows", "nulls", "n", "minimum", "maximum", "low", "high", "finite", "mean", "m2"]
    assert plain(merged.select(exact)) == plain(whole.select(exact))
    numeric = ["a", "b", "odd.name", "e"]
    assert plain(C.matrix_of(S.correlations_of(merged, numeric), numeric)) == plain(C.corr_matrix(df, numeric))
    a, b = (sorted(S.approximate_profiles(s).collect()) for s in (whole, merged))
    for x, y in zip(a, b, strict=True):
        assert x["distinct_count"] == pytest.approx(y["distinct_count"], rel=0.02)
        assert x["column_name"] in ("b", "e") or x["median"] == y["median"]


def test_tables_of_different_columns_are_not_merged(spark):
    df = messy(spark, 5)
    with pytest.raises(ValueError, match="same form"):
        S.merge_statistics(S.column_statistics(df), S.column_statistics(df).drop("m2"))
    with pytest.raises(ValueError, match="at least one"):
        S.merge_statistics()


def test_approximate_profiles_are_near(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 1000).cast("string").alias("s"))
    got = {r["column_name"]: r for r in S.approximate_profiles(S.column_statistics(df)).collect()}
    assert got["x"]["distinct_count"] == pytest.approx(50_000, rel=0.08)
    assert got["s"]["distinct_count"] == pytest.approx(1000, rel=0.08)
    assert got["x"]["median"] == pytest.approx(25_000, abs=250)
    assert (got["x"]["min"], got["x"]["max"], got["x"]["mean"]) == (0, 49_999, 24_999.5)


@pytest.mark.parametrize("limit", [1, 7, 49, 50, 51, 2000])
def test_columns_near_the_limit_are_counted(spark, limit):
    sizes = [1, 2, 6, 7, 8, 48, 49, 50, 51, 52, 60, 1999, 2000, 2001, 5000]
    df = spark.range(5000).select(*[(F.col("id") % n).cast("string").alias(f"c{n}") for n in sizes])
    many = P.surely_more_than(df, df.columns, limit)
    assert all(int(c[1:]) > limit for c in many)
    assert {f"c{n}" for n in sizes if n > 1.5 * limit + 5} <= many
    got = {r["column_name"]: r["distinct_count"] for r in P.categorical_columns_for_charts(df, limit).collect()}
    assert got == {f"c{n}": n for n in sizes if 1 < n <= limit}


def test_unique_columns_are_not_shuffled(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("u"), (F.col("id") % 3).cast("string").alias("g"))
    text = P.categorical_columns_for_charts(df)._jdf.queryExecution().executedPlan().toString()
    assert "AS g" in text and "AS u" not in text
    assert category_charts(df.select("u")).collect() == []
