"""Empty tables, missing values, constants, odd names and types."""

import math

import pytest
from pyspark.sql import functions as F

from siftframe.functions import expressions as E
from siftframe.functions import roles
from siftframe.functions.text import normalize_text, repair_mojibake, shorten, strip_space
from siftframe.operators import aggregates as A
from siftframe.operators import correlation as C
from siftframe.operators import grouping as G
from siftframe.operators import kpis as K
from siftframe.operators import outliers as O
from siftframe.operators import profiling as P
from siftframe.operators import selection as S
from siftframe.operators import timeseries as T
from siftframe.plans.report import category_charts, findings, profile_bundle


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "g string, x double, y long, d date")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [
            ("a", 1.0, 5, None, {"k": 1}, "1d"),
            ("a", 1.0, 5, None, {"k": 1}, "1_000"),
            (None, float("nan"), 5, None, {"k": 2, "j": 1}, " 2 "),
            (None, None, 5, None, {"j": 1, "k": 2}, "1e3"),
            ("b", 7.0, 5, None, None, "x"),
        ],
        "g string, x double, constant long, nothing string, m map<string,int>, text string",
    )


def test_empty_table(spark, empty):
    row = P.overview(empty).head()
    assert row["row_count"] == 0 and row["duplicate_rows"] == 0 and row["missing_cell_pct"] == 0.0
    quality = {r["column_name"]: r for r in P.data_quality(empty).collect()}
    assert list(quality) and all(r["completeness_pct"] == 100.0 for r in quality.values())
    assert all(r["quality_status"] == "Good" for r in quality.values())
    assert P.dq_totals(empty).head()["overall_completeness_pct"] == 100.0
    assert P.readiness(empty).head()["verdict"] == "READY"
    assert P.histogram(empty, "x").count() == 0
    assert P.missing_chart(empty).count() == 0
    assert G.group_agg(empty, "g", "x", "SUM").count() == 0
    assert G.metric_share(empty, "g", "x").count() == 0
    assert C.corr_pair(empty, "x", "y").head()[0] is None
    assert O.iqr_outliers(empty, "x").count() == 0
    assert O.boxplot_stats(empty).count() == 0
    assert T.trend_change(T.trend(empty, "d", "x")).count() == 0
    assert T.linear_forecast(empty, "d", "x").count() == 0
    assert K.kpi_roi(empty, "x", "y").head()[0] is None
    assert A.scenario(empty, "x", "grow", 5).head()[:] == (None, None)
    assert {r["missing_pct"] for r in P.column_profiles(empty).collect()} == {0.0}


def test_nulls_nan_and_maps(odd):
    counts = {r["column_name"]: r for r in P.column_counts(odd).collect()}
    assert counts["x"]["null_count"] == 1 and counts["x"]["distinct_count"] == 3
    assert counts["g"]["null_count"] == 2 and counts["g"]["distinct_count"] == 2
    assert counts["nothing"]["null_count"] == 5 and counts["nothing"]["distinct_count"] == 0
    assert counts["m"]["distinct_count"] == 2  # the order of keys does not matter
    status = {r["column_name"]: r["quality_status"] for r in P.data_quality(odd).collect()}
    assert status["nothing"] == "Critical" and status["g"] == "Needs attention"
    assert status["constant"] == "Good"
    assert P.duplicate_rows(odd.select("g", "x", "m")).head()[0] == 1
    assert P.duplicate_rows(odd.select("constant")).head()[0] == 4


def test_duplicates_of_a_doubled_table(odd):
    doubled = odd.union(odd)
    assert P.duplicate_rows(doubled).head()[0] == 5 + P.duplicate_rows(odd).head()[0]


def test_long_texts_are_told_apart_by_their_end(spark):
    long = "w" * 5000
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",)], "t string")
    assert P.duplicate_rows(df).head()[0] == 1
    assert P.column_counts(df).head()["distinct_count"] == 2


def test_constant_column(odd):
    assert C.corr_pair(odd, "constant", "x").head()[0] is None
    rows = P.histogram(odd, "constant").collect()
    assert [(r["bin"], r["lower"], r["upper"], r["count"]) for r in rows] == [(0, 5.0, 5.0, 5)]
    assert {r["z_score"] for r in O.zscore(odd, "constant").collect()} == {0.0}
    matrix = {(r["row"], r["column"]): r["correlation"] for r in C.corr_matrix(odd).collect()}
    assert matrix[("constant", "constant")] == 0.0 and matrix[("x", "constant")] == 0.0
    assert C.corr_matrix(odd, ["constant"]).head()[:] == ("constant", "constant", 1.0)
    assert C.linear_fit(odd, "constant", "x").head()[0] is None


def test_histogram_counts_every_finite_value(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    for r in (
        P.histograms(df).groupBy("column_name").agg(F.sum("count").alias("n"), F.count("*").alias("b"))
    ).collect():
        assert r["n"] == df.count() and r["b"] == 20
    odd = spark.sql("SELECT explode(array(1D, 2D, double('nan'), double('inf'), null)) AS v")
    assert P.histogram(odd, "v").agg(F.sum("count")).head()[0] == 2


def test_sqrt_bins(spark):
    for n, down, up in ((10, 5, 5), (50, 7, 8), (1000, 12, 12)):
        df = spark.range(n).withColumn("v", F.col("id") * 1.0).select("v")
        assert P.histogram_sqrt_bins(df).count() == down
        assert P.histogram_sqrt_bins(df, round_up=True).count() == up


def test_single_row(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, x double")
    row = P.stat_summary(df, "x").head()
    assert (row["median"], row["q1"], row["stddev"]) == (3.0, 3.0, None)
    assert G.metric_share(df, "g", "x").head()["percentage"] == 100.0
    assert T.trend_change(
        df.select(F.current_date().alias("period"), F.col("x").alias("value"))
    ).count() == 0


def test_shares(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    for shares in (G.record_share(df, "l_suppkey"), G.metric_share(df, "l_suppkey", "l_tax")):
        assert shares.agg(F.sum("percentage")).head()[0] == pytest.approx(100.0)
    zero = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "g string, x double")
    assert [r["percentage"] for r in G.metric_share(zero, "g", "x").collect()] == [0.0, 0.0]
    nothing = spark.createDataFrame([("a", None)], "g string, x double")
    assert G.metric_share(nothing, "g", "x").head()["percentage"] is None


def test_matrix_is_symmetric(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    cells = {(r["row"], r["column"]): r["correlation"] for r in C.corr_matrix(df).collect()}
    size = len(roles.numeric_columns(df))
    assert len(cells) == size * size
    assert all(cells[a, b] == cells[b, a] for a, b in cells)


def test_null_groups(odd):
    assert {r["g"] for r in G.group_count(odd, "g").collect()} == {"a", "b"}
    by = K.kpi_by_group(odd, "g", "profit", "x", "constant").collect()
    assert {r["g"] for r in by} == {"a", "b", None}
    shown = {r["value"]: r["count"] for r in G.category_counts_with_null(odd, "g").collect()}
    assert shown == {"a": 2, "b": 1, "(null)": 2}


def test_division_by_zero_gives_null(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    for f in (A.compare_ratio, A.compare_pct_higher, A.compare_pct_lower, A.compare_pct_diff):
        assert f(df, "a", "b").head()[2] is None
    assert A.compare_abs_diff(df, "a", "b").head()[2] == 0.0
    assert K.kpi_roi(df, "a", "b").head()[0] is None
    assert A.compare_columns(df, ["a", "b"]).where("is_highest").head()["column_name"] == "a"


def test_numbers_in_text(spark, odd):
    got = [r[0] for r in odd.select(E.try_numeric(odd, "text")).collect()]
    assert got == [None, 1000.0, 2.0, 1000.0, None]
    for text, want in [
        (".5", 0.5), ("5.", 5.0), ("1e", None), ("0x10", None), ("1,000", None), ("", None),
        ("1_0.5_1", 10.51), ("1__0", None), ("_1", None), ("1_", None), ("-Infinity", -math.inf),
        ("+inf", math.inf), ("True", None), ("1 2", None), ("\t3\n", 3.0), ("--1", None),
    ]:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(E.try_numeric(df, "t")).head()[0] == want, text
    df = spark.createDataFrame([("nan", True, [1])], "t string, b boolean, a array<int>")
    row = df.select(*[E.try_numeric(df, c).alias(c) for c in df.columns]).head()
    assert math.isnan(row["t"]) and row["b"] == 1.0 and row["a"] is None
    assert df.select(E.try_date(df, "t")).head()[0] is None


def test_dates_need_three_parts(spark):
    df = spark.createDataFrame([("2020",), ("2020-02-30",), (" 2024-05-06 ",)], "t string")
    got = [str(r[0]) for r in df.select(E.try_date(df, "t")).collect()]
    assert got == ["None", "None", "2024-05-06"]


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (9.0, "x")], "`a.b` double, `g``h` string")
    assert G.group_agg(df, "g`h", "a.b", "SUM").head()[:] == ("x", 10.0)
    assert P.data_quality(df).count() == 2 and P.overview(df).head()["row_count"] == 3
    assert A.multi_agg(df, ["a.b", "a.b"], "MAX").columns == ["max_a_b", "max_a_b_2"]
    assert P.histogram(df, "a.b").count() == 20
    assert C.corr_pairs(df.withColumn("c", F.lit(1.0))).count() == 1


def test_roles_of_nested_types_are_not_numeric(spark):
    df = spark.sql(
        "SELECT array(1) AS a, named_struct('i', 1) AS s, map('k', 1) AS m, 1.5BD AS dec,"
        " INTERVAL '1' DAY AS iv, current_timestamp() AS ts, true AS b"
    )
    assert roles.numeric_columns(df) == ["dec"]
    assert roles.datetime_columns(df) == ["ts"]
    assert "ts" in roles.categorical_columns(df)
    assert "ts" not in roles.categorical_columns(df, include_datetime=False)
    assert P.data_quality(df).count() == 7 and P.column_minmax(df).count() == 7
    assert roles.list_columns(df).count() == 7
    assert findings(df).count() >= 3


def test_tables_without_numbers_or_categories(spark):
    words = spark.createDataFrame([("a",), ("b",)], "t string")
    assert P.column_profiles(words).head()["type"] == "categorical"
    assert set(profile_bundle(words)) == {"overview", "columns", "missing", "sample", "categories"}
    numbers = spark.createDataFrame([(1,)], "n int")
    assert P.categorical_columns_for_charts(numbers).count() == 0
    assert "categories" not in profile_bundle(numbers)
    with pytest.raises(ValueError):
        category_charts(numbers)


def test_limits(spark):
    df = spark.range(1000)
    assert S.sample_rows(df, 9999).count() == 1000
    groups = df.select((F.col("id") % 300).alias("g"), "id")
    assert G.top_n_groups(groups, "g", "id", "SUM", 1000).count() == 300
    assert G.bottom_n_groups(groups, "g", "id", "MIN", 1).head()["g"] == 0
    for wrong in (
        lambda: S.sample_rows(df, 0),
        lambda: G.top_n_groups(groups, "g", "id", "SUM", 0),
        lambda: T.normalized_series(df, "id", []),
    ):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        S.filter_rows(df, [])
    with pytest.raises(ValueError):
        A.scalar_agg(df, "id", "MODE")


def test_text_helpers(spark):
    def run(f, text):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(f(F.col("t"))).head()[0]

    assert run(strip_space, "  \t a b　\n") == "a b"
    assert run(normalize_text, "  Data_Science--Mark X ") == "data science mark x"
    assert run(lambda c: shorten(c, 16), "x" * 16) == "x" * 16
    assert run(lambda c: shorten(c, 16), "x" * 17) == "x" * 15 + "..."
    assert run(repair_mojibake, "  Itâ€™s  fine .") == "It's fine."
    assert run(repair_mojibake, "A â€¦â€ South") == "A... South"
    assert run(repair_mojibake, "café über") == "café über"
    assert run(repair_mojibake, None) is None


def test_normalized_series_is_flat_for_a_constant(spark):
    df = spark.sql("SELECT date_add(DATE '2024-01-01', int(id)) AS d, 2 AS x, id AS y FROM range(3)")
    rows = T.normalized_series(df, "d", ["x", "y"]).collect()
    assert sorted(r["normalized"] for r in rows if r["metric"] == "x") == [0.0, 0.0, 0.0]
    assert sorted(r["normalized"] for r in rows if r["metric"] == "y") == [0.0, 0.5, 1.0]


def test_trend_directions(spark):
    def change(a, b):
        df = spark.createDataFrame([(1, a), (2, 55.0), (3, b)], "period int, value double")
        return T.trend_change(df).head()["direction"]

    assert change(100.0, 101.0) == "stable" and change(100.0, 102.0) == "increased"
    assert change(-100.0, -102.0) == "decreased" and change(0.0, 5.0) is None


def test_duplicates_like_a_plain_group(spark):
    rows = [
        ("a", 0.0, float("nan"), [1.0, -0.0], (1, None), b"x", {"k": 1, "l": 2}),
        ("a", -0.0, float("nan"), [1.0, 0.0], (1, None), b"x", {"l": 2, "k": 1}),
        ("a", 0.0, None, [1.0, 0.0], (1, None), b"x", {"k": 1}),
        ("a", 0.0, None, [1.0, 0.0], (None, "1"), b"x", {"k": 1}),
        (None, 0.0, None, [1.0, 0.0], (1, None), b"x", {"k": 1}),
        ("", 0.0, None, [1.0, 0.0], (1, None), b"x", {"k": 1}),
        ("", 0.0, None, [1.0], None, None, None),
        ("", 0.0, None, [1.0, None], None, None, None),
        ("1:a", 1.0, None, [], None, None, {}),
        ("1:a", 1.0, None, [], None, None, {}),
    ]
    df = spark.createDataFrame(
        rows, "s string, d double, n double, a array<double>, t struct<x:int,y:string>, b binary, m map<string,int>"
    )
    plain = df.withColumn("m", F.array_sort(F.map_entries("m")))
    want = len(rows) - plain.groupBy(*plain.columns).count().count()
    out = P.overview(df).head()
    assert out["duplicate_rows"] == want == 2
    assert out["total_missing_cells"] == sum(v is None for r in rows for v in r)


def test_rows_travel_as_digests(spark, folder):
    df = P.duplicate_rows(spark.read.parquet(f"{folder}/embeddings.parquet"))
    text = df._jdf.queryExecution().executedPlan().toString()
    exchange = next(x for x in text.splitlines() if "hashpartitioning" in x)
    assert "embedding" not in exchange


def test_correlations_of_many_columns_take_one_scan(spark, tmp_path):
    wide = spark.range(200).select(*[F.when(F.col("id") % (i + 2) != 0, F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(100)])
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    pairs = C.corr_pairs(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    table = df.toPandas()
    want = table.corr()
    rows = pairs.collect()
    assert len(rows) == 4950
    for r in rows[::97]:
        assert r["correlation"] == pytest.approx(want.loc[r["column_x"], r["column_y"]], abs=1e-9)


def test_columns_without_values_have_no_correlation(spark):
    df = spark.sql("SELECT id AS a, CAST(NULL AS INT) AS b, id * 2 AS c FROM range(5)")
    assert [tuple(r)[2] for r in C.corr_pairs(df).orderBy("column_x", "column_y").collect()] == [None, pytest.approx(1.0), None]
    matrix = {(r["row"], r["column"]): r["correlation"] for r in C.corr_matrix(df).collect()}
    assert (len(matrix), matrix["a", "c"], matrix["b", "b"]) == (9, 1.0, 0.0)
