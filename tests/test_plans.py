"""What the plans of the registered queries may and may not contain."""

import re

import pytest

from siftframe.operators import grouping as G
from siftframe.operators import profiling as P
from siftframe.operators import selection as S
from siftframe.plans.catalog import QUERIES

WRITERS = {"read_csv", "read_tsv", "persist_dataset", "open_dataset"}  # write before they read


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_cross_joins_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "MapInArrow"):
        assert operator not in text


def test_only_needed_columns_are_read(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = plan(G.top_n_groups(df, "l_suppkey", "l_extendedprice", "SUM", 10))
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in text
    assert "TakeOrderedAndProject" in text


def test_filters_reach_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = plan(S.filter_count(df, [("l_quantity", ">=", 45)]))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in text
    assert "ReadSchema: struct<l_quantity:double>" in text


def test_profiles_take_a_fixed_number_of_scans(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert len(re.findall("FileScan", plan(P.overview(df)))) == 1
    assert len(re.findall("FileScan", plan(P.data_quality(df)))) == 1
    assert len(re.findall("FileScan", plan(P.histograms(df)))) == 3
    assert len(re.findall("FileScan", plan(P.column_profiles(df, method="builtin")))) == 2
