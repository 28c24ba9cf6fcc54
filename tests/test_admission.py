"""Statements that the read-only operator runs, and those it refuses by their plan."""

import pytest
from pyspark.sql import functions as F

from siftframe.operators.selection import readonly_sql


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.array("id").alias("a"))


REFUSED = {
    "SELECT count(*) FROM main_table x, main_table y": "equality",
    "SELECT count(*) FROM main_table x CROSS JOIN main_table y": "equality",
    "SELECT count(*) FROM main_table x JOIN main_table y ON x.id < y.id": "equality",
    "SELECT count(*) FROM main_table x LEFT JOIN main_table y ON x.id + y.id > 3": "equality",
    "SELECT * FROM main_table x WHERE EXISTS (SELECT 1 FROM main_table y WHERE y.id < x.id)": "equality",
    "SELECT explode(sequence(1, 1000000)) FROM main_table": "sequence",
    "SELECT explode(sequence(1, id)) FROM main_table": "sequence",
    "SELECT explode(array_repeat(g, cast(id AS int))) FROM main_table": "sequence",
    "SELECT repeat('x', 1000000000) FROM main_table": "sequence",
    "SELECT count(*) FROM (SELECT explode(sequence(1, 500000)) FROM main_table LIMIT 1)": "sequence",
    "SELECT * FROM range(1000000) r JOIN main_table m ON r.id = m.id": "number table",
    "WITH big AS (SELECT * FROM main_table a, main_table b) SELECT max(1) FROM big": "equality",
}
ACCEPTED = {
    "SELECT count(*) FROM main_table x JOIN main_table y ON x.id = y.id AND x.g <= y.g": 1,
    "SELECT * FROM main_table x, main_table y WHERE x.id = y.g": 500,
    "SELECT * FROM main_table, (SELECT avg(id) AS m FROM main_table) WHERE id > m": 250,
    "SELECT * FROM main_table WHERE id > (SELECT avg(id) FROM main_table)": 250,
    "SELECT * FROM main_table x, (SELECT DISTINCT g FROM main_table LIMIT 3) y": 1500,
    "SELECT * FROM main_table WHERE g NOT IN (SELECT g FROM main_table WHERE g > 3)": None,
    "SELECT * FROM main_table x WHERE EXISTS (SELECT 1 FROM main_table y WHERE y.id = x.g)": 500,
    "SELECT explode(a) FROM main_table": 500,
    "SELECT explode(sequence(1, 3)) FROM main_table": 1500,
    "SELECT m.id FROM range(100) r JOIN main_table m ON r.id = m.id": 100,
    "SELECT repeat('ab', 3) FROM main_table": 500,
}


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(df, sql):
    with pytest.raises(ValueError, match=REFUSED[sql]):
        readonly_sql(df, sql)


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(df, sql):
    rows = readonly_sql(df, sql).count()
    assert ACCEPTED[sql] is None or rows == ACCEPTED[sql]


def test_parameters(df):
    product = "SELECT x.id FROM main_table x, (SELECT * FROM main_table LIMIT 20) y"
    assert readonly_sql(df, product).count() == 10_000
    with pytest.raises(ValueError, match="equality"):
        readonly_sql(df, product, side_rows=10)
    assert readonly_sql(df, product, side_rows=10_000, max_rows=7).count() == 7
    assert readonly_sql(df, "SELECT count(*) AS n FROM main_table a, main_table b", side_rows=None).head()["n"] == 250_000
    assert readonly_sql(df, "SELECT explode(sequence(1, id)) AS x FROM main_table", generated=float("inf")).count() > 100_000


def test_how_the_table_was_made_plays_no_part(spark):
    pairs = spark.range(300).crossJoin(spark.range(400).withColumnRenamed("id", "k"))
    assert readonly_sql(pairs, "SELECT count(*) AS n FROM main_table").head()["n"] == 120_000
    assert readonly_sql(spark.range(200_000), "SELECT max(id) AS m FROM main_table").head()["m"] == 199_999
    with pytest.raises(ValueError, match="equality"):
        readonly_sql(spark.range(0), "SELECT 1 FROM main_table a, main_table b")
