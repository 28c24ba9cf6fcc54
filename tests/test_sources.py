"""Readers, clean-up, storage and read-only SQL."""

import pytest
from pyspark.sql import functions as F

from siftframe.operators.selection import clean_sql, is_read_only, readonly_sql
from siftframe.sources import cleaning, files, scratch, store


@pytest.fixture
def place(tmp_path):
    return tmp_path


def test_csv_types_and_names(spark, place):
    (place / "t.csv").write_text('x,x, a  b ,,day,note\n1,2.5,7,q,2024-01-02,"a, ""b"""\n2,3,8,,2024-01-03,\n')
    df = files.read_dataset(spark, str(place / "t.csv"))
    assert df.columns == ["x", "x_1", "a b", "Unnamed", "day", "note"]
    assert [t for _, t in df.dtypes] == ["bigint", "double", "bigint", "string", "date", "string"]
    assert df.orderBy("x").head()["note"] == 'a, "b"'


def test_tsv_and_given_schema(spark, place):
    (place / "t.tsv").write_text("a\tb\n1\tx,y\n")
    df = files.read_dataset(spark, str(place / "t.tsv"))
    assert df.head()[:] == (1, "x,y")
    typed = files.read_tsv(spark, str(place / "t.tsv"), "a double, b string")
    assert typed.head()[0] == 1.0
    with pytest.raises(ValueError):
        files.read_dataset(spark, "t.xlsx")


def test_messy_sheet(spark, place):
    (place / "m.csv").write_text(
        "Village report,,,,\n,,,,\n S No ,Name, Name ,Empty,Score\n"
        "1, Ann ,x,,10\n,,,,\nS No,Name,Name,,Score\n2,Bob,y,,11\n3,Cy,z,,12\n4,Di,w,,13\n5,Ed,v,,n/a\n"
    )
    raw = spark.read.csv(str(place / "m.csv"), header=False)
    df = cleaning.clean_table(files.with_row_position(raw), "_position")
    assert df.columns == ["S No", "Name", "Name_1", "Score"]
    assert dict(df.dtypes) == {"S No": "double", "Name": "string", "Name_1": "string", "Score": "double"}
    rows = df.orderBy("S No").collect()
    assert [r["S No"] for r in rows] == [1, 2, 3, 4, 5] and rows[0]["Name"] == "Ann"
    assert [r["Score"] for r in rows] == [10, 11, 12, 13, None]


def test_header_falls_back_to_the_first_row(spark):
    df = spark.createDataFrame([(0, "k", "v"), (1, "a", "b")], "at int, x string, y string")
    out = cleaning.promote_header(df, "at")
    assert out.columns == ["k", "v"] and out.count() == 1


def test_numeric_share_of_four_fifths(spark):
    def kind(good):
        rows = [(str(i),) if i < good else ("bad",) for i in range(100)] + [(None,)]
        return dict(cleaning.coerce_mostly_numeric(spark.createDataFrame(rows, "c string")).dtypes)["c"]

    assert [kind(79), kind(80), kind(81)] == ["string", "double", "double"]
    empty = spark.createDataFrame([(None,)], "c string")
    assert cleaning.coerce_mostly_numeric(empty).dtypes == [("c", "string")]


def test_header_marks(spark):
    df = spark.createDataFrame([(i, "x" if i < 40 else "Key", "v") for i in range(50)], "at int, x string, y string")
    assert cleaning.promote_header(df, "at", mark="key", search_rows=50).columns == ["Key", "v"]
    with pytest.raises(ValueError, match="key"):
        cleaning.promote_header(df, "at", mark="key")
    with pytest.raises(ValueError):
        cleaning.promote_header(df, "at", search_rows=0)


@pytest.mark.parametrize("text", ['id,t\n1,"a\nb"\n', "id,t\n1,2,3\n", "id,t\n1\n"])
def test_broken_rows_are_errors(spark, place, text):
    (place / "b.csv").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_csv(spark, str(place / "b.csv"), "id bigint, t string").collect()


def test_quoted_line_breaks_and_clashing_names(spark, place):
    (place / "q.csv").write_text('ID,id,a,a,a_1\n1,2,"x\ny",,"say ""z"""\n')
    df = files.read_csv(spark, str(place / "q.csv"), multi_line=True)
    assert df.columns == ["ID", "id_1", "a", "a_2", "a_1"]
    assert df.head()[:] == (1, 2, "x\ny", None, 'say "z"')


def test_a_schema_must_fit_the_header(spark, place):
    (place / "s.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(place / "s.csv"), "a int, b int").collect()
    df = files.read_csv(spark, str(place / "s.csv"), "b int, a int")
    assert df.dtypes == [("b", "bigint"), ("a", "bigint")]


def test_names_stay_unique_without_case():
    assert files.unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert files.unique_names(["ID", "id", "Id"]) == ["ID", "id_1", "Id_2"]


def test_unique_names():
    assert files.unique_names([" a ", "a", None, "a\n b", ""]) == ["a", "a_1", "Unnamed", "a b", "Unnamed_1"]


def test_store_keeps_the_last_complete_version(spark, place):
    root = str(place)
    with pytest.raises(KeyError):
        store.open_dataset(spark, root, "none")
    store.persist_dataset(spark.range(5), root, "d", "five.csv")
    second = store.persist_dataset(spark.range(7), root, "d", "seven.csv")
    assert second.table.count() == 7
    # A write that never reached its metadata row changes nothing.
    spark.range(1000).write.parquet(f"{root}/d/data/unfinished")
    again = store.open_dataset(spark, root, "d")
    assert again.filename == "seven.csv" and again.table.count() == 7
    assert again.metadata.head()[:] == ("d", "seven.csv", 7) and again.columns == ["id"]
    with pytest.raises(ValueError):
        store.open_dataset(spark, root, "../d")
    store.persist_dataset(spark.range(2), root, "d", "two.csv")
    assert store.vacuum(spark, root, "d", keep=2) == 1
    assert store.vacuum(spark, root, "d") == 1
    assert store.open_dataset(spark, root, "d").filename == "two.csv"
    # A version that another writer has taken already is not overwritten.
    spark.range(1).write.parquet(f"{root}/d/metadata/000000000004")
    with pytest.raises(Exception, match="(?i)exists"):
        store.persist_dataset(spark.range(9), root, "d", "nine.csv")
    with pytest.raises(ValueError):
        store.vacuum(spark, root, "d", keep=0)


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_root", lambda _: str(tmp_path))
    spark.range(1).write.parquet(scratch.scratch_path(spark, "x"))
    assert len(list(tmp_path.glob("siftframe/*/x-*"))) == 1
    scratch.clear_scratch(spark)
    assert not list(tmp_path.glob("siftframe/*"))


def test_read_only_guard(spark):
    df = spark.range(10).withColumn("load", F.col("id") * 2)
    assert readonly_sql(df, "SELECT SUM(`load`) AS s FROM main_table;").head()["s"] == 90
    assert readonly_sql(df, "SELECT 'drop table x' AS t FROM main_table -- delete").count() == 10
    assert clean_sql("Sure:\n```sql\nSELECT 1;\n```") == "SELECT 1"
    assert clean_sql("Here is the query with totals:\nSELECT 1") == "SELECT 1"
    assert is_read_only("with a as (select 1) select * from a")
    assert readonly_sql(df, "SELECT load FROM main_table ORDER BY id DESC LIMIT 1").head()[0] == 18
    nested = "WITH a AS (SELECT * FROM main_table), b AS (SELECT id FROM a) SELECT * FROM b WHERE id IN (SELECT id FROM a WHERE load > 10)"
    assert readonly_sql(df, nested).count() == 4
    spark.range(3).createOrReplaceTempView("main_table")
    spark.range(3).createOrReplaceTempView("other")
    try:
        assert readonly_sql(df, "SELECT * FROM main_table").count() == 10
        assert spark.table("main_table").count() == 3
        for bad in (
            "SELECT * FROM other",
            "SELECT * FROM main_table WHERE id IN (SELECT id FROM other)",
            "SELECT (SELECT max(id) FROM other)",
            "SELECT * FROM (WITH other AS (SELECT 1 AS id) SELECT * FROM other) JOIN other USING (id)",
            "WITH other AS (SELECT * FROM other) SELECT * FROM other",
        ):
            assert not is_read_only(bad), bad
    finally:
        spark.catalog.dropTempView("main_table")
        spark.catalog.dropTempView("other")
    for bad in (
        "DROP TABLE main_table",
        "SELECT 1; DELETE FROM main_table",
        "WITH x AS (SELECT 1) INSERT INTO main_table SELECT * FROM x",
        "SELECT * FROM csv.`/etc/passwd`",
        "SELECT * FROM `text`.`/etc/passwd`",
        "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM main_table WHERE Try_Reflect('java.lang.System', 'x') IS NULL",
        "",
    ):
        assert not is_read_only(bad), bad
        with pytest.raises(ValueError):
            readonly_sql(df, bad)
