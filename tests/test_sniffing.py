"""Types of delimited text from all its values, and the cells and rows that do not fit."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftframe.sources import sniffing


@pytest.fixture
def file(tmp_path):
    def write(*lines, name="t.csv"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    return write


def kinds(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return sniffing.sniff_types(df).head()["type"]


def test_the_lattice(spark):
    cases = {
        ("1", "-2", "+3", " 4 ", None, ""): "bigint",
        ("0", "10", "007"): "string",
        ("-007",): "string",
        ("0.5", "1", "1e3", ".5", "2."): "double",
        ("007.5", "1"): "string",
        ("true", "False"): "boolean",
        ("true", "1"): "string",
        ("2024-02-29", "1999-12-31"): "date",
        ("2024-02-30", "1999-12-31"): "string",
        ("2024-02-29", "2024-02-29 10:11", "2024-02-29T10:11:12.5"): "timestamp_ntz",
        ("2024-02-29", "5"): "string",
        ("9223372036854775807",): "bigint",
        ("9223372036854775808",): "string",
        ("1d", "1"): "string",
        ("1_000",): "string",
        ("NaN", "1.5"): "string",
        (None, " "): "string",
    }
    for values, want in cases.items():
        assert kinds(spark, *values) == want, values


def test_codes_and_late_failures(spark, file):
    lines = [f"{i:03d},{i},{i / 2}" for i in range(3000)] + ["x1,late,2.5"]
    path = file("code,number,half", *lines)
    strict = sniffing.load_delimited(spark, path)
    assert strict.types == {"code": "string", "number": "string", "half": "double"}
    assert strict.rejects.collect() == []
    loose = sniffing.load_delimited(spark, path, tolerance=0.01)
    assert loose.types == {"code": "string", "number": "bigint", "half": "double"}
    assert [tuple(r)[1:] for r in loose.rejects.collect()] == [("number", "late", "not a bigint")]
    rows = loose.table.collect()
    assert len(rows) == 3001 and rows[7][:] == ("007", 7, 3.5) and rows[-1][:] == ("x1", None, 2.5)


def test_rows_with_the_wrong_number_of_fields(spark, file):
    path = file("a,b", "1,x", "2", "3,y,z", '4,"p,q"', ",")
    got = sniffing.load_delimited(spark, path, position="where")
    assert got.types == {"a": "bigint", "b": "string"}
    rows = got.table.orderBy("where").collect()
    assert [r[:2] for r in rows] == [(1, "x"), (4, "p,q"), (None, None)]
    listed = got.rejects.orderBy("position").collect()
    assert [tuple(r)[1:] for r in listed] == [
        (None, "2", sniffing.WRONG_FIELDS),
        (None, "3,y,z", sniffing.WRONG_FIELDS),
    ]
    assert rows[0]["where"] < listed[0]["position"] < listed[1]["position"] < rows[1]["where"]


def test_a_given_schema(spark, file):
    path = file("id,when,ok,n", "007,2024-01-02,TRUE,1", "x,2024-13-01,yes,2")
    got = sniffing.load_delimited(spark, path, schema={"id": "int", "when": "date", "ok": "boolean"}, position="p")
    assert [f.dataType.simpleString() for f in got.table.schema][:4] == ["int", "date", "boolean", "string"]
    rows = got.table.orderBy("p").collect()
    assert [r[:4] for r in rows] == [(7, datetime.date(2024, 1, 2), True, "1"), (None, None, None, "2")]
    bad = got.rejects.join(got.table.select("p"), F.col("p") == F.col("position"))
    assert sorted(tuple(r)[1:4] for r in bad.collect()) == [
        ("id", "x", "not a int"),
        ("ok", "yes", "not a boolean"),
        ("when", "2024-13-01", "not a date"),
    ]
    with pytest.raises(ValueError, match="no column zz"):
        sniffing.load_delimited(spark, path, schema={"zz": "int"})


def test_repeated_names_line_breaks_and_no_rows(spark, file):
    path = file("a,A,_at_", '1,"two\nlines",3', name="m.csv")
    got = sniffing.load_delimited(spark, path, multi_line=True)
    assert got.table.columns == ["a", "A_1", "_at_"]
    assert got.table.head()[:] == (1, "two\nlines", 3)
    none = sniffing.load_delimited(spark, file("a\tb", name="e.tsv"), sep="\t")
    assert none.types == {"a": "string", "b": "string"} and none.table.count() == none.rejects.count() == 0
    with pytest.raises(ValueError, match="tolerance"):
        sniffing.load_delimited(spark, path, tolerance=1.0)
