"""Forecasts of many series at once, against a least-squares solver."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftframe.operators import timeseries as T

START = datetime.date(2024, 1, 3)


def series(rng, days, gaps):
    rows = []
    for d in range(days):
        if d in (0, days - 1) or rng.random() > gaps:
            rows.append((d, 10 + 0.7 * d + 5 * (d % 7 == 2) + rng.normal()))
    return rows


def solved(rows, horizon, weekday):
    """rows: (day number, value), one per day with values"""
    last = max(d for d, _ in rows)
    y = np.zeros(last + 1)
    for d, v in rows:
        y[d] += v
    t = np.arange(last + 1)
    if weekday and last + 1 >= 14:
        form = lambda t: np.column_stack([t, *[(t % 7 == w).astype(float) for w in range(7)]])
    elif last == 0:
        return y, np.full(horizon, y[0])
    else:
        form = lambda t: np.column_stack([t, np.ones(len(t))])
    x, *_ = np.linalg.lstsq(form(t.astype(float)), y, rcond=None)
    return y, form(np.arange(last + 1, last + 1 + horizon).astype(float)) @ x


@pytest.mark.parametrize("weekday", [False, True])
def test_every_group_gets_its_own_line(spark, weekday):
    rng = np.random.default_rng(5)
    groups = {"long": series(rng, 90, 0.3), "short": series(rng, 9, 0.2), None: series(rng, 14, 0.5), "one": [(0, 4.0)], "gap": [(0, 1.0), (40, 3.0)]}
    rows = [(g, START + datetime.timedelta(days=d), v / 2) for g, some in groups.items() for d, v in some for _ in range(2)]
    rows += [("long", None, 5.0), ("long", START, None)]
    df = spark.createDataFrame(rows, "g string, d date, v double").repartition(6)
    out = {}
    for r in T.forecast_groups(df, "d", "v", ["g"], 9, weekday).collect():
        out.setdefault(r["g"], {})[(r["x"] - START).days] = (r["y"], r["forecast"])
    assert out.keys() == groups.keys()
    for g, some in groups.items():
        y, ahead = solved(some, 9, weekday)
        assert sorted(out[g]) == list(range(len(y) + 9))
        assert [out[g][d][0] for d in range(len(y))] == pytest.approx(y.tolist())
        assert [out[g][len(y) + d][1] for d in range(9)] == pytest.approx(ahead.tolist(), abs=1e-6), g
        assert all(out[g][d][1] is None for d in range(len(y)))


def test_two_keys_no_rows_and_bad_arguments(spark):
    df = spark.sql("SELECT 'a' AS k, 1 AS n, DATE '2024-01-01' + CAST(id AS INT) AS x, id AS y FROM range(10)")
    out = T.forecast_groups(df, "x", "y", ["k", "n"], 7)
    assert out.columns == ["k", "n", "x", "y", "forecast"] and out.count() == 17
    assert T.forecast_groups(df.where("false"), "x", "y", ["k"]).collect() == []
    with pytest.raises(ValueError):
        T.forecast_groups(df, "x", "y", ["k"], 0)
    with pytest.raises(ValueError):
        T.forecast_groups(df, "x", "y", [])
    assert T.forecast_groups(df, "x", "y", ["k"]).where(F.col("forecast").isNotNull()).count() == 7
