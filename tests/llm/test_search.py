import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftframe.llm import search

SCHEMA = "vec_id bigint, embedding array<double>, query_id string, score string"


def frame(spark, rows):
    """Rows (id, vector) beside columns whose names clash with those of the result."""
    return spark.createDataFrame([(i, v, "q", "s") for i, v in rows], SCHEMA)


def brute(rows, every, k):
    good = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)
    ]
    out = []
    for n, (q, ask) in enumerate(good):
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(ask, v, strict=False)), i) for m, (i, v) in enumerate(good) if m != n]
        scored.sort(key=lambda s: (s[0], s[1] is None, s[1] or 0))
        clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        out += [(q, r, i, clip(-s)) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, every=5, k=5, **sizes):
    df = search.top_k(frame(spark, rows), F.col("vec_id") % every == 0, k, **sizes)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("blocks", [(8192, 2048), (64, 16)])
def test_same_as_brute_force(spark, blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=24)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(200)]  # a third are copies
    sizes = {"block_rows": blocks[0], "block_queries": blocks[1]}
    assert got(spark, rows, **sizes) == brute(rows, 5, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]),
        (0, [1.0, 0.5]),  # the query twice
        (5, [-1.0, -0.001]),
        (1, [1.0, 0.5]),
        (None, [1.0, 0.5]),  # a tie without an id comes last
        (2, [0.001, -0.001, 7.0]),
        (3, []),
        (4, None),
        (6, [1.0, None]),
        (7, [nan, 1.0]),
        (10, [inf, 1.0]),
        (15, [0.0, 0.0]),
        (20, []),
        (25, [1e308, 1.0]),
    ]
    assert got(spark, rows) == brute(rows, 5, 5)
    assert got(spark, rows, k=1) == brute(rows, 5, 1)
    assert got(spark, rows, k=50) == brute(rows, 5, 50)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [3e12, 1.0]), (1, [3e12, 1.0]), (2, [2.9e12, 4e11]), (3, [-3e300, 1.0]), (4, [1e9, 0.1]), (5, [0.5, 1.0])]
    assert got(spark, rows) == brute(rows, 5, 5)
    near = [(i, [2.0**20 + i / 256, 2.0**20 - i / 512, 1.0 + i]) for i in range(12)]
    assert got(spark, near) == brute(near, 5, 5)


def test_a_query_that_is_stored_often(spark):
    rows = [(0, [1.0, 2.0])] * 30 + [(1, [5.0, 5.0])] * 2 + [(i, [0.1 * i, 0.1]) for i in range(2, 9)]
    assert got(spark, rows) == brute(rows, 5, 5)


def test_few_and_no_rows(spark):
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0]), (5, [2.0])]) == brute([(0, [1.0]), (5, [2.0])], 5, 5)


def test_bound_gives_up_rows_and_keeps_the_best():
    rng = np.random.default_rng(5)
    scale = np.repeat([200.0, 20.0, 4.0, 1.0], 8)
    rows = np.floor(rng.normal(size=(3000, 32)) * scale)
    asks = rows[:40]
    best = search.Best(5, np.full(40, -np.inf), np.full(40, search._LAST_ID))
    search._search(rows, asks, np.arange(3000), np.arange(40), best)
    exact = asks @ rows.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    want = np.sort(exact, axis=1)[:, ::-1][:, :5]
    assert (best.found.reshape(40, 5) == want).all()
    order = np.argsort(-np.einsum("ij,ij->j", rows, rows))
    query, _, _ = search._survivors(search.Vertical(rows, order), search.Vertical(asks, order), want[:, 4])
    assert len(query) <= 40 * 12
