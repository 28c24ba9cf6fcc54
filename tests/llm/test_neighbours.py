import numpy as np
import pytest
from pyspark.sql import functions as F

from siftframe.llm import neighbours
from siftframe.llm.queries import op5_neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, ask, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows]
    out = {}
    for q, v in good:
        if ask(q):
            ranked = sorted((-float(w @ v), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_recall_of_the_query(spark, folder):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, have = brute(rows, lambda i: i % 20 == 0, 20), got(op5_neighbours(spark, folder))
    assert want.keys() == have.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {(q, i): s for q in have for i, s in have[q]}
    by_id = dict(rows)
    for (q, i), s in scores.items():
        assert s == pytest.approx(float(np.array(by_id[q], float) @ np.array(by_id[i], float)), abs=1e-12)


def test_clusters_copies_and_lengths(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] * (1 + i % 3) + 0.1 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(300)]  # a third are copies
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    want, have = brute(rows, lambda i: i % 50 == 0, 20), got(neighbours.nearest(df, F.col("vec_id") % 50 == 0))
    assert want.keys() == have.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [i for i, _ in have[0]] == [i for i, _ in want[0]]


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1),
        (1, [1.0, 0.0], 1),
        (2, [0.5, 0.5], 1),
        (3, None, 1),
        (4, [0.0, 0.0], 1),
        (5, [1.0, None], 1),
        (6, [float("nan"), 1.0], 1),
        (7, [float("inf"), 1.0], 1),
        (8, [], 1),
        (9, [1.0, 2.0, 3.0], 1),
        (None, [1.0, 0.0], 1),
        (10, [-1.0, 0.0], 1),
        (10, [-1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "vec")
    out = got(neighbours.nearest(df, F.col("vec_id") == 0))
    assert out == {0: [(1, 1.0), (2, 0.5), (10, -1.0), (10, -1.0)]}
    out = got(neighbours.nearest(df, F.col("vec_id") == 2, k=2))
    assert out == {2: [(0, 0.5), (1, 0.5)]}
    assert neighbours.nearest(df, F.col("vec_id") == 3).count() == 0
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_repeated_query_rows(spark, alike):
    """Rows with the id of the query take no places of others, be their vectors equal or only close."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).round(3).tolist(), 0) for i in range(3, 203)]
    for q, times in ((1, 2), (2, 30)):
        own = (10 * rng.normal(size=8)).round(3)
        rows += [(q, (own if alike else own + 0.001 * n).tolist(), 0) for n in range(times)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    out = neighbours.nearest(df, F.col("vec_id") < 3).collect()
    for q, times in ((1, 2), (2, 30)):
        assert sorted(r["rank"] for r in out if r["query_id"] == q) == sorted(list(range(1, 21)) * times)
        assert all(r["vec_id"] != q for r in out if r["query_id"] == q)
    own = np.array(next(v for i, v, _ in rows if i == 2))
    if alike:
        want = [i for _, i in sorted((-float(own @ np.array(v)), i) for i, v, _ in rows if i != 2)[:20]]
        have = {r["rank"]: r["vec_id"] for r in out if r["query_id"] == 2}
        assert len(set(have.values()) & set(want)) >= 18


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2**16, (400, 4)).astype(np.uint16)
    codes[:50] = codes[0] ^ (rng.integers(0, 2, (50, 4)) << rng.integers(0, 16, (50, 4))).astype(np.uint16)
    index = neighbours.MultiIndex(codes)
    apart = neighbours.distances(codes[:20], codes)
    for radius in (0, 1, 3, 7, 20, 31, 64):
        for q in range(20):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(apart[q] <= radius).tolist()
