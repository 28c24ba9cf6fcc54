import random
import re

import numpy as np
import pytest
from conftest import AWKWARD

from siftframe.llm import near
from siftframe.llm.text import WORD_PATTERN

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """(id, class, links) of rows of (id, text), by all pairs."""
    rows = [r for r in rows if r[0] is not None]
    sets = []
    for _, text in rows:
        w = re.findall(WORD_PATTERN, (text or "").translate(LOWER))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links = [
        {j for j in range(len(rows)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        for i in range(len(rows))
    ]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in links[i])]) for i in range(len(rows))]
    return sorted((rows[i][0], low[i], len(links[i])) for i in range(len(rows)))


def edited(words, rng, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def family(seed, groups, size, most, base=120):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        words = [f"v{rng.randrange(4000)}" for _ in range(base)]
        for _ in range(size):
            rows.append((n, " ".join(edited(words, rng, rng.randrange(most)))))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf_size", [1024, 8])
def test_all_links_are_found(docs_of, leaf_size):
    rows = family(1, 12, 14, 8)
    out = near.near_copies(docs_of(rows), recall=0.999999, leaf_size=leaf_size).collect()
    assert sorted(map(tuple, out)) == brute(rows)


def test_large_groups_are_compared_in_blocks(docs_of):
    rows = family(2, 1, 90, 3)
    out = near.near_copies(docs_of(rows), recall=0.999, leaf_size=16).collect()
    assert sorted(map(tuple, out)) == brute(rows)


def test_sets_the_first_runs_leave_get_further_ones(docs_of, monkeypatch):
    # A passage in all texts leads every run deep: 6 runs are too few for any of these sets.
    monkeypatch.setattr(near, "FIRST_RUNS", 6)
    rng, passage = random.Random(5), [f"p{i}" for i in range(100)]
    rows = [(i, " ".join(edited(w, rng, 2))) for i, w in enumerate(
        [f"u{rng.randrange(10**9)}" for _ in range(60)] + passage for _ in range(40))]
    rows += [(100 + i, " ".join(edited(t.split(), rng, 1))) for i, t in rows]
    out = near.near_copies(docs_of(rows), recall=0.999, leaf_size=4).collect()
    assert sorted(map(tuple, out)) == brute(rows)


def test_runs_and_depths_reach_the_recall():
    for similarity, recall, runs in [(0.8, 0.999, 48), (0.8, 0.999999, 48), (0.5, 0.9, 12)]:
        depth = near.depth_for(similarity, recall, runs)
        assert (1 - similarity**depth) ** runs <= 1 - recall + 1e-12 < (1 - similarity ** (depth + 1)) ** runs
    assert near.depth_for(0.8, 0.999, 3) == 0
    assert near.depth_for(1.0, 0.999, 6) == 16
    assert near.least_equal(0.8) == 34 and near.least_equal(1.0) == 64


def test_a_hot_node_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(near, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(bytes([i]), 1 if i < 50 else i) for i in range(70)] + [(bytes([9]), 69)], "key binary, path bigint")
    got = {(bytes(r["key"])[0], r["path"]): r["n"] for r in near._with_counts(rows, 2).collect()}
    assert got == {(i, 1): 50 for i in range(50)} | {(69, 69): 2, (9, 69): 2}


def test_too_low_a_similarity_is_refused(docs_of):
    with pytest.raises(ValueError, match="runs"):
        near.near_copies(docs_of([(1, "a b"), (2, "c d")]), similarity=0.05)


def test_shared_passages_are_no_links(docs_of):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(60)] + passage)) for i in range(60)]
    assert {tuple(r)[1:] for r in near.near_copies(docs_of(rows), leaf_size=8).select("doc_id", "n_links").collect()} == {(0,)}


def test_awkward_rows(docs_of):
    docs = docs_of(AWKWARD).withColumnRenamed("source", "key").withColumnRenamed("lang", "marks")
    out = sorted(tuple(r) for r in near.near_copies(docs).collect() if r["doc_id"] is not None)
    assert out == brute(AWKWARD)
    nameless = near.near_copies(docs).where("doc_id IS NULL").collect()
    assert [tuple(r) for r in nameless] == [(None, None, 0)]
    assert near.near_copies(docs_of([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in near.components(df, "a", "b").collect()}
    assert {labels[i] for i in range(41)} == {0}
    assert {labels[i] for i in range(100, 140)} == {100}
    assert labels[200] == labels[199] == 199


def test_least_hashes_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = np.mean(near.least_hashes(a) == near.least_hashes(b))
    assert 0.6 < same < 0.97


def test_one_row_of_each_class_stays(spark, docs_of):
    a, b, c = ("one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta", "un deux trois quatre cinq six sept huit")
    rows = [(3, b), (5, a), (5, b.upper()), (5, a), (7, c), (7, c + "."), (8, ""), (8, None), (8, ""), (9, a), (None, a), (None, a)]
    docs = docs_of(rows).withColumnRenamed("lang", "row").withColumnRenamed("source", "digest")
    out = near.drop_copies(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    # Of 5, the text that is a copy of 3 goes and the other one stays; of 7, one of two that are alike.
    seven = [r for r in got if r[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (c, c + ".")
    assert [r for r in got if r[0] != 7] == sorted([(3, b), (5, a), (8, ""), (8, None), (None, a), (None, a)], key=str)


def test_a_row_stored_very_often_is_put_together_before_the_shuffle(spark, docs_of):
    docs = docs_of([(1, "the same words in the same row again and again")] * 3000 + [(i, f"text number {i} of its own") for i in range(2, 30)])
    out = near.drop_copies(docs.repartition(6))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(1, 30))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
