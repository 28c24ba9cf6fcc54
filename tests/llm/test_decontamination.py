import random
import re

import pytest
from conftest import AWKWARD

from siftframe.llm.decontamination import Matcher, find_contamination, is_contaminated
from siftframe.llm.text import WORD_PATTERN

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(WORD_PATTERN, (text or "").translate(LOWER))


def brute(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(13, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1):
            if k and tuple(own[i : i + k]) in wins:
                hit.update(range(i, i + k))
                names |= {name} - {None}
    return len(own), len(hit), sorted(map(str, names), key=str)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "short item"),
    (3, None),
    (4, " ... "),
    (5, "x"),
    (None, "no name but five words"),
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (10, "TWO three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_awkward_rows(spark, docs_of, block_bytes):
    rows = AWKWARD + [
        (20, "say: One two, three four five six seven eight nine ten eleven twelve thirteen fourteen! x x"),
        (21, "a short item, a short  item; no name but five words"),
        (22, "shorts item x1 xx"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = docs_of(rows).withColumnRenamed("source", "found").withColumnRenamed("lang", "starts")
    out = find_contamination(docs, items, block_bytes=block_bytes, into="hits").collect()
    assert len(out) == len(rows)
    for r in out:
        n, hit, names = brute(r["text"], ITEMS)
        assert (r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) == (n, hit, names), r["doc_id"]
        assert sum(b - a for a, b in zip(r["hits"]["starts"], r["hits"]["ends"], strict=True)) == hit


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["found"]["n_hit"] for r in find_contamination(docs_of([(1, "a b")]), none).collect()] == [0]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert find_contamination(docs_of([]), items).count() == 0


def test_random_texts(spark):
    rng = random.Random(1)
    few = ["a", "b", "ab", "ba", "é", "1"]
    items = [(i, " ".join(rng.choices(few, k=rng.randint(1, 16)))) for i in range(40)]
    texts = [" ".join(rng.choices(few, k=rng.randint(0, 300))) for _ in range(60)]
    pairs = []
    for name, item in items:
        w = item.split()
        k = min(13, len(w))
        pairs += [(" ".join(w[i : i + k]) + " ", str(name)) for i in range(len(w) - k + 1)]
    found = Matcher(sorted(set(pairs))).search([t.encode() for t in texts])
    for text, (n, spans, names) in zip(texts, found, strict=True):
        assert (n, sum(b - a for a, b in spans), sorted(names)) == brute(text, items)


def test_a_twentieth_is_contaminated(spark):
    rows = spark.createDataFrame([(20, 1), (21, 1), (0, 0)], "w bigint, h bigint")
    rows = rows.selectExpr("struct(w as n_words, h as n_hit) as found")
    assert [r[0] for r in rows.select(is_contaminated()).collect()] == [True, False, False]
