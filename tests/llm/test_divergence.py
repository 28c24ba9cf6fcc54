import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import AWKWARD

from siftframe.llm import divergence

PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(PATTERN, (text or "").translate(LOWER))


def brute(rows, least, top):
    """rows: (text, lang, source)"""
    count, lang_count, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        sources[lang].add(source)
        count[lang, source].update(found)
        lang_count[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in sources:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources[lang]}
        share = lambda c, n, v=len(kept): 1 + (10**9 * (c + 5)) // (n + 5 * v)
        p = {s: [share(count[lang, s][t], total[s]) for t in kept] for s in sources[lang]}
        q = [share(lang_count[lang][t], sum(total.values())) for t in kept]
        for s in sources[lang]:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources[lang] - {s}]
            single = [
                (b - a, t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if count[lang, s][t] and a > b
            ]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(single)[:top])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, **options):
    out = divergence.audit(df, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def frame(spark, rows):
    full = [(i, *r, "x", 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id int, text string, lang string, source string, term string, rank int")


def texts(rng, n):
    words = [w * k for k in (1, 3, 7, 20, 70) for w in ("ab", "é", "Zq", "xyzzy", "日本")] + ["eighteen", "sixteenletterswx"]
    return [" ".join(rng.choice(words, rng.integers(0, 12))) + rng.choice([".", "7", "_"]) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 200, "cell_rows": 20, "block_sources": 2}])
def test_same_as_brute_force(spark, sizes):
    rng = np.random.default_rng(2)
    rows = [
        (t, str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s2", "s3", "Ü", "z"], p=[0.5, 0.2, 0.1, 0.1, 0.1])))
        for t in texts(rng, 300)
    ]
    rows += [(None, "en", "empty"), ("", None, None), ("7 7", "fr", "a"), ("one", "fr", "b"), (rows[0][0], "en", "s1")]
    assert got(frame(spark, rows), least_documents=5, top=4, **sizes) == brute(rows, 5, 4)


def test_awkward_rows(spark, docs_of):
    rows = [(i, t, "en") for i, t in AWKWARD] + [(9, "words " * 3, None)]
    plain = [(t, lang, "s") for _, t, lang in rows]
    assert got(docs_of(rows), least_documents=1) == brute(plain, 1, 50)
    assert got(docs_of(rows), least_documents=1, slice_bytes=1000) == brute(plain, 1, 50)
    assert got(docs_of(rows)) == []


def test_empty_table(spark, docs_of):
    assert got(docs_of([])) == []


def test_shares_beyond_64_bits():
    count = np.array([0, 10**12, 3])
    total = np.array([10**13, 10**13, 7])
    want = [1 + (10**9 * (c + 5)) // (n + 5 * 11) for c, n in zip(count.tolist(), total.tolist(), strict=True)]
    assert divergence._share_of(count, total, 11).tolist() == want


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 5, 1000).astype(np.uint64) << np.uint64(40) for _ in range(2))
    assert divergence._radix([a, b]).tolist() == np.lexsort((b, a)).tolist()
