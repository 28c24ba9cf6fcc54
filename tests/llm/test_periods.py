import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from conftest import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st

from siftframe.llm.periods import Runs, find_periodic_runs
from siftframe.llm.queries import with_repeats


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=6, exponent=4):
    """(start, length, period) of all runs, by comparing at every distance."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rng):
    n, letters = rng.randint(0, 150), "abcde"[: rng.choice([1, 2, 3, 5])]
    w = [rng.choice(letters) for _ in range(n)]
    if rng.random() < 0.6 and n > 4:
        unit, at = w[: rng.randint(1, n // 3 + 1)], rng.randint(0, n // 2)
        w = w[:at] + [unit[i % len(unit)] for i in range(n - at)]
        if rng.random() < 0.4:
            w[rng.randrange(n)] = "z"
    return w


def test_many_texts_against_all_distances():
    rng = random.Random(7)
    for _ in range(400):
        some = [periodic(rng) for _ in range(rng.randint(1, 5))]
        found = Runs([" ".join(w).encode() for w in some])
        for k, w in enumerate(some):
            assert found.runs[k] == brute(w)
            assert found.collapsed(k).decode() == collapsed(w, brute(w))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_repeated_pieces(pieces):
    w = [c for piece, times in pieces for c in piece * times]
    assert Runs([" ".join(w).encode()]).runs[0] == brute(w)


def test_runs_of_a_row(spark, docs_of):
    rng = random.Random(3)
    rows = AWKWARD + [(100 + i, "\t".join(periodic(rng))) for i in range(40)]
    rows += [(200, "a\x0bb\x0ca\rb\na b A b"), (201, "no break no break " * 5), (202, "x " * 50_000)]
    docs = docs_of(rows).withColumnRenamed("source", "collapsed").withColumnRenamed("lang", "__found")
    out = find_periodic_runs(docs, into="n_chars")
    assert out.columns == docs.columns
    have = out.collect()
    assert len(have) == len(rows)
    for r in have:
        w, found = words(r["text"]), r["n_chars"]
        runs = [tuple(x) for x in found["runs"]]
        if len(w) < 5000:
            assert runs == brute(w), r["doc_id"]
        assert found["n_words"] == len(w)
        assert found["collapsed"] == collapsed(w, runs)
        ranked = sorted(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
        assert (found["best"] and tuple(found["best"])) == (ranked[0] if ranked else None)
    by_id = {r["doc_id"]: r["n_chars"] for r in have}
    assert [tuple(x) for x in by_id[202]["runs"]] == [(0, 50_000, 1)]
    assert [tuple(x) for x in by_id[6]["runs"]] == [(0, 60_000, 2)]


def test_smaller_limits_are_refused_and_empty_tables_pass(spark, docs_of):
    with pytest.raises(ValueError):
        find_periodic_runs(docs_of([]), exponent=3)
    assert find_periodic_runs(docs_of([])).collect() == []


def test_repeats_that_the_query_puts_in(spark, docs_of):
    rows = [(i, f"w{i} " + " ".join(f"t{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (300, None), (301, " ")]
    changed = 0
    for r, (i, text) in zip(with_repeats(docs_of(rows).coalesce(1)).collect(), rows, strict=True):
        w = words(text)
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        assert words(r["text"]) == w
    assert changed > 10


def test_digest_of_no_words():
    assert Runs([b" \n"]).collapsed(0) == b""
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
