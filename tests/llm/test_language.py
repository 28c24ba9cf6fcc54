import random
from collections import Counter

import numpy as np
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from siftframe.llm import language
from siftframe.llm.queries import language_model, op8_language


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op8_language(spark, folder).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


TRAIN = [(i, t, x) for i, (t, x) in enumerate([("ab abc abcd abcde", "a"), ("xy xyz xyzw xyzwv", "b")] * 5)]


def test_masks_are_exact_but_for_false_positives(docs_of):
    model = language.train(docs_of(TRAIN + [(90, "nothing", None), (91, None, "a"), (92, "", "c")]))
    assert model.languages == ["a", "b", "c"]
    codes, _ = language._grams([b"abcd xyzw"])
    masks = model.containing(codes)[:, 0].tolist()
    assert masks[:4] == [1, 1, 1, 0] or masks[0] & 1  # " abc", "abcd", "bcd "
    assert masks[-1] & 2


def test_awkward_rows(docs_of):
    model = language.train(docs_of(TRAIN))
    docs = docs_of(AWKWARD).withColumnRenamed("source", "score")
    out = {r["doc_id"]: r["language"] for r in language.identify(docs, model).collect()}
    assert [out[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert out[4] == ("b", 0.0)  # letters, but nothing known: the commonest, ties to the later name
    assert out[7]["lang_pred"] in ("a", "b")
    assert language.identify(docs_of([]), model).count() == 0


def test_without_training_rows(docs_of):
    assert language.train(docs_of([(1, "a", None)])) is None
    assert [r["language"]["lang_pred"] for r in language.identify(docs_of([(1, "abc")]), None).collect()] == ["und"]


def plain_grams(text):
    """4-byte n-grams: letters lower-cased, everything else between them one blank."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in (" " + text.lower() + " ").encode())
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return [data[i : i + 4] for i in range(len(data) - 3)]


def plain_prediction(rows, text, model, typical=0.5, least_count=3):
    """The rule said plainly: typical n-grams per language, false positives from the filter, correction, winner."""
    seen = {}
    for _, words, lang in rows:
        seen.setdefault(lang, Counter()).update(plain_grams(words or ""))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in seen.items()}
    documents = Counter(lang for _, _, lang in rows)
    owned = {
        lang: {
            g
            for g, n in c.items()
            if n >= min(least_count, documents[lang]) and share[lang][g] >= typical * max(s.get(g, 0) for s in share.values())
        }
        for lang, c in seen.items()
    }
    grams = plain_grams(text)
    counts = {}
    for i, lang in enumerate(sorted(seen)):
        code = {g: int.from_bytes(g, "little") for g in grams}
        false = {
            g
            for g in set(grams) - owned[lang]
            if int(model.containing(np.array([code[g]], np.uint32))[0, i // 64]) >> (i % 64) & 1
        }
        assert all(int(model.containing(np.array([code[g]], np.uint32))[0, i // 64]) >> (i % 64) & 1 for g in owned[lang] & set(grams))
        hits = sum(g in owned[lang] or g in false for g in grams)
        slot = (model.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).sum() / len(model.table)
        counts[lang] = max(0.0, hits - len(grams) * slot**3) / (1 - slot**3)
    total = sum(counts.values())
    best = max(sorted(counts), key=counts.get)
    return (best, counts[best] / total, counts) if total else (None, 0.0, counts)


def test_counts_correction_and_winner_are_those_of_the_plain_rule(docs_of):
    random.seed(8)
    letters = {"a": "abcdé", "b": "cdefg", "c": "日本語中文", "d": "abefx"}
    rows = [
        (i, " ".join("".join(random.choices(letters[x], k=random.randint(1, 6))) for _ in range(random.randint(0, 40))), x)
        for i, x in enumerate(random.choices("aabbcd", k=60))
    ]
    model = language.train(docs_of(rows))
    texts = [
        ". ,".join("".join(random.choices(letters[random.choice("abcd")], k=random.randint(1, 6))) for _ in range(20)) + " 7!"
        for _ in range(30)
    ]
    counts = model.counts([t.encode() for t in texts])
    names, scores = model.predict([t.encode() for t in texts])
    for k, text in enumerate(texts):
        best, score, plain = plain_prediction(rows, text, model)
        assert counts[k] == pytest.approx([plain[x] for x in model.languages])
        assert names[k] == best
        assert scores[k] == pytest.approx(score)


def test_rare_language_is_learned_beside_large_ones(docs_of):
    rows = [(i, f"common words of a large language number {chr(97 + i % 26)}", "big") for i in range(3_000)]
    rows += [(5_000, "žluťoučký kůň úpěl ďábelské ódy", "rare"), (5_001, "zażółć gęślą jaźń", "tiny")]
    model = language.train(docs_of(rows), key=F.col("doc_id").cast("string"), max_documents=60)
    assert model.languages == ["big", "rare", "tiny"]
    assert model.predict(["kůň úpěl".encode(), "gęślą jaźń".encode(), b"large words"])[0] == ["rare", "tiny", "big"]


def test_quotas():
    assert language.quotas({"a": 1_000_000, "b": 10, "c": 500_000}, 1_010) == {"a": 500, "b": 10, "c": 500}
    assert language.quotas({"a": 5, "b": 3}, 100) == {"a": 5, "b": 3}
    assert language.quotas({x: 9 for x in "abcd"}, 2) == dict.fromkeys("abcd", 1.0)
    assert language.quotas({}, 5) == {}


def test_long_text_is_counted_whole(docs_of):
    model = language.train(docs_of(TRAIN))
    text = "abcde " * 10 + "xyzwv " * 400_000
    assert model.predict([text.encode()])[0] == ["b"]


def test_more_than_64_languages(docs_of):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q word", f"l{i:03}") for i in range(70) for _ in range(3)]
    model = language.train(docs_of(rows))
    assert model.table.shape[1] == 2
    assert model.predict([b"wsrcq waacq wsbq wscq"])[0][0] in model.languages


def test_labels_are_no_input(spark, folder):
    model = language_model(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(20)
    plain = {r["doc_id"]: r["language"] for r in language.identify(docs, model).collect()}
    marked = docs.withColumn("lang", F.lit("xx"))
    assert {r["doc_id"]: r["language"] for r in language.identify(marked, model).collect()} == plain
