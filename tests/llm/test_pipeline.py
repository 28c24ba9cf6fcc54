from conftest import AWKWARD
from test_near import brute as near_brute

import __spark_entry__ as entry_points
import corpus_pipeline
from siftframe.llm import decontamination, language, packing, secrets
from siftframe.llm.queries import public_tokenizer
from siftframe.llm.storage import stored


def test_stages_and_registration():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_copies", "decontamination", "secrets", "packing",
    ]
    assert "pipeline" in entry_points.queries()


def test_against_brute_force(spark, folder):
    """Each stage's decision, taken again for every document without Spark's help where it can be."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language.train(docs, key=docs["doc_id"])
    kept = [i for i, r in rows.items() if language.has_letters((r["text"] or "").encode())]
    shares = {i: model.predict([rows[i]["text"].encode()]) for i in kept}
    kept = [i for i in kept if shares[i][1][0] >= corpus_pipeline.LEAST_SHARE]
    kept = [i for i, low, _ in near_brute([(i, rows[i]["text"]) for i in kept]) if i == low]
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    pairs = [tuple(r) for r in decontamination.windows(items, "item_id", "text").collect()]
    matcher = decontamination.Matcher(pairs)
    clean = []
    for i in kept:
        n, spans, _ = matcher.search([rows[i]["text"].encode()])[0]
        hit = sum(b - a for a, b in spans)
        if not hit or 20 * hit < n:
            clean.append(i)
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == set(clean)
    tok = packing.open_tokenizer(public_tokenizer(corpus_pipeline.TOKENIZER))
    lengths = {}
    for r in out:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    for i in clean:
        text = rows[i]["text"]
        for a, b in reversed(decontamination.merged([(a, b) for a, b, _ in secrets.secret_spans(text)])):
            text = text[:a] + "[SECRET]" + text[b:]
        assert lengths[i] == len(tok.encode([text.encode()])[0]) + 1


def test_awkward_rows(spark, docs_of, folder):
    rows = [(i, t, "en") for i, t in AWKWARD] + [(70, "some words and a password=abcdef123456 here", "en")]
    docs = docs_of(rows).withColumnRenamed("source", "score")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
            seen[name] = docs.collect()
        empty = stage(spark, docs.limit(0) if name != "packing" else docs_of([]), folder)
        assert empty.count() == 0
    assert {r["doc_id"] for r in seen["language"]} <= {None, 4, 5, 6, 7, 8, 70}
    assert [r["doc_id"] for r in seen["near_copies"]].count(8) == 1
    text = next(r for r in seen["secrets"] if r["doc_id"] == 70)
    assert (text["text"], text["n_chars"]) == ("some words and a [SECRET] here", 30)
