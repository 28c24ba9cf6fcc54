import numpy as np
import pytest
from conftest import AWKWARD
from tokenizers import Tokenizer

from siftframe.llm import shards
from siftframe.llm.queries import public_tokenizer
from siftframe.sources.scratch import scratch_path

BYTE = public_tokenizer("byte_bpe_50k.json")
END = 50256


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    order = shards.Permutation(size, 9)
    slots = order.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert order.number(slots).tolist() == list(range(size))
    if size > 500:
        assert shards.Permutation(size, 10).slot(np.arange(size)).tolist() != slots.tolist()
        assert abs(np.corrcoef(np.arange(size), slots)[0, 1]) < 0.15


def test_round_trip_and_resuming(spark, docs_of):
    rows = AWKWARD + [(100 + i, f"text {i} " * (i % 90)) for i in range(300)]
    docs = docs_of(rows).withColumnRenamed("source", "slot").withColumnRenamed("lang", "shard")
    root = scratch_path(spark, "test-shards")
    manifest, layout = shards.write_shards(docs, root, BYTE, END, seq_len=64, shard_rows=100)
    out = shards.read_shards(manifest, layout).collect()
    n = len(out)
    assert sorted(r["slot"] for r in out) == list(range(n))
    assert all(r["shard"] == r["slot"] // 100 and r["offset"] == r["slot"] % 100 * layout.record.itemsize for r in out)
    plain = Tokenizer.from_file(BYTE)
    texts = {}
    for r in sorted(out, key=lambda r: r["piece"]):
        texts.setdefault(r["doc_id"], []).append(r["ids"])
    for i, text in rows:
        if i != 8:  # twice: its pieces are those of two documents
            ids = [x for piece in texts[i] for x in piece]
            assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, END]
            assert plain.decode(ids[:-1], skip_special_tokens=False) == (text or "")
            assert all(len(piece) == 64 for piece in texts[i][:-1])
    later = shards.read_shards(manifest, layout, first_slot=250).collect()
    assert sorted(map(tuple, later)) == sorted(tuple(r) for r in out if r["slot"] >= 250)
    sizes = {r["shard"]: r["records"] for r in manifest.collect()}
    assert sizes == {s: min(100, n - 100 * s) for s in range(-(-n // 100))}


def test_same_key_same_order(spark, docs_of):
    docs = docs_of([(i, f"words {i}") for i in range(50)])

    def order(key):
        manifest, layout = shards.write_shards(docs, scratch_path(spark, "test-shards"), BYTE, END, key=key)
        return [r["doc_id"] for r in sorted(shards.read_shards(manifest, layout).collect(), key=lambda r: r["slot"])]

    assert order(1) == order(1) != order(2)


def test_empty_table(spark, docs_of):
    manifest, layout = shards.write_shards(docs_of([]), scratch_path(spark, "test-shards"), BYTE, END)
    assert manifest.count() == shards.read_shards(manifest, layout).count() == 0
