import math
import random
import time

import numpy as np
import pytest
from conftest import AWKWARD

from siftframe.llm import lm
from siftframe.llm.text import words_of

RNG = random.Random(7)
TEXTS = [" ".join(f"{a} {b} {c}" for a, b, c in RNG.choices([("red", "fox", "ran"), ("blue", "cat", "sat"), ("old", "dog", "hid")], k=80)) for _ in range(60)]


@pytest.fixture(scope="module")
def model(docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(TEXTS)] + AWKWARD)
    vocabulary = lm.vocabulary_of(docs, "text", words=12, buckets=8, classes=6)
    return vocabulary, lm.train(docs, "text", vocabulary, classes=6, every=1, rounds=4)


def brute(model, text):
    """The score said plainly, one token at a time."""
    vocabulary, network = model
    ids = vocabulary.ids(words_of([text.encode()]).hashes()).tolist()
    embed, w1, b1, w2, b2 = (p.astype(float) for p in network.parts)
    total = 0.0
    for i, own in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else vocabulary.none for j in (i - 2, i - 1, i + 1, i + 2)]
        z = np.tanh(np.concatenate([embed[a] for a in around]) @ w1 + b1) @ w2 + b2
        p = np.exp(z - z.max())
        total += math.log(p[vocabulary.group[own]] / p.sum()) + vocabulary.log_share[own]
    return len(ids), total


def test_scores_are_the_sum_of_conditional_logs(docs_of, model):
    rows = [*AWKWARD, (60, TEXTS[0]), (61, "unknown words only here")]
    docs = docs_of(rows).withColumnRenamed("source", "n_words")
    out = {r["doc_id"]: r["lm"] for r in lm.score(docs, model[1], model[0]).collect()}
    for i, text in rows:
        if len(text or "") < 10_000 and i is not None:
            n, total = brute(model, text or "")
            assert out[i]["n_words"] == n
            assert out[i]["log_likelihood"] == pytest.approx(total, abs=1e-2)
    assert out[1]["mean_log_likelihood"] is None
    assert out[6]["n_words"] == 60_000


def test_context_is_learned_from_both_sides(model):
    vocabulary, network = model
    order = random.Random(1)
    held = [" ".join(f"{a} {b} {c}" for a, b, c in order.choices([("red", "fox", "ran"), ("blue", "cat", "sat")], k=50)) for _ in range(5)]
    mixed = [" ".join(order.sample(t.split(), len(t.split()))) for t in held]
    score = lambda texts: lm.score_texts(network, vocabulary, [t.encode() for t in texts])[1].sum()
    assert score(held) > score(mixed) + 100


def test_probabilities_sum_to_one(model):
    vocabulary, network = model
    share = np.zeros(vocabulary.none)
    share[: vocabulary.words] = np.exp(vocabulary.log_share[: vocabulary.words])
    known = np.bincount(vocabulary.group[: vocabulary.words], share[: vocabulary.words], 6)
    assert (known <= 1 + 1e-6).all()


def test_empty_tables(docs_of):
    docs = docs_of([])
    vocabulary = lm.vocabulary_of(docs, "text")
    network = lm.train(docs, "text", vocabulary)
    assert lm.score(docs, network, vocabulary).count() == 0
    assert lm.score(docs_of([(1, "a b")]), network, vocabulary).head()["lm"]["n_words"] == 2


def test_every_position_is_a_target_in_production(docs_of):
    texts = [b"one", b"one two three four five six seven", b"", b"a b " * 50]
    words = words_of(texts)
    chosen = [lm._chosen(words, k, lm.TRAIN_EVERY) for k in range(lm.ROUNDS)]
    assert sorted(np.concatenate(chosen).tolist()) == sorted(list(range(108)) * (lm.ROUNDS // lm.TRAIN_EVERY))
    docs = docs_of([(1, "red fox")])
    vocabulary = lm.vocabulary_of(docs, "text")
    begin, network = lm.Network.fresh(vocabulary.none + 1, lm.CLASSES), lm.train(docs, "text", vocabulary)
    for w in vocabulary.ids(words_of([b"red fox"]).hashes()):
        assert (begin.parts[0][w] != network.parts[0][w]).any()  # each is context of the other
    with pytest.raises(ValueError, match="residues"):
        lm.train(docs, "text", vocabulary, every=8)


def test_vocabulary_grows_with_the_corpus(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 4)
    few = lm.vocabulary_of(docs_of([(1, "a b c d e f g h")]), "text")
    many = lm.vocabulary_of(docs_of([(i, " ".join(f"w{j}" for j in range(40))) for i in range(10)]), "text")
    assert (few.words, many.words, many.buckets) == (4, 20, 5)


def plain_log_probabilities(parts, context):
    embed, w1, b1, w2, b2 = parts
    x = embed[context].reshape(len(context), -1)
    h = np.tanh(x @ w1 + b1)
    z = h @ w2 + b2
    z -= z.max(1, keepdims=True)
    return x, h, z - np.log(np.exp(z).sum(1, keepdims=True))


def plain_step(parts, context, target, sums, rate):
    """AdaGrad said plainly: sorted ids, and gradients added row by row."""
    x, h, logp = plain_log_probabilities(parts, context)
    dz = np.exp(logp)
    dz[np.arange(len(target)), target] -= 1
    dz /= len(target)
    dh = (dz @ parts[3].T) * (1 - h * h)
    dx = (dh @ parts[1].T).reshape(-1, parts[0].shape[1])
    touched, where = np.unique(context, return_inverse=True)
    de = np.zeros((len(touched), parts[0].shape[1]), np.float32)
    np.add.at(de, where.ravel(), dx)
    sums[0][touched] += de * de
    parts[0][touched] -= rate * de / np.sqrt(sums[0][touched] + 1e-8)
    for k, gradient in ((1, x.T @ dh), (2, dh.sum(0)), (3, h.T @ dz), (4, dz.sum(0))):
        sums[k] += gradient * gradient
        parts[k] -= rate * gradient / np.sqrt(sums[k] + 1e-8)


def test_steps_are_the_plain_ones_at_less_cost():
    ids = 5121
    rng = np.random.default_rng(1)
    batches = [(rng.zipf(1.3, (n, 4)) % ids, rng.integers(0, lm.CLASSES, n)) for n in [lm.BATCH] * 20 + [7, 1]]
    network, plain = lm.Network.fresh(ids, lm.CLASSES), lm.Network.fresh(ids, lm.CLASSES).parts
    sums, plain_sums = ([np.zeros(p.shape, np.float32) for p in plain] for _ in range(2))
    for context, target in batches:
        network.step(context, target, sums, 0.05)
        plain_step(plain, context, target, plain_sums, 0.05)
        logp = plain_log_probabilities(plain, context)[2][np.arange(len(target)), target]
        assert network.log_probabilities(context, target) == pytest.approx(logp, abs=1e-3)
    for own, said in zip(network.parts, plain, strict=True):
        assert own.dtype == np.float32
        assert own == pytest.approx(said, abs=1e-3)

    def least(step):
        spent = []
        for _ in range(5):
            start = time.thread_time()
            for context, target in batches:
                step(context, target)
            spent.append(time.thread_time() - start)
        return min(spent)

    cost = least(lambda c, t: network.step(c, t, sums, 0.05))
    assert cost < 0.75 * least(lambda c, t: plain_step(plain, c, t, plain_sums, 0.05))
