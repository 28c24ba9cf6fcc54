"""Score documents by masked pseudo-likelihood under a window network trained in numpy.

Every token is hidden in turn and predicted from the two tokens on either side;
a document's score is the sum of the log-probabilities of its tokens. The network
embeds the four neighbours, passes them through one hidden layer and predicts the
class of the token; within a class words have their share of its occurrences.

All documents take part: words are counted over the whole corpus (the most
frequent have ids of their own, the others share buckets by hash), and every task
trains on all documents of its partition, at every ``TRAIN_EVERY``-th position. The
tasks' parameters are averaged by the number of positions, in a tree of bounded
groups, and the next round starts from the average.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .text import release, text_parts, Words, words_of

WORDS, CLASSES = 4096, 64  # the least number of words with an id; there is a bucket for every four
SIDE, WIDTH, HIDDEN = 2, 16, 32
TRAIN_EVERY, ROUNDS, RATE, BATCH = 2, 2, 0.05, 1024
_GROUP = 32


@dataclass
class Vocabulary:
    """Ids of words (by hash), the class of each id and its log share within the class.

    The last id stands for no token, beyond the ends of a document.
    """

    hashes: np.ndarray  # sorted; word i of these has id order[i]
    order: np.ndarray
    words: int
    buckets: int
    group: np.ndarray
    log_share: np.ndarray

    @property
    def none(self) -> int:
        return self.words + self.buckets

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, mass: np.ndarray, kinds: np.ndarray, classes: int):
        """From the counts of the frequent words, and occurrences and different words of each bucket."""
        order = np.argsort(hashes, kind="stable")
        total = np.concatenate([counts, mass]).astype(float) + 1e-9
        by_count = np.argsort(-total, kind="stable")
        group = np.empty(len(total), np.int64)
        before = np.cumsum(total[by_count]) - total[by_count]
        group[by_count] = np.minimum((before / total.sum() * classes).astype(np.int64), classes - 1)
        log_share = np.log(total) - np.log(np.bincount(group, total, classes)[group])
        log_share[len(counts) :] -= np.log(np.maximum(kinds, 1))
        return cls(hashes[order], order, len(counts), len(mass), group, log_share)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = self.words + (hashes % np.uint64(self.buckets)).astype(np.int64)
        if self.words:
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.words - 1)
            known = self.hashes[at] == hashes
            out[known] = self.order[at[known]]
        return out


class Network:
    """Embeddings, hidden layer and class scores; trained by AdaGrad."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @classmethod
    def fresh(cls, ids: int, classes: int, width: int = WIDTH, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(3)
        shapes = [(ids, width), (2 * SIDE * width, hidden), (hidden,), (hidden, classes), (classes,)]
        scale = [0.1, (2 * SIDE * width) ** -0.5, 0.0, hidden**-0.5, 0.0]
        return cls([(rng.normal(size=s) * k).astype(np.float32) for s, k in zip(shapes, scale, strict=True)])

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values and class scores; the largest score of a row is 0."""
        embed, w1, b1, w2, b2 = self.parts
        x = embed.take(context, 0).reshape(len(context), -1)
        h = np.tanh(x @ w1 + b1)
        z = h @ w2 + b2
        z -= z.max(1, keepdims=True)
        return x, h, z

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        z = self.forward(context)[2]
        own = z[np.arange(len(target)), target]
        return own - np.log(np.exp(z, out=z).sum(1))

    def step(self, context: np.ndarray, target: np.ndarray, sums: list[np.ndarray], rate: float) -> None:
        embed, w1, _, w2, _ = self.parts
        width = embed.shape[1]
        x, h, z = self.forward(context)
        dz = np.exp(z, out=z)
        dz /= dz.sum(1, keepdims=True) * len(target)
        dz[np.arange(len(target)), target] -= np.float32(1 / len(target))
        dh = (dz @ w2.T) * (1 - h * h)
        dx = dh @ w1.T
        # The rows in use by marks, not by sorting; add.at is several times slower over rows than over single cells.
        used = np.zeros(len(embed), bool)
        used[context] = True
        touched = np.flatnonzero(used)
        cell = np.empty(len(embed), np.int64)
        cell[touched] = np.arange(len(touched)) * width
        de = np.zeros(len(touched) * width, np.float32)
        np.add.at(de, (cell.take(context)[:, :, None] + np.arange(width)).ravel(), dx.ravel())
        de = de.reshape(-1, width)
        sums[0][touched] += de * de
        embed[touched] -= rate * de / np.sqrt(sums[0][touched] + 1e-8)
        for k, gradient in ((1, x.T @ dh), (2, dh.sum(0)), (3, h.T @ dz), (4, dz.sum(0))):
            sums[k] += gradient * gradient
            self.parts[k] -= rate * gradient / np.sqrt(sums[k] + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def unflat(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts:
            out.append(values[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(out)


def _laid_out(words: Words, ids: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with gaps between them, and the places of the tokens."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    place = np.arange(len(ids)) + SIDE * (text + 1)
    row = np.full(len(ids) + SIDE * (len(words.counts) + 1), none, np.int64)
    row[place] = ids
    return row, place


_AROUND = np.array([d for d in range(-SIDE, SIDE + 1) if d])


def _chosen(words: Words, k: int, every: int) -> np.ndarray:
    """The tokens whose position in their text is ``k`` modulo ``every``."""
    return np.flatnonzero((np.arange(words.first[-1]) - np.repeat(words.first[:-1], words.counts)) % every == k % every)


def score_texts(network: Network, vocabulary: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and sum of log-probabilities of each text."""
    words = words_of(texts)
    ids = vocabulary.ids(words.hashes())
    row, place = _laid_out(words, ids, vocabulary.none)
    logs = np.empty(len(ids))
    for a in range(0, len(ids), BATCH):
        own = ids[a : a + BATCH]
        logp = network.log_probabilities(row.take(place[a : a + BATCH, None] + _AROUND), vocabulary.group[own])
        logs[a : a + BATCH] = logp + vocabulary.log_share[own]
    sums = np.concatenate([[0.0], np.cumsum(logs)])
    return words.counts, sums[words.first[1:]] - sums[words.first[:-1]]


def vocabulary_of(
    docs: DataFrame, text_col: str, words: int | None = None, buckets: int | None = None, classes: int = CLASSES
) -> Vocabulary:
    """Counted over all words of all texts; ``words`` is their root by default, ``buckets`` a quarter of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(part).hashes() for part in text_parts(batch.column(0))]
            hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"]
            )
        release()

    counted = docs.select(text_col).mapInArrow(count, "word bigint, n bigint")
    counted = stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    if words is None:
        words = max(WORDS, math.isqrt(counted.agg(F.sum("n")).head()[0] or 0))
    if buckets is None:
        buckets = max(1, words // 4)
    top = counted.orderBy(F.desc("n"), "word").limit(words)
    frequent = top.collect()  # ``words`` rows
    # The same bucket as Vocabulary.ids: the hash, unsigned, modulo the number of buckets.
    bucket = F.pmod(F.pmod("word", F.lit(buckets)) + F.when(F.col("word") < 0, (1 << 64) % buckets).otherwise(0), F.lit(buckets))
    rest = counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    mass, kinds = np.zeros(buckets), np.zeros(buckets)
    for r in rest:
        mass[r["bucket"]], kinds[r["bucket"]] = r["n"], r["kinds"]
    hashes = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in frequent], float)
    own = (hashes % np.uint64(buckets)).astype(np.int64)
    mass -= np.bincount(own, counts, buckets)
    kinds -= np.bincount(own, minlength=buckets)
    return Vocabulary.build(hashes, counts, np.maximum(mass, 0), np.maximum(kinds, 0), classes)


def train(
    docs: DataFrame,
    text_col: str,
    vocabulary: Vocabulary,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
    every: int = TRAIN_EVERY,
    rate: float = RATE,
) -> Network:
    """Train on all positions of all documents; without words the network stays as it begins.

    ``rounds`` must be a multiple of ``every``, or some positions would be hidden less often than others.
    """
    if every < 1 or rounds % every:
        raise ValueError(f"{rounds} rounds do not cover {every} residues of positions equally")
    spark = docs.sparkSession
    network = Network.fresh(vocabulary.none + 1, classes)
    known = spark.sparkContext.broadcast(vocabulary)

    for k in range(rounds):
        begin = spark.sparkContext.broadcast(network)

        def fit(batches: Iterator[pa.RecordBatch], k=k, begin=begin) -> Iterator[pa.RecordBatch]:
            own, seen = begin.value.unflat(begin.value.flat()), 0
            sums = [np.zeros(p.shape, np.float32) for p in own.parts]
            for batch in batches:
                for part in text_parts(batch.column(0)):
                    words = words_of(part)
                    ids = known.value.ids(words.hashes())
                    row, place = _laid_out(words, ids, known.value.none)
                    chosen = _chosen(words, k, every)
                    for a in range(0, len(chosen), BATCH):
                        some = chosen[a : a + BATCH]
                        own.step(row.take(place[some, None] + _AROUND), known.value.group[ids[some]], sums, rate)
                    seen += len(chosen)
            if seen:
                yield _parameters(own.flat() * np.float64(seen), seen)

        trained = docs.select(text_col).mapInArrow(fit, "sums binary, n bigint")
        parts = docs.sparkSession.sparkContext.defaultParallelism * _GROUP
        while parts > 1:
            parts = -(-parts // _GROUP)
            trained = trained.repartition(parts).mapInArrow(_added, "sums binary, n bigint")
        rows = trained.collect()  # one row of the size of the network
        if not rows:
            break
        total = sum(np.frombuffer(r["sums"]) for r in rows)
        network = network.unflat(total / sum(r["n"] for r in rows))
    return network


def _parameters(sums: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for sums, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(sums.as_py())
            total = values.copy() if total is None else total + values
            n += k
    if total is not None:
        yield _parameters(total, n)


def score(
    docs: DataFrame, network: Network, vocabulary: Vocabulary, text_col: str = "text", into: str = "lm"
) -> DataFrame:
    """``docs`` with a column ``into``: {n_words, log_likelihood, mean_log_likelihood}.

    The sum of the log-probabilities (natural) of all words given their
    neighbours, rounded to 4 decimals, and its mean per word. Null, empty and
    word-free texts have 0 words, sum 0 and a null mean. Other columns are kept;
    one named ``into`` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast((network, vocabulary))

    @F.arrow_udf("struct<n_words:bigint,log_likelihood:double,mean_log_likelihood:double>")
    def likelihood(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, sums = [], []
            for part in text_parts(texts):
                n, s = score_texts(*model.value, part)
                counts += n.tolist()
                sums += np.round(s, 4).tolist()
            means = [s / n if n else None for s, n in zip(sums, counts, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())],
                names=["n_words", "log_likelihood", "mean_log_likelihood"],
            )
        release()

    return docs.withColumn(into, likelihood.asNondeterministic()(F.col(text_col)))
