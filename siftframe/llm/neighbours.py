"""Nearest neighbours by inner product: multi-index hashing of learned binary codes.

A vector's code is the signs of learned rotations of it: principal axes of a
sample, turned step by step so that the signs lose least (iterative
quantization). For inner products vectors are first lifted onto a sphere, by one
more component that fills each up to the largest norm.

The rows are dealt to blocks of bounded size. A block cuts its codes into
substrings of 16 bits and indexes each. By the pigeonhole principle a code within
distance ``r`` of the query's is within ``r // s`` of it in one of the ``s``
substrings, so probing those buckets retrieves every code within the radius; they
are checked in full and reranked by the inner product of the original vectors.
The radius is learned from the sample; a block with too few codes inside is
probed again with a larger one. Equal vectors are one entry with its least ids.
An id may occur many times: every cut keeps k rows whichever id asks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

NEIGHBOURS = 20
BITS = 128
SAMPLE = 20_000
BLOCK_ROWS = 131_072
QUERY_BLOCK = 20_000
_SUB = 16
_ONES = np.bitwise_count(np.arange(1 << _SUB, dtype=np.uint16)).astype(np.uint8)


@dataclass
class Coder:
    """Codes of vectors, and the radius within which neighbours are looked for."""

    mean: np.ndarray
    turn: np.ndarray
    norm: float
    radius: int = 0

    @classmethod
    def learn(cls, sample: np.ndarray, norm: float, bits: int, k: int, recall: float, rounds: int = 20) -> Coder:
        rng = np.random.default_rng(5)
        lifted = _lifted(sample, norm)
        mean = lifted.mean(0)
        centred = lifted - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : min(64, lifted.shape[1])]
        flat, turns = centred @ axes, []
        width = axes.shape[1]
        for _ in range(-(-bits // width)):
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(flat.T @ np.sign(flat @ turn))
                turn = u @ v
            turns.append(axes @ turn)
        coder = cls(mean, np.concatenate(turns, 1)[:, :bits], norm)
        some = sample[rng.permutation(len(sample))[:300]]
        scores, apart = some @ sample.T, distances(coder.codes(some, True), coder.codes(sample))
        near = np.argsort(-scores, 1, kind="stable")[:, 1 : k + 1]
        found = np.take_along_axis(apart, near, 1)
        coder.radius = int(np.quantile(found, recall)) if found.size else bits
        return coder

    def codes(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        lifted = _lifted(vectors, None if queries else self.norm)
        signs = (lifted - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1).view(np.uint16)


def _lifted(vectors: np.ndarray, norm: float | None) -> np.ndarray:
    """Unit vectors with one more component; queries (no ``norm``) have none in it."""
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    if norm is None:
        return np.hstack([vectors / np.maximum(length, 1e-300), np.zeros_like(length)])
    scaled = vectors / norm
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(1, keepdims=True)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes of ``a`` from all of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += _ONES[a[:, j][:, None] ^ b[:, j][None, :]]
    return out


class MultiIndex:
    """Codes of a block by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.index = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.index.append((order, values, first, np.append(first[1:], len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` away from ``code``."""
        near, parts = np.zeros(len(self.codes), bool), self.codes.shape[1]
        for j, (order, values, first, last) in enumerate(self.index):
            # A distance of ``radius`` can't exceed ``radius // parts`` in all of the first
            # ``radius % parts + 1`` substrings and reach it in all others.
            most = radius // parts - (j > radius % parts)
            hit = np.flatnonzero(_ONES[values ^ code[j]] <= most) if most >= 0 else []
            if len(hit):
                size = last[hit] - first[hit]
                end = np.cumsum(size)
                near[order[np.repeat(first[hit] - end + size, size) + np.arange(end[-1])]] = True
        rows = np.flatnonzero(near)
        apart = np.zeros(len(rows), np.int32)
        for j in range(parts):
            apart += _ONES[self.codes[rows, j] ^ code[j]]
        return rows[apart <= radius]


def _best(scores: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[tuple[float, int]], bool]:
    """The best (-score, id), so many that ``k`` are left without any one id; and whether there are so many.

    An id is taken ``k`` times at most, as no query needs more of it, so these are up to ``2 * k``.
    """
    most = k + 1
    while True:
        some, own = rows, scores
        if len(rows) > most:
            least = np.partition(scores, len(rows) - most)[len(rows) - most]
            some, own = rows[scores >= least], scores[scores >= least]
        kept, times, highest = [], Counter(), 0
        for minus, i in sorted((-s, i) for r, s in zip(some.tolist(), own.tolist(), strict=True) for i in ids[r]):
            if times[i] < k:
                times[i] += 1
                highest = max(highest, times[i])
                kept.append((minus, i))
                if len(kept) - highest >= k:
                    return kept, True
        if len(rows) <= most:
            return kept, False
        most *= 4


def _search(coder: Coder, vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, codes: np.ndarray, k: int):
    """For each query the best (-score, id) of a block, ``k`` without any one id."""
    index = MultiIndex(coder.codes(vectors))
    bits = 16 * codes.shape[1]
    for n, (query, code) in enumerate(zip(queries, codes, strict=True)):
        radius = coder.radius
        while True:
            rows, best, enough = index.within(code, radius), [], False
            if radius >= bits or len(rows) >= min(k + 1, len(vectors)):
                best, enough = _best(vectors[rows] @ query, rows, ids, k)
            if enough or radius >= bits or len(rows) == len(vectors):
                break
            radius = min(bits, radius + max(2, bits // 32))
        yield n, best


def valid(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and has finite components only, as doubles."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.withColumn(vec_col, F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0))).where(
        (F.size(vec_col) > 0) & finite & F.exists(vec_col, lambda x: x != 0)
    )


def _key(vector: Column) -> Column:
    return F.md5(F.concat_ws(",", F.transform(vector, lambda x: x.cast("string"))))


_RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def nearest(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = NEIGHBOURS,
    bits: int = BITS,
    sample: int = SAMPLE,
    recall: float = 0.97,
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``queries`` holds, the ``k`` nearest other rows found.

    The score is the inner product in double precision; nearest first, ties to
    the smaller id. Rotations and radius are fitted on about ``sample`` different
    vectors chosen by hash; every row is indexed. Vectors that are null, empty or
    zero or have null or non-finite components take no part, nor do rows without
    id or with another number of components than most rows have. Rows with an
    id in common are separate candidates, but none of a query with that id. With
    ``k`` or fewer candidates all are returned. Other columns are not used.
    """
    spark = vectors.sparkSession
    rows = valid(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), queries.alias("asks")), "vec")
    rows = rows.where("id IS NOT NULL")
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")
    )
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).head()
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    rows = rows.where(F.size("vec") == usual["size"])

    # k + 1 ids of a vector, each k times at most, leave k without any one of them.
    by_vector = Window.partitionBy("vec").orderBy("id")
    least = rows.groupBy("vec", "id").agg(F.count(F.lit(1)).alias("times"))
    least = least.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    copies = F.array_repeat("id", F.least("times", F.lit(k)).cast("int"))
    blocks = max(spark.sparkContext.defaultParallelism, -(-usual["n"] // BLOCK_ROWS))
    entries = stored(
        least.groupBy("vec").agg(F.sort_array(F.flatten(F.collect_list(copies))).alias("ids")).repartition(blocks), "neighbour-entries"
    )
    different = entries.count()
    part = F.pmod(F.xxhash64("vec", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chosen = entries.where(part < sample / different).select("vec") if different > sample else entries.select("vec")
    fitted = np.array([r["vec"] for r in chosen.collect()])  # about ``sample`` rows
    if not len(fitted):
        fitted = np.array([r["vec"] for r in entries.limit(sample).select("vec").collect()])
    coder = Coder.learn(fitted, max(float(usual["norm"]) ** 0.5, 1e-300), bits, k, recall)

    asked = rows.where("asks").select("id", "vec", _key(F.col("vec")).alias("key"))
    different_asked = stored(asked.groupBy("key").agg(F.first("vec").alias("vec")), "neighbour-queries")
    n_asked = different_asked.count()
    groups, found = max(1, -(-n_asked // QUERY_BLOCK)), None
    for g in range(groups):  # the query set in blocks, each against all rows
        some = different_asked.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).collect()
        block = ([r["key"] for r in some], np.array([r["vec"] for r in some]).reshape(len(some), usual["size"]))
        pairs = _against(entries, spark.sparkContext.broadcast(block), coder, k)
        found = pairs if found is None else found.unionAll(pairs)
    # The same over all blocks: a row counts while fewer than k before it are left without some id.
    of_id = Window.partitionBy("key", "vec_id").orderBy("minus")
    order = Window.partitionBy("key").orderBy("minus", "vec_id", "times")
    before = F.coalesce(F.max("times").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = found.repartition("key").withColumn("times", F.row_number().over(of_id)).where(F.col("times") <= k)
    top = top.select("*", F.row_number().over(order).alias("n"), before.alias("before")).where(F.col("n") - 1 - F.col("before") < k)
    top = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("minus", "vec_id"))).alias("best"))
    answered = asked.select("id", "key").join(top, "key")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(own).alias("n", "b")).select(
        "query_id",
        (F.col("n") + 1).cast("int").alias("rank"),
        F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.minus")).alias("score"),
    )


def _against(entries: DataFrame, block, coder: Coder, k: int) -> DataFrame:
    """(key, minus, vec_id): the best of each block of entries for each query, ``k`` without any one id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries = block.value
        if not keys:
            return
        codes = coder.codes(queries, True)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield from answers(held, keys, queries, codes)
                held = []
        if held:
            yield from answers(held, keys, queries, codes)

    def answers(held, keys, queries, codes):
        flat = np.concatenate([b.column("vec").flatten().to_numpy(zero_copy_only=False) for b in held])
        vectors = flat.reshape(-1, queries.shape[1])
        ids = [x for b in held for x in b.column("ids").to_pylist()]
        out: tuple[list, list, list] = ([], [], [])
        for n, best in _search(coder, vectors, ids, queries, codes, k):
            for minus, i in best:
                for column, value in zip(out, (keys[n], minus, i), strict=True):
                    column.append(value)
            if len(out[0]) > 50_000:
                yield _rows(out)
                out = ([], [], [])
        if out[0]:
            yield _rows(out)

    return entries.mapInArrow(search, "key string, minus double, vec_id bigint")


def _rows(out: tuple[list, list, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["key", "minus", "vec_id"]
    )
