"""Exact top-k by inner product: columnar branch and bound.

Vectors become integer vectors, floor(scale * x) in every component. A block of
rows is held in vertical layout: the dimensions are put in order of falling mass
and cut into groups, and each group is an array of its own. Partial products grow
group by group. What the remaining groups can still add is at most the product of
the remaining norms of query and row (Cauchy-Schwarz), so a row whose bound is
below the query's current k-th score is given up; the survivors are compacted as
soon as they are few. Partial sums are whole numbers that doubles hold exactly,
and the bound is rounded up, so the result is exact.

Rows and queries are cut into blocks by hash, and every cell of the grid
(row block, query block) is one group of bounded size, whatever the table holds.
A first round over every sixteenth row gives each query a score that its k-th
best can't be below; the second round, over all rows, starts from it. So a row
leaves its cell only if it may be among the best, and what leaves follows the
number of queries, not that of cells. Equal rows are one row with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored
from .text import release

BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
GROUP = 8  # dimensions whose products are added at a time
_PART_ROWS, _PART_QUERIES = 1024, 256
_DENSE = 0.2  # above this share of survivors the whole part is carried on
_FIRST = 16  # the first round takes one row in so many
_EXACT = 2.0**53
_LAST_ID = np.iinfo(np.int64).max
_SCHEMA = "q bigint, query_id bigint, query_copies bigint, id bigint, score bigint, copies bigint"


def _matrix(column: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """Integer vectors (as doubles) of a column of lists, with zeros up to ``width``."""
    lists = column.combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(ends)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < size[:, None]] = np.floor(scale * flat[ends[0] : ends[-1]])
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in column.chunks), default=0)


class Best:
    """The k best (score, id) of each query so far, and the score to beat."""

    def __init__(self, k: int, score: np.ndarray, last: np.ndarray):
        self.k, self.score, self.last = k, score, last
        self.query = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.float64)
        self.row = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, found: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        to_beat = self.score[query]
        good = (found > to_beat) | ((found == to_beat) & (ids[row] <= self.last[query]))
        query = np.concatenate([self.query, query[good]])
        found = np.concatenate([self.found, found[good]])
        row = np.concatenate([self.row, row[good]])
        order = np.lexsort((ids[row], -found, query))
        query, found, row = query[order], found[order], row[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kth = place == self.k - 1
        self.score[query[kth]], self.last[query[kth]] = found[kth], ids[row[kth]]
        keep = place < self.k
        self.query, self.found, self.row = query[keep], found[keep], row[keep]


class Vertical:
    """Rows as one array per group of dimensions, with the norms of what follows."""

    def __init__(self, rows: np.ndarray, order: np.ndarray):
        cuts = range(0, len(order), GROUP)
        self.parts = [np.ascontiguousarray(rows[:, order[c : c + GROUP]]) for c in cuts]
        mass = [np.einsum("ij,ij->i", p, p) for p in self.parts]
        after = np.zeros((len(mass) + 1, len(rows)))
        for b in range(len(mass) - 1, -1, -1):
            after[b] = after[b + 1] + mass[b]
        self.rest = np.sqrt(after)

    def take(self, where) -> Vertical:
        out = object.__new__(Vertical)
        out.parts, out.rest = [p[where] for p in self.parts], self.rest[:, where]
        return out


def _survivors(rows: Vertical, asks: Vertical, to_beat: np.ndarray):
    """(query, row, score) of all pairs that are not out by their bound."""
    steps = len(rows.parts)
    total = np.zeros((asks.rest.shape[1], rows.rest.shape[1]))
    b = 0
    while b < steps:
        total += asks.parts[b] @ rows.parts[b].T
        b += 1
        live = total + asks.rest[b][:, None] * rows.rest[b] * (1 + 1e-9) + 0.5 >= to_beat[:, None]
        if np.count_nonzero(live) <= _DENSE * live.size:
            break
    else:
        live = total >= to_beat[:, None]
    query, row = np.nonzero(live)
    found = total[query, row]
    for c in range(b, steps):
        found += np.einsum("ij,ij->i", asks.parts[c][query], rows.parts[c][row])
        bound = found + asks.rest[c + 1][query] * rows.rest[c + 1][row] * (1 + 1e-9) + 0.5
        keep = np.flatnonzero(bound >= to_beat[query])
        query, row, found = query[keep], row[keep], found[keep]
    return query, row, found


def _search(rows: np.ndarray, asks: np.ndarray, ids, own, best: Best) -> None:
    """Bring all rows that may be among the best of a query into ``best``.

    ``own[q]`` is the row a query must not find, or -1."""
    mass = np.einsum("ij,ij->i", rows, rows)
    by_mass = np.argsort(-mass, kind="stable")
    order = np.argsort(-np.einsum("ij,ij->j", rows, rows), kind="stable")
    store, questions = Vertical(rows[by_mass], order), Vertical(asks, order)
    for a in range(0, len(asks), _PART_QUERIES):
        some = slice(a, a + _PART_QUERIES)
        part = questions.take(some)
        for r in range(0, len(rows), _PART_ROWS):
            here = by_mass[r : r + _PART_ROWS]
            query, row, found = _survivors(store.take(slice(r, r + _PART_ROWS)), part, best.score[some])
            query, row = query + a, here[row]
            other = own[query] != row
            best.add(query[other], found[other], row[other], ids)


def _search_wide(rows: np.ndarray, asks: np.ndarray, ids, own, best: Best) -> list[int]:
    """The same for products beyond what doubles hold exactly: whole numbers of any
    size, one query at a time. Returns the scores in order of ``best``."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    whole = np.array([[int(x) for x in r] for r in rows.tolist()], dtype=object).reshape(rows.shape)
    query, row, found = [], [], []
    for q, ask in enumerate(asks.tolist()):
        exact = [min(max(int(s), low), high) for s in whole @ np.array([int(x) for x in ask], dtype=object)]
        ranked = sorted((i for i in range(len(rows)) if i != own[q]), key=lambda i: (-exact[i], ids[i]))
        for i in ranked[: best.k]:
            query.append(q)
            row.append(i)
            found.append(exact[i])
    best.query, best.row = np.array(query, np.int64), np.array(row, np.int64)
    return found


def _cell(k: int, scale: float):
    """Best rows of one block of rows for one block of queries."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["q", "query_id", "query_copies", "id", "score", "copies"]
        if not len(rows) or not len(asks):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        width = max(_widest(rows["vector"]), _widest(asks["vector"]))
        store, questions = _matrix(rows["vector"], scale, width), _matrix(asks["vector"], scale, width)
        # One copy of the query's own row is the query itself.
        uid, copies = rows["uid"].to_numpy(), rows["copies"].to_numpy()
        known = np.argsort(uid)
        at = known[np.minimum(np.searchsorted(uid[known], asks["uid"].to_numpy()), len(uid) - 1)]
        at = np.where(uid[at] == asks["uid"].to_numpy(), at, -1)
        own = np.where((at >= 0) & (copies[at] == 1), at, -1)
        ids = rows["id"].fill_null(_LAST_ID).to_numpy()
        least = asks["to_beat"].to_pandas().to_numpy(np.float64, na_value=-np.inf)
        last = asks["last"].fill_null(_LAST_ID).to_numpy().copy()
        best = Best(k, least.copy(), last)
        largest = np.abs(store).max(initial=0.0) * np.abs(questions).max(initial=0.0)
        if largest * max(width, 1) < _EXACT:
            _search(store, questions, ids, own, best)
            found = best.found.astype(np.int64)
        else:
            found = _search_wide(store, questions, ids, own, best)
        others = copies[best.row] - (at[best.query] == best.row)
        release()
        return pa.table(
            {
                "q": asks["uid"].take(pa.array(best.query)),
                "query_id": asks["id"].take(pa.array(best.query)),
                "query_copies": asks["copies"].take(pa.array(best.query)),
                "id": rows["id"].take(pa.array(best.row)),
                "score": pa.array(found, pa.int64()),
                "copies": pa.array(others, pa.int64()),
            }
        )

    return run


def _round(rows: DataFrame, asks: DataFrame, sizes: tuple[int, int], k: int, scale: float) -> DataFrame:
    """Best rows of every cell of the grid; ``sizes`` are its blocks of rows and of queries."""
    down, across = sizes
    conf = rows.sparkSession.conf
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(down * across, max(int(conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    row_block = F.pmod(F.xxhash64("uid"), F.lit(down)).cast("int")
    ask_block = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(across)).cast("int")
    left = rows.select("*", row_block.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"))
    fresh = [F.col(n).alias(n) for n in asks.columns]  # both sides come from one table
    right = asks.select(*fresh, ask_block.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    left, right = (t.repartition(tasks, "r", "c") for t in (left, right))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(_cell(k, scale), _SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query, a row that occurs several times as often as it does."""
    each = found.withColumn("_", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).drop("_")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    asks: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the largest integer inner product.

    Queries are the rows for which ``asks`` is true; each is answered from all other rows.
    Ties go to the smaller id, a null id comes last. A vector that is null or has a null
    or non-finite component (also after scaling) takes no part. Vectors of different
    length are compared as if the shorter one had zeros behind it, so an empty vector
    scores 0. Rows that are stored several times are rows of their own: they find each
    other, and a query that is stored several times is answered as often. A score beyond
    64 bits is given as the nearest 64-bit integer. Fewer than ``k`` other rows are all
    returned; an empty table gives no rows. Other columns play no part, whatever their
    names. Two jobs run first: rows are counted once by id and vector and stored, then
    their number is read, which sets the number of blocks.
    """
    spark = rows.sparkSession
    vector = rows[vector_col]
    usable = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(scale)) < F.lit(float("inf")))
    )
    plain = rows.where(F.coalesce(usable, F.lit(False))).select(
        rows[id_col].cast("bigint").alias("id"), vector.alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    counted = plain.groupBy("id", "vector", "asks").agg(F.count(F.lit(1)).alias("copies"))
    table = stored(counted.withColumn("uid", F.monotonically_increasing_id()), "top-k")
    n, n_asks = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).head()
    cores = spark.sparkContext.defaultParallelism
    down = max(-(-n // block_rows), min(-(-n // _PART_ROWS), 8 * cores), 1)
    across = max(-(-n_asks // block_queries), 1)
    queries = table.where("asks").select("uid", "id", "vector", "copies")
    store = table.select("uid", "id", "vector", "copies")
    some = store.where(F.pmod(F.xxhash64("uid", F.lit(2)), F.lit(_FIRST)) == 0)
    none = [F.lit(None).cast("double").alias("to_beat"), F.lit(None).cast("bigint").alias("last")]
    first = _ranked(_round(some, queries.select("*", *none), (-(-down // _FIRST), across), k, scale), k)
    least = first.where(F.col("rank") == k).select(
        F.col("q").alias("uid"), F.col("score").cast("double").alias("to_beat"), F.col("id").alias("last")
    )
    known = queries.join(least, "uid", "left")
    best = _ranked(_round(store, known, (down, across), k, scale), k)
    again = F.explode(F.sequence(F.lit(1), F.col("query_copies").cast("int")))
    return best.withColumn("_", again).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
