"""Near copies: exact Jaccard join on word shingles, candidates by chosen paths.

Texts with the same set of five-word shingles form one *set*; the rest works on
different sets only. In each run a set walks down a tree: at a node one token
is sampled from it (the shingle with the least hash under a key that belongs to
the node), and sets that sample the same token go on together; two sets do so
with a probability equal to their similarity. A group of at most ``leaf_size``
sets is a leaf and compared by brute force; a larger one is split again, unless
splitting leaves it nearly whole: then its sets are alike, and it is compared in
blocks of that size. Runs are repeated for every set until a partner of the
least similarity is met with the target probability: after runs with leaves at
depths ``d`` it is missed with at most the product of ``1 - s ** d``. Sets that the
first runs leave above that go through one more row of runs, with hashes of their
own and with leaves no deeper than that number of runs can answer for.

Sampled tokens come from a row of 64 least hashes per set, so walking moves only
that row; the texts of sets that have a likely partner are fetched at the end,
and their similarity is computed exactly. A pair that shares several leaves is
counted in the first. Neither pairs nor groups are expanded: a leaf returns the
number of links of each of its sets and a forest that spans them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .text import encoded, release, shingle_hashes, sliced, text_parts, words_of

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
LEAF_SIZE = 1024
RUNS_PER_ROUND = 6
FIRST_RUNS = 48  # by the hashes of the prints; as many follow for sets that need more
HOT_SHARE = 1024  # a node with more than one in so many rows is split over tasks
_SALTS = 64
_TOKENS = 64
_DEEPEST = 16


@cache
def _keys(series: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(10 + series)
    xor = rng.integers(0, 2**64, _TOKENS, dtype=np.uint64)
    return xor, rng.integers(0, 2**63, _TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_equal(similarity: float) -> int:
    """Of 64 least hashes so many are equal, but for a probability below 1e-6, in sets as similar as that."""
    below = 0.0
    for m in range(_TOKENS):
        below += math.comb(_TOKENS, m) * similarity**m * (1 - similarity) ** (_TOKENS - m)
        if below >= 1e-6:
            return m
    return _TOKENS


def depth_for(similarity: float, recall: float, runs: int) -> int:
    """The deepest leaves with which so many runs reach the recall; 0 if none do."""
    least = -math.expm1(math.log1p(-recall) / runs) if recall < 1 else 1.0  # of similarity ** depth
    depth = 0
    while depth < _DEEPEST and similarity ** (depth + 1) >= least:
        depth += 1
    return depth


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer than ``size`` words, but not none, is one shingle.
    """
    for part in sliced(texts):
        words = words_of(part)
        hashes = words.hashes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b > a:
                yield np.unique(shingle_hashes(hashes[a:b], min(size, b - a)))
            else:
                yield np.zeros(0, np.uint64)


def least_hashes(shingles: np.ndarray, series: int = 0) -> np.ndarray:
    """The least hash under each of the 64 keys of a series, as 32-bit values."""
    xor, mul = _keys(series)
    least = np.full(_TOKENS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            keyed = (shingles[a : a + 2048, None] ^ xor) * mul
            least = np.minimum(least, keyed.min(0))
    return (least >> np.uint64(32)).astype("<u4")


def _fingerprint(size: int):
    @F.arrow_udf("struct<key:binary,size:int,marks:binary>")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            keys, sizes, marks = [], [], []
            for part in text_parts(texts):
                for shingles in shingle_sets(part, size):
                    full = len(shingles) > 0
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if full else None)
                    sizes.append(len(shingles))
                    marks.append(least_hashes(shingles).tobytes() if full else None)
            yield pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())],
                names=["key", "size", "marks"],
            )
        release()

    return fingerprint.asNondeterministic()


def _marks(size: int, series: int):
    @F.arrow_udf("binary")
    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [least_hashes(s, series).tobytes() for part in text_parts(texts) for s in shingle_sets(part, size)]
            yield pa.array(rows, pa.binary())
        release()

    return marks.asNondeterministic()


def _token(marks: Column, which: Column) -> Column:
    return F.substring(marks, (4 * which + 1).cast("int"), F.lit(4))


def _with_counts(rows: DataFrame, leaf_size: int) -> DataFrame:
    """Rows of nodes with more than one set, and how many the node has (``n``).

    A hot node has more than one in ``HOT_SHARE`` of the rows, so there are at most
    that many; their rows meet the count in ``_SALTS`` parts.
    """
    counts = stored(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-counts")
    total, most = counts.agg(F.sum("n"), F.max("n")).head()
    least = max(leaf_size, (total or 0) // HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(counts, "path")
    hot = F.broadcast(counts.where(F.col("n") > least).select("path", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(_SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, "path", "left").withColumn("salt", salt).drop("hot")
    return dealt.join(counts.withColumn("salt", F.explode(salts)), ["path", "salt"]).drop("salt")


def _walk(sets: DataFrame, active: DataFrame, runs: range, similarity: float, leaf_size: int, deepest: int):
    """Leaves (path, run, n, key) of more than one set, and nodes (key, run, depth) that were split."""
    first = F.pmod(F.col("run"), F.lit(FIRST_RUNS))
    rows = (
        active.join(sets.select("key", "marks"), "key")
        .select("key", "marks", F.explode(F.array(*map(F.lit, runs))).alias("run"))
        .withColumn("path", F.xxhash64("run", _token(F.col("marks"), first)))
        .withColumn("above", F.lit(None).cast("bigint"))
    )
    leaves, split = [], []
    for depth in range(1, deepest + 1):
        level = stored(_with_counts(rows.drop("marks"), leaf_size), "near-level")
        done = (F.col("n") <= leaf_size) | F.coalesce(F.col("n") >= similarity * F.col("above"), F.lit(False))
        done = F.lit(True) if depth == deepest else done
        leaves.append(level.where(done).select("path", "run", "n", "key"))
        wide = level.where(~done)
        if wide.head() is None:
            break
        split.append(wide.select("key", "run", F.lit(depth).alias("depth")))
        which = F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(_TOKENS))
        rows = wide.join(sets.select("key", "marks"), "key").select(
            "key",
            "marks",
            "run",
            F.xxhash64("path", _token(F.col("marks"), which)).alias("path"),
            F.col("n").alias("above"),
        )
    return leaves, split


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _leaves(sets: DataFrame, remarked, similarity: float, recall: float, leaf_size: int) -> tuple[DataFrame, int]:
    """Leaves of all runs, with large ones in pairs of blocks (i, j), and the number of runs.

    ``block`` is the row's own. ``remarked(active)`` gives sets (key, marks) new hashes.
    """
    step = RUNS_PER_ROUND
    while step < FIRST_RUNS and not depth_for(similarity, recall, step):
        step += 1  # sets that are never split reach the recall in their first round
    last_depth = depth_for(similarity, recall, FIRST_RUNS)
    if not last_depth:
        raise ValueError(f"{FIRST_RUNS} runs do not find partners of similarity {similarity} with probability {recall}")
    rounds = [(range(a, min(a + step, FIRST_RUNS)), _DEEPEST) for a in range(0, FIRST_RUNS, step)]
    rounds.append((range(FIRST_RUNS, 2 * FIRST_RUNS), last_depth))
    active, leaves, missed = sets.select("key"), [], None
    log = lambda depth: F.log1p(-F.pow(F.lit(similarity), depth))
    for runs, deepest in rounds:
        marked = sets if runs.start < FIRST_RUNS else stored(remarked(active), "near-remarked")
        found, split = _walk(marked, active, runs, similarity, leaf_size, deepest)
        leaves += found
        if not split or runs.start >= FIRST_RUNS:
            break
        # A set that was never split has met its partners.
        deep = _all(split).groupBy("key", "run").agg((F.max("depth") + 1).alias("depth")).groupBy("key")
        deep = deep.agg(F.sum(log(F.col("depth"))).alias("log"), F.count(F.lit(1)).alias("runs"))
        deep = deep.select(
            "key", (F.col("log") + (len(runs) - F.col("runs")) * log(F.lit(1))).alias("log")
        )
        if missed is not None:
            deep = deep.unionAll(missed.join(deep.select("key"), "key")).groupBy("key").agg(F.sum("log").alias("log"))
        missed = stored(deep.where(F.col("log") > math.log(1 - recall)), "near-missed")
        active = missed.select("key")
        if missed.head() is None:
            break
    blocks = F.ceil(F.col("n") / F.lit(leaf_size / 2)).cast("int")
    blocks = F.when(F.col("n") <= leaf_size, F.lit(1)).otherwise(blocks)
    rows = _all(leaves).withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "run", "key"
    )
    return rows, runs.stop


_GROUP = ["path", "i", "j"]


def _per_group(rows: DataFrame, f, schema: str) -> DataFrame:
    """Apply ``f(table)`` to the rows of each (path, i, j); many groups are small."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if open_group is None else pa.concat_tables([open_group, table])
            cut = np.zeros(max(0, len(table) - 1), bool)
            for name in _GROUP:
                values = table[name].to_numpy()
                cut |= values[1:] != values[:-1]
            bounds = [0, *(np.flatnonzero(cut) + 1).tolist()]
            done = [f(table.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False)]
            open_group = table.slice(bounds[-1])
            if done:
                yield from pa.concat_tables(done).to_batches()
        if open_group is not None and len(open_group):
            yield from f(open_group).to_batches()
        release()

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(apply, schema)


def _pairs(table: pa.Table, alike) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the group compares and ``alike(a, rows b)`` accepts, some at a time."""
    block = table["block"].to_numpy()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for at, a in enumerate(left.tolist()):
        others = right if i != j else right[at + 1 :]
        if len(others):
            yield a, others[alike(a, others)]


def _likely(table: pa.Table, similarity: float):
    marks = np.frombuffer(b"".join(table["marks"].to_pylist()), "<u4").reshape(-1, _TOKENS)
    size, least = table["size"].to_numpy(), least_equal(similarity)

    def alike(a: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size[others], size[a]), np.maximum(size[others], size[a])
        return (small >= similarity * large - 1e-9) & ((marks[others] == marks[a]).sum(1) >= least)

    return alike


def _likely_rows(similarity: float):
    """Rows of a leaf that have a likely partner in it."""

    def choose(table: pa.Table) -> pa.Table:
        keep = np.zeros(len(table), bool)
        if len(table) > 1:
            for a, others in _pairs(table, _likely(table, similarity)):
                if len(others):
                    keep[a] = keep[others] = True
        return table.filter(pa.array(keep)).select([*_GROUP, "block", "run", "key"])

    return choose


def _verified(similarity: float, size: int, runs: int):
    """Links and a spanning forest of a leaf: key, links, root."""

    def verify(table: pa.Table) -> pa.Table:
        n = len(table)
        sets = list(shingle_sets(encoded(table["text"].combine_chunks()), size))
        paths = table["paths"].combine_chunks().flatten().to_numpy().reshape(n, runs)
        run, copies = table["run"][0].as_py(), table["copies"].to_numpy()
        likely = _likely(table, similarity)
        links, root = np.zeros(n, np.int64), list(range(n))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        # Shingles by number; the rows that hold each, so that a row's overlaps with
        # all others are one count over the rows of its shingles.
        number = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, int)
        ends = np.cumsum([len(s) for s in sets])
        holder = np.repeat(np.arange(n), [len(s) for s in sets])
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
        holder = holder[order]
        for a, others in _pairs(table, likely):
            if run:  # a pair that shares an earlier leaf was counted there
                earlier = (paths[others, :run] == paths[a, :run]) & (paths[a, :run] != 0)
                others = others[~earlier.any(1)]
            if not len(others):
                continue
            own = sets[a]
            if len(others) <= 16:
                common = np.array([len(np.intersect1d(own, sets[b], assume_unique=True)) for b in others])
            else:
                mine = number[ends[a] - len(own) : ends[a]]
                rows = np.concatenate([holder[bounds[k] : bounds[k + 1]] for k in mine.tolist()])
                common = np.bincount(rows, minlength=n)[others]
            sizes = np.array([len(sets[b]) for b in others])
            # common / union >= similarity, in whole numbers up to rounding of the threshold
            linked = others[common >= similarity * (len(own) + sizes - common) - 1e-9]
            links[a] += copies[linked].sum()
            links[linked] += copies[a]
            for b in linked.tolist():
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        keys = table["key"].to_pylist()
        some = np.flatnonzero(links).tolist()
        return pa.table(
            {
                "key": pa.array([keys[x] for x in some], pa.binary()),
                "links": pa.array([int(links[x]) for x in some], pa.int64()),
                "root": pa.array([keys[top(x)] for x in some], pa.binary()),
            }
        )

    return verify


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): nodes joined by edges have the same label.

    Every node moves to its least neighbour and the graph is contracted, until
    no edge is left.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    labels = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(
            both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")),
            "near-step",
        )
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            labels = (
                labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left")
                .select("node", F.coalesce("to", "label").alias("label"))
            )
        left, right = (
            step.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("a", "b")
        )
        pairs = stored(
            pairs.join(left, "a").join(right, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct(),
            "near-edges",
        )
        if pairs.head() is None:
            return stored(labels, "near-labels")


def _classes(
    named: DataFrame, size: int, similarity: float, recall: float, leaf_size: int
) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text): their prints (id, key, digest, ...) and, per shingle set, (key,
    low, digest, class_key, class_id, n_links). ``low`` and ``digest`` tell the row of the
    set that comes first by id, then by digest of the text; both tables are stored."""
    prints = named.withColumn("print", _fingerprint(size)(F.col("text")))
    prints = prints.select("id", "print.*", _digest(F.col("text")).alias("digest"))
    prints = stored(prints, "near-prints")
    sets = prints.where("key IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("id", "digest")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"),
        F.first("marks").alias("marks"),
    )
    sets = sets.select("*", F.col("first.id").alias("low"), F.col("first.digest").alias("digest")).drop("first")
    sets = stored(sets, "near-sets")

    def texts_of(some: DataFrame) -> DataFrame:
        """(key, text): one text of each of ``some`` sets."""
        wanted = some.select(F.col("low").alias("id"), "digest", "key")
        texts = named.withColumn("digest", _digest(F.col("text"))).join(wanted, ["id", "digest"])
        return texts.groupBy("key").agg(F.first("text").alias("text"))

    def remarked(active: DataFrame) -> DataFrame:
        texts = texts_of(active.join(sets, "key"))
        return texts.select("key", _marks(size, 1)(F.col("text")).alias("marks"))

    leaves, runs = _leaves(sets, remarked, similarity, recall, leaf_size)
    leaves = leaves.join(sets.select("key", "size", "marks"), "key")
    likely = stored(
        _per_group(
            leaves, _likely_rows(similarity), "path bigint, i int, j int, block int, run int, key binary"
        ),
        "near-likely",
    )

    by_run = F.map_from_entries(F.collect_set(F.struct("run", "path")))
    chosen = likely.groupBy("key").agg(by_run.alias("by_run"))
    of_run = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.col("by_run")[r], F.lit(0)))
    chosen = chosen.select("key", of_run.alias("paths")).join(sets, "key")
    full = likely.join(chosen.select("key", "copies", "size", "marks", "paths").join(texts_of(chosen), "key"), "key")
    verified = _per_group(full, _verified(similarity, size, runs), "key binary, links bigint, root binary")
    verified = stored(verified, "near-verified")

    labels = components(verified.select("key", "root"), "key", "root")
    total = verified.groupBy("key").agg(F.sum("links").alias("links"))
    linked = total.join(labels.withColumnRenamed("node", "key"), "key").join(sets.select("key", "low"), "key")
    lows = linked.groupBy("label").agg(F.min("low").alias("class_low"))
    linked = linked.join(lows, "label").select("key", "label", "links", "class_low")
    classes = sets.select("key", "low", "digest", "copies").join(linked, "key", "left")
    classes = classes.select(
        "key",
        "low",
        "digest",
        F.coalesce("label", "key").alias("class_key"),
        F.coalesce("class_low", "low").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    classes = stored(classes, "near-classes")
    return prints, classes


def _digest(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    leaf_size: int = LEAF_SIZE,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id`` and ``n_links``.

    ``n_links`` counts the other rows whose shingle set has a Jaccard similarity
    of at least ``similarity`` (equal sets included), ``class_id`` is the least
    id of all rows that are joined by links, directly or through others.

    Words as in ``text``; a text of fewer than ``size`` words is one shingle of
    all its words. Null and word-free texts are similar to nothing: each is its
    own class without links. Rows without id take no part and get a null class
    and 0 links. Repeated rows link each other. Other columns are not used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, classes = _classes(rows.where("id IS NOT NULL"), size, similarity, recall, leaf_size)
    classes = classes.select("key", "class_id", "n_links")
    full = prints.where("key IS NOT NULL").select("id", "key").join(classes, "key")
    empty = prints.where("key IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    nameless = rows.where("id IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    out = full.select("id", "class_id", "n_links").unionAll(empty).unionAll(nameless)
    return out.withColumnRenamed("id", id_col)


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    leaf_size: int = LEAF_SIZE,
) -> DataFrame:
    """The rows of ``docs`` that are left when one row of each class of near copies stays.

    The row with the least id of the class stays (ties: the least MD5 of the text). Rows are
    told apart by id and text, so two texts under one id are decided on their own, and of
    rows that agree in both any one stays. Texts without words are no one's copy, nor are
    rows without id: the latter all stay. All columns are kept, whatever their names. Equal
    rows are put together before the shuffle, so one row stored very often is no hot task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints, classes = _classes(rows.where("id IS NOT NULL"), size, similarity, recall, leaf_size)
    first = classes.groupBy("class_key").agg(F.min(F.struct("low", "digest")).alias("first"))
    wanted = first.select(F.col("first.low").alias("id"), F.col("first.digest").alias("digest"))
    wanted = wanted.unionAll(prints.where("key IS NULL").select("id", "digest").distinct())
    once = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("digest"))
    once = once.agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    kept = once.join(wanted, ["id", "digest"], "left_semi").select("row.*")
    return kept.unionAll(docs.where(F.col(id_col).isNull()))
