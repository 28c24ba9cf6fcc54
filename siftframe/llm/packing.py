"""Pack token sequences of documents into as few sequences of a fixed length as possible.

The histogram of piece lengths has at most as many rows as a sequence has
tokens, however many documents there are, so the plan is made from it alone:

1. the *configuration linear program* (how often to use each way to fill a
   sequence) is solved by multiplicative weights: a length's weight falls as it
   gets covered, and the next configuration is the one of most weight, found by
   a knapsack dynamic program over the capacity;
2. its solution is *rounded* down, and what is left over is put into the gaps
   and new sequences by best fit, longest first, many equal pieces at a time.

Pieces then take their places by rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import SLICE_BYTES, open_tokenizer
from .storage import stored
from .text import release, text_parts

CAPACITY = 2048
ROUNDS = 100
_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>"


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, with_ids: bool
) -> DataFrame:
    """Token pieces of every document: its ids and a closing 0, cut only if longer than ``capacity``."""

    @F.arrow_udf(_PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(
            pa.struct(
                [
                    ("piece", pa.int32()),
                    ("start", pa.int64()),
                    ("length", pa.int64()),
                    ("ids_crc32", pa.int64()),
                    ("ids", pa.list_(pa.int32())),
                ]
            )
        )
        tok = open_tokenizer(tokenizer)
        for texts in batches:
            rows = []
            for part in text_parts(texts, SLICE_BYTES):
                ids, first = tok.encode(part)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], 0).astype("<u4")
                    out = []
                    for k, start in enumerate(range(0, len(own), capacity)):
                        some = own[start : start + capacity]
                        out.append(
                            {
                                "piece": k,
                                "start": start,
                                "length": len(some),
                                "ids_crc32": zlib.crc32(some.tobytes()),
                                "ids": some.astype(np.int32).tolist() if with_ids else None,
                            }
                        )
                    rows.append(out)
            yield pa.array(rows, kind)
        release()

    rows = docs.select(F.col(id_col).alias("id"), cut.asNondeterministic()(F.col(text_col)).alias("pieces"))
    rows = rows.select("id", F.explode("pieces").alias("p")).select("id", "p.*")
    return rows if with_ids else rows.drop("ids")


def _priced(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the most value within each capacity, and a length that begins it."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = best[c - 1 :: -1] + value[1 : c + 1]
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], choice[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def _filling(choice: np.ndarray, capacity: int) -> Counter:
    """The lengths of a most valuable filling of ``capacity``."""
    found: Counter = Counter()
    while capacity > 0:
        found[int(choice[capacity])] += int(choice[capacity] > 0)
        capacity -= int(choice[capacity]) or 1
    return +found


def fractional_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations ((length, copies), ...) and how often to use each, by multiplicative weights.

    No length is covered more often than it occurs. The weight of a length begins
    at the length itself (the prices of a plan without any gap) and falls as
    it gets covered. A round prices all fillings once, then raises those that
    come within a twentieth of the best, one for each length they begin with.
    """
    n = np.zeros(capacity + 1)
    for length, count in histogram.items():
        n[length] = count
    left, plan = n.copy(), defaultdict(float)
    sizes = np.arange(capacity + 1) / capacity
    share = np.divide(1.0, n, out=np.zeros_like(n), where=n > 0)
    for _ in range(rounds):
        weight = sizes * (1 + 0.01 * sizes) * np.exp(-0.2 * (1 - left * share))
        value = np.where(left >= 1, weight, 0.0)
        best, choice = _priced(value, capacity)
        lengths = np.flatnonzero(value)[::-1]
        raised = 0
        for length in lengths[value[lengths] + best[capacity - lengths] >= 0.95 * best[capacity]].tolist():
            config = _filling(choice, capacity - length)
            config[length] += 1
            limit = min(left[x] / k for x, k in config.items())
            if limit < 1:
                continue
            amount = max(1.0, 0.25 * limit)
            plan[tuple(sorted(config.items(), reverse=True))] += amount
            for x, k in config.items():
                left[x] -= k * amount
            raised += 1
        if not raised:
            break
    return dict(plan)


def whole_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> dict[tuple, int]:
    """Configurations and how many sequences use each; together they hold exactly the histogram."""
    left = {length: count for length, count in histogram.items() if count > 0}
    full = left.pop(capacity, 0)
    bins: dict[int, Counter] = defaultdict(Counter)  # free space -> configurations with it
    for config, amount in fractional_plan(left, capacity, rounds).items():
        if whole := int(amount + 1e-9):
            bins[capacity - sum(length * k for length, k in config)][config] += whole
            for length, k in config:
                left[length] -= k * whole
    spaces = np.zeros(capacity + 1, bool)
    spaces[list(bins)] = True
    for length in sorted(left, reverse=True):
        rest = left[length]
        while rest > 0:
            fit = np.flatnonzero(spaces[length:])
            if len(fit):
                space = length + int(fit[0])
                config = next(iter(bins[space]))
                some = min(rest, bins[space][config])
                bins[space][config] -= some
                if not bins[space][config]:
                    del bins[space][config]
                    spaces[space] = bool(bins[space])
                wider = Counter(dict(config))
                wider[length] += 1
                made = [(tuple(sorted(wider.items(), reverse=True)), space - length, some)]
                rest -= some
            else:
                per = capacity // length
                whole, odd = divmod(rest, per)
                made = [(((length, per),), capacity - per * length, whole), (((length, odd),), capacity - odd * length, 1)]
                made = [m for m in made if m[2] and m[0][0][1]]
                rest = 0
            for config, space, some in made:
                bins[space][config] += some
                spaces[space] = True
    out = Counter({config: k for some in bins.values() for config, k in some.items()})
    if full:
        out[((capacity, 1),)] += full
    return dict(out)


class Places:
    """Where the piece of each rank within its length goes."""

    def __init__(self, plan: dict[tuple, int]):
        rows: dict[int, list] = defaultdict(list)
        taken: Counter = Counter()
        sequence = 0
        for config, times in sorted(plan.items(), reverse=True):
            offset = 0
            for length, k in config:
                rows[length].append((taken[length], k, sequence, offset))
                taken[length] += k * times
                offset += k * length
            sequence += times
        self.rows = {length: np.array(r, np.int64).T for length, r in rows.items()}
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            own = length == size
            first, k, base, start = self.rows[size]
            at = np.searchsorted(first, rank[own], "right") - 1
            number = rank[own] - first[at]
            sequence[own] = base[at] + number // k[at]
            offset[own] = start[at] + number % k[at] * size
        return sequence, offset


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    rounds: int = ROUNDS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's tokens are the ids of its text and a closing 0; null and empty
    texts are the 0 alone. Only documents over ``capacity`` tokens are cut, into
    pieces of that length but for the last. The pieces of a sequence follow each
    other without gap from offset 0. Rows with a null id and repeated rows are
    packed like any other. Without rows the result is empty. Other columns are
    not used. ``tokenizer`` is a file of the ``tokenizers`` library that every
    executor has.
    """
    spark = docs.sparkSession
    numbered = pieces(docs, tokenizer, id_col, text_col, capacity, with_ids).withColumn("row", F.monotonically_increasing_id())
    cut = stored(numbered, "pack-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    total = sum(histogram.values())
    places = spark.sparkContext.broadcast(Places(whole_plan(histogram, capacity, rounds)))

    # Ranks within a length are counted in groups of bounded size, so that a length
    # that many pieces have is no single task, nor is a row that is stored many times:
    # groups go by the stored number of the row. There are at most 1000 groups more than
    # lengths, or one more per million pieces.
    most = min(1_000_000, max(256, total // 1000))
    groups = {length: -(-count // most) for length, count in histogram.items()}
    split = F.create_map(*(F.lit(x) for pair in groups.items() for x in pair)) if groups else None
    if split is None:
        salted = cut.withColumn("salt", F.lit(0).cast("bigint"))
    else:
        salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), split[F.col("length")].cast("bigint")))
    sizes = salted.groupBy("length", "salt").count().collect()
    first, taken = {}, Counter()
    for r in sorted(sizes, key=lambda r: (r["length"], r["salt"])):
        first[r["length"], r["salt"]] = taken[r["length"]]
        taken[r["length"]] += r["count"]
    starts = spark.sparkContext.broadcast(first)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        base = np.array(
            [starts.value[k] for k in zip(length.to_pylist(), salt.to_pylist(), strict=True)], np.int64
        )
        sequence, offset = places.value.of(length.to_numpy(zero_copy_only=False), base + rank.to_numpy(zero_copy_only=False) - 1)
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("bigint"))
    placed = ranked.withColumn("place", place.asNondeterministic()("length", "salt", "rank"))
    return placed.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        "place.sequence_id",
        "place.offset",
        *(["ids"] if with_ids else []),
    )
