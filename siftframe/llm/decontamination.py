"""Find passages of test items in documents: Wu-Manber multi-pattern search.

Every item gives windows of 13 consecutive words (fewer words: one window).
Texts are searched as bytes in a form in which each word is followed by one
blank, so a window is a byte string and an occurrence that begins at a word is
an occurrence of the words. Patterns of similar length share one search:

* the *shift table* tells from the block of bytes at the end of the current
  position how far the search may skip, as no pattern has that block nearer to
  the end of its first ``m`` bytes (``m``: the shortest length);
* where it says 0, the *bucket* of patterns that end in a block of this hash is
  looked up, their first bytes are compared, and at last the whole strings.

Thousands of positions advance side by side, each in a lane of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _IN_WORD, LOWER, release, text_parts, WORD_PATTERN

WINDOW_WORDS = 13
BLOCK_BYTES = 32 << 20
_LANE = 512
_END = 10  # between texts; words are followed by a blank
_SCHEMA = "struct<n_words:bigint,n_hit:bigint,items:array<string>,starts:array<int>,ends:array<int>>"


def words_column(text: Column) -> Column:
    """The words of a text, by built-in functions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(text, upper, lower), F.lit(WORD_PATTERN), 0)


def windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (window, item): ``size`` words, each followed by a blank."""
    words = items.select(
        F.col(id_col).cast("string").alias("item"), words_column(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size + 1, F.lit(1))
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(1), last)).alias("start"))
    window = F.concat(F.array_join(F.slice("words", F.col("start"), size), " "), F.lit(" "))
    return starts.select(window.alias("window"), "item").distinct()


class Search:
    """Tables for the patterns of one length class ``[m, 2 m)``."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = min(8, m)
        bits = int(np.clip(np.log2(max(1, len(patterns) * m)) + 3, 8, 22))
        self.down = np.uint64(64 - bits)
        self.most = min(255, m - self.block + 1)
        shift = np.full(1 << bits, self.most, dtype=np.uint8)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        for skip in range(self.most - 1, -1, -1):
            end = m - skip
            shift[self.hashed(_blocks(heads[:, end - self.block : end]))] = skip
        self.shift = shift
        suffix = self.hashed(_blocks(heads[:, m - self.block :]))
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.heads = _blocks(heads[:, : self.block])[self.order]

    def hashed(self, blocks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def occurrences(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Positions and numbers of the patterns that begin at a word of ``data``."""
        last = len(data) - self.m
        if last < 0:
            return
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        blocks = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), 0, (1,))
        keep = np.uint64((1 << (8 * self.block)) - 1)
        at = np.arange(0, last + 1, _LANE)
        stop = np.minimum(at + _LANE, last + 1)
        zero = []
        while len(at):
            skip = self.shift[self.hashed(blocks[at + (self.m - self.block)] & keep)]
            hit = skip == 0
            if hit.any():
                zero.append(at[hit])
            at = at + np.maximum(skip, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        if not zero:
            return
        found = np.concatenate(zero)
        before = padded[found - 1]
        found = found[(found == 0) | (before == 32) | (before == _END)]
        suffix = self.hashed(blocks[found + (self.m - self.block)] & keep)
        head = blocks[found] & keep
        low, high = np.searchsorted(self.suffix, suffix), np.searchsorted(self.suffix, suffix, "right")
        raw = memoryview(padded)
        while len(found):
            some = low < high
            found, head, low, high = found[some], head[some], low[some], high[some]
            same = self.heads[low] == head if len(low) else np.zeros(0, bool)
            for p, k in zip(found[same].tolist(), self.order[low[same]].tolist(), strict=True):
                pattern = self.patterns[k]
                if raw[p : p + len(pattern)] == pattern:
                    yield p, k
            low = low + 1


def _blocks(part: np.ndarray) -> np.ndarray:
    """Rows of at most eight bytes as little-endian integers."""
    wide = np.zeros((len(part), 8), np.uint8)
    wide[:, : part.shape[1]] = part
    return wide.view("<u8")[:, 0]


class Matcher:
    """All patterns of a block, by classes of length, and the items they stand for."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        items: dict[bytes, list[str | None]] = {}
        for window, item in pairs:
            items.setdefault(window.encode(), []).append(item)
        classes: dict[int, list[bytes]] = {}
        for pattern in sorted(items):
            classes.setdefault(len(pattern).bit_length(), []).append(pattern)
        self.searches = [Search(c) for c in classes.values()]
        self.items = [[items[p] for p in s.patterns] for s in self.searches]
        self.sizes = [[p.count(b" ") for p in s.patterns] for s in self.searches]

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: number of words, hit spans of words (end exclusive), items."""
        joined = b" \n" + b" \n".join(texts) + b" \n"
        data = LOWER[np.frombuffer(joined, np.uint8)]
        inside = _IN_WORD[data]
        begin = np.cumsum([1] + [len(t) + 2 for t in texts])
        data[~inside] = 32
        data[begin] = _END
        keep = inside
        keep[1:] |= _IN_WORD[data[:-1]]
        keep[begin] = True
        data = data[keep]
        blanks, begin = np.flatnonzero(data == 32), np.flatnonzero(data == _END)
        first = np.searchsorted(blanks, begin)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for search, names, sizes in zip(self.searches, self.items, self.sizes, strict=True):
            found = list(search.occurrences(data))
            if not found:
                continue
            place = np.array([p for p, _ in found])
            number, text = np.searchsorted(blanks, place), np.searchsorted(begin, place) - 1
            for (_, k), w, t in zip(found, number.tolist(), text.tolist(), strict=True):
                at = w - int(first[t])
                spans[t].append((at, at + sizes[k]))
                items[t].update(x for x in names[k] if x is not None)
        counts = np.diff(first).tolist()
        return [(n, merged(s), i) for n, s, i in zip(counts, spans, items, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(source):
    """An Arrow function that searches texts with the patterns ``source.value`` holds."""
    kept: list[Matcher] = []

    @F.arrow_udf(_SCHEMA)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not kept:
            kept.append(Matcher(source.value))
        for texts in batches:
            rows = [r for part in text_parts(texts) for r in kept[0].search(part)]
            spans = [r[1] for r in rows]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                    pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32())),
                    pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32())),
                ],
                names=["n_words", "n_hit", "items", "starts", "ends"],
            )
        release()

    return scan.asNondeterministic()


def _union(spans: Column) -> Column:
    """Union of an array of {start, end}, in order of start."""
    last = lambda done: F.element_at(done, -1)
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1))),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(
                F.struct(
                    last(done)["start"].alias("start"),
                    F.greatest(last(done)["end"], s["end"]).alias("end"),
                )
            ),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:int,end:int>>)"), step)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    into: str = "found",
) -> DataFrame:
    """``docs`` with a column ``into``: {n_words, n_hit, items, starts, ends}.

    ``items`` are the ids (as strings, sorted) of the items of which a window
    occurs; ``starts`` and ``ends`` the hit words (from 0, end exclusive) as
    disjoint spans, ``n_hit`` their total. The windows are taken to the tasks in
    blocks of about ``block_bytes``, so memory does not follow their number; each
    further block adds one step to the same scan of the documents.

    Null, empty and word-free texts have no words and no hits. An item whose text
    is null or has no words occurs nowhere; one whose id is null makes hits but is
    not named. Repeated rows are separate documents; repeated items count once.
    Without items nothing is hit. Other columns, whatever their names, are kept;
    one named ``into`` is replaced.
    """
    spark = docs.sparkSession
    pairs = windows(items, item_id, item_text, size)
    total = pairs.agg(F.sum(F.octet_length("window") + 64)).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in pairs.where(part == b).collect()]
        scan = _scanner(spark.sparkContext.broadcast(rows))
        if out is None:
            out = docs.withColumn(into, scan(F.col(text_col)))
            continue
        more = "__more__"
        out = out.withColumn(more, scan(F.col(text_col)))
        both = _union(
            F.concat(
                F.arrays_zip(F.col(into)["starts"].alias("start"), F.col(into)["ends"].alias("end")),
                F.arrays_zip(F.col(more)["starts"].alias("start"), F.col(more)["ends"].alias("end")),
            )
        )
        out = out.withColumn("__both__", both).withColumn(
            into,
            F.struct(
                F.col(into)["n_words"].alias("n_words"),
                F.aggregate(
                    "__both__", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
                ).alias("n_hit"),
                F.array_sort(F.array_union(F.col(into)["items"], F.col(more)["items"])).alias("items"),
                F.transform("__both__", lambda s: s["start"]).alias("starts"),
                F.transform("__both__", lambda s: s["end"]).alias("ends"),
            ),
        )
        out = out.drop(more, "__both__")
    return out


def is_contaminated(found: str = "found") -> Column:
    """Whether at least a twentieth of the words are hit."""
    hit, words = F.col(found)["n_hit"], F.col(found)["n_words"]
    return (hit > 0) & (20 * hit >= words)

