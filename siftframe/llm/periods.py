"""Stretches of words that repeat with a period: online dyadic square catching.

Words get numbers, and level j keeps a catcher for every completed block of 2^j
words. A catcher compares its block with the suffix of as many words that each
appended word completes; if they agree at distance q, the words from the block on
are a square in the making. A run of period q and exponent four or more has 3q
words that equal the word q further on, so it holds a whole block of the level
that answers for q: the largest with 2^(j+1) <= 3q + 1. The levels thus share the
periods between them, and all catchers of a level take their next word at the same
time: one vector comparison of block hashes for each distance.

A catch is compared word by word in both directions until the period breaks. That
gives the run it belongs to, in which all further catches of the period or of its
multiples lie; those are merged into the run without another comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix, release, text_parts

LEAST_WORDS, LEAST_EXPONENT = 6, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "n_words bigint, starts array<int>, lengths array<int>, periods array<int>, collapsed string"


def _periods_of(level: int) -> range:
    """Periods whose catchers are the blocks of 2^level words."""
    lowest = -(-((2 << level) - 1) // 3)
    return range(lowest, -(-((4 << level) - 1) // 3))


def _same_right(words: np.ndarray, at: int, q: int) -> int:
    """First place from ``at`` on whose word is not that of ``q`` words later."""
    step, last = 16, len(words) - q
    while at < last:
        end = min(at + step, last)
        differ = np.flatnonzero(words[at:end] != words[at + q : end + q])
        if len(differ):
            return at + int(differ[0])
        at, step = end, 2 * step
    return at


def _same_left(words: np.ndarray, at: int, q: int) -> int:
    """Least place up to ``at`` from which all words equal those of ``q`` words later."""
    step = 16
    while at > 0:
        begin = max(0, at - step)
        differ = np.flatnonzero(words[begin:at] != words[begin + q : at + q])
        if len(differ):
            return begin + int(differ[-1]) + 1
        at, step = begin, 2 * step
    return 0


def find_runs(words: np.ndarray, longest: int, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least ``exponent`` (4 or more) periods.

    ``words`` are whole numbers; texts are set apart by numbers that occur once, and
    ``longest`` is the number of words of the longest text.
    """
    found: dict[tuple[int, int], int] = {}
    n, level = len(words), 1
    with np.errstate(over="ignore"):
        hashes = mix(words.astype(np.uint64) + _BASE)
        while True:
            half, size = 1 << (level - 1), 1 << level
            periods = _periods_of(level)
            if exponent * periods[0] > longest or n < size:
                break
            hashes = mix(hashes[:-half] * _BASE + hashes[half:])
            catchers = np.ascontiguousarray(hashes[::size])
            inside, until = _covered(found, size, len(catchers))
            for q in periods:
                if exponent * q > longest or q >= len(hashes):
                    break
                suffixes = hashes[q::size]
                caught = np.flatnonzero(catchers[: len(suffixes)] == suffixes)
                if not len(caught):
                    continue
                known = (q % inside[caught] == 0) & (caught * size + q + size <= until[caught])
                end = -1
                for at in (caught[~known] * size).tolist():
                    if at + q + size <= end:
                        continue  # a square of the run that was just found
                    left, right = _same_left(words, at, q), _same_right(words, at, q)
                    end = right + q
                    if end - left >= exponent * q:
                        found[left, end] = min(q, found.get((left, end), q))
            level += 1
    return [(a, b, q) for (a, b), q in found.items()]


def _covered(found: dict[tuple[int, int], int], size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each block: period and end of a run that has been found and holds it."""
    inside, until = np.ones(n, np.int64), np.full(n, -1)
    for (a, b), q in found.items():
        blocks = slice(-(-a // size), b // size)
        further = until[blocks] < b
        inside[blocks][further], until[blocks][further] = q, b
    return inside, until


class Runs:
    """Runs of some texts."""

    def __init__(self, texts: list[bytes], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT):
        self.words = [t.split() for t in texts]  # at blanks and the five line and tab signs
        self.counts = np.array([len(w) for w in self.words], np.int64)
        first = np.cumsum(np.append(0, self.counts[:-1] + 1))
        codes = np.zeros(int(self.counts.sum()) + len(texts), np.int64)
        codes[first + self.counts] = -1 - np.arange(len(texts))  # behind each text a word of its own
        number = {w: i for i, w in enumerate(set().union(*self.words))}
        for at, some in zip(first.tolist(), self.words, strict=True):
            codes[at : at + len(some)] = np.fromiter(map(number.__getitem__, some), np.int64, len(some))
        found = find_runs(codes, int(self.counts.max(initial=0)), exponent)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b, q in sorted(r for r in found if r[1] - r[0] >= least):
            k = int(np.searchsorted(first, a, side="right")) - 1
            self.runs[k].append((a - int(first[k]), b - a, q))
        for runs in self.runs:
            runs.sort(key=lambda r: (r[0], r[2]))

    def collapsed(self, k: int) -> bytes:
        """Text ``k`` without the words behind the first period of a run, joined by one blank."""
        words, runs = self.words[k], self.runs[k]
        if not runs:
            return b" ".join(words)
        keep = np.ones(len(words) + 1, np.int64)
        for start, length, q in runs:
            keep[start + q : start + length] = 0
        return b" ".join([w for w, stays in zip(words, keep.tolist(), strict=False) if stays])


def _scanner(least: int, exponent: int):
    @F.arrow_udf(_SCHEMA)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for part in text_parts(texts):
                found = Runs(part, least, exponent)
                column = lambda i, found=found: pa.array(
                    [[r[i] for r in runs] for runs in found.runs], pa.list_(pa.int32())
                )
                whole = pa.array([found.collapsed(k) for k in range(len(part))], pa.binary())
                parts.append(
                    pa.StructArray.from_arrays(
                        [pa.array(found.counts), column(0), column(1), column(2), whole.view(pa.string())],
                        names=["n_words", "starts", "lengths", "periods", "collapsed"],
                    )
                )
            yield pa.concat_arrays(parts) if parts else pa.array([], _ARROW)
            release()

    return scan


_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        *((n, pa.list_(pa.int32())) for n in ("starts", "lengths", "periods")),
        ("collapsed", pa.string()),
    ]
)


def find_periodic_runs(
    docs: DataFrame,
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    exponent: int = LEAST_EXPONENT,
    into: str = "periodic",
) -> DataFrame:
    """``docs`` with a column ``into``: {n_words, runs, best, collapsed}.

    Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and
    carriage return, told apart by every byte. ``runs`` are the stretches {start, length,
    period} with smallest period q, at least ``least_words`` words and ``exponent`` (not
    below 4) periods that no word next to them extends, by start and period. ``best`` is
    the run of greatest length / period (compared exactly; ties to the smaller start, then
    period), null without a run. ``collapsed`` are the words joined by one blank, without
    those that a run contains after its first period.

    Null, empty and blank texts have no words, no runs and '' as ``collapsed``. Texts are
    searched whole, however long; time goes with n log n words, also for a text of one
    repeated word. Each row is searched on its own, so repeated rows have equal results.
    Other columns, whatever their names, are kept; one named ``into`` is replaced. An
    empty table gives an empty one. One scan, nothing is shuffled.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    scan = _scanner(least_words, exponent)
    found = docs.withColumn("__found__", scan(docs[text_col]))
    runs = F.transform(
        F.arrays_zip("__found__.starts", "__found__.lengths", "__found__.periods"),
        lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")),
    )
    out = found.withColumn("__runs__", runs).withColumn(
        into,
        F.struct(
            F.col("__found__.n_words").alias("n_words"),
            F.col("__runs__").alias("runs"),
            _best(F.col("__runs__")).alias("best"),
            F.col("__found__.collapsed").alias("collapsed"),
        ),
    )
    return out.select(*dict.fromkeys([*docs.columns, into]))


def _best(runs: Column) -> Column:
    """The run of greatest exponent; the first one of equals, as they come by start and period."""

    def better(a: Column, b: Column) -> Column:
        """Whether b has a greater exponent: length and period fit 32 bits, their products 64."""
        return b["length"].cast("bigint") * a["period"] > a["length"].cast("bigint") * b["period"]

    none = F.lit(None).cast("struct<start:int,length:int,period:int>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))
