"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of ASCII digits, ASCII letters (A-Z taken as a-z) and bytes of
characters beyond ASCII. All of that can be told from single bytes, so whole
Arrow batches are cut into words without a Python loop over them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[ord("0") : ord("9") + 1] = True
_IN_WORD[ord("a") : ord("z") + 1] = True
_IN_WORD[128:] = True

_BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64) -> np.ndarray:
    factors = np.full(_BLOCK + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_UNBASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a missing text is empty."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def sliced(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts, about ``most`` bytes at a time (one text is never cut)."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def text_parts(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts of an Arrow batch as ``encoded`` and ``sliced`` give them, without holding
    all of them a second time."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield encoded(texts.slice(at, i - at))
            at, total = i, 0
        total += n
    if at < len(texts):
        yield encoded(texts.slice(at))


def release() -> None:
    """Give freed memory back to the system, as workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@dataclass
class Words:
    """Words of some texts: word ``i`` is ``data[starts[i]:ends[i]]``, lower-cased;
    text ``k`` has the words ``first[k]`` to ``first[k + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def words_of(texts: list[bytes]) -> Words:
    """Cut texts into words."""
    joined = b"\n" + b"\n".join(texts) + b"\n"
    data = LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    starts, ends = edges[::2], edges[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, begin))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, from running sums of byte times power.

    The sums are made in blocks, so memory does not follow the length of a text.
    """
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    down = np.ones(len(starts), np.uint64)
    total, up, unup = np.uint64(0), np.uint64(1), np.uint64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), _BLOCK):
            part = data[a : a + _BLOCK]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
            sums *= up
            sums += total
            for where, out in ((starts, at_start), (ends, at_end)):
                i, j = np.searchsorted(where, (a, a + len(part)))
                out[i:j] = sums[where[i:j] - a]
                if where is starts:
                    down[i:j] = _DOWN[where[i:j] - a] * unup
            total = sums[-1]
            up, unup = up * _UP[_BLOCK], unup * _DOWN[_BLOCK]
        at_end[ends == len(data)] = total
        return mix((at_end - at_start) * down + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each position on; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + hashes[k : k + n]
        return mix(out)


def cut_long(texts: list[bytes], most: int = SLICE_BYTES // 2) -> tuple[list[bytes], np.ndarray]:
    """Texts, those over ``most`` bytes cut after a blank or line end (if there is one),
    and the number of the text that each part comes from."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            end = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most)) + 1
            end = end if end > at else at + most
            parts.append(text[at:end])
            owner.append(i)
            at = end
        parts.append(text[at:])
        owner.append(i)
    return parts, np.array(owner, dtype=np.int64)
