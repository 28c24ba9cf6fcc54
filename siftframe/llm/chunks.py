"""Token ids of many texts by a public BPE tokenizer, each different chunk encoded once.

Texts are cut at places where the tokenizers' own splitting into words always
cuts: before a blank or line end that follows a visible ASCII character or Latin
letter, and before a comma or full stop that follows a letter. The ids of a text
are the ids of its chunks in a row, and chunks repeat, so a worker keeps the ids
of those it has seen (up to a fixed number of them), by 64-bit hash: among the two
million chunks of a full table two share one with a probability of 10^-7.
"""

from __future__ import annotations

import os

import numpy as np

from .text import span_hashes

SLICE_BYTES = 4 << 20
_KEPT = 2_000_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, 10]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(","), ord(".")]] = True
_LATIN = np.zeros(256, bool)  # second bytes of Latin-1 letters after C3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def chunk_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts laid end to end, the first bytes of which are at ``begin``."""
    flag = np.zeros(len(data), bool)
    if len(data):
        latin = np.zeros(len(data), bool)
        latin[1:] = _LATIN[data[1:]] & (data[:-1] == 0xC3)
        flag[1:] = _BLANK[data[1:]] & (_VISIBLE[data[:-1]] | latin[:-1])
        flag[1:] |= _STOP[data[1:]] & (_LETTER[data[:-1]] | latin[:-1])
        flag[begin[begin < len(data)]] = True
    return np.flatnonzero(flag)


class ChunkTokenizer:
    """A tokenizer file of the ``tokenizers`` library, with ids kept per chunk."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of chunks, sorted
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        parts, lengths = [], []
        for a in range(0, len(chunks), 10_000):
            texts = [c.decode() for c in chunks[a : a + 10_000]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths += map(len, ids)
            parts.append(np.fromiter((i for x in ids for i in x), np.uint32))
        length = np.array(lengths, np.int32)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        start = len(self.ids) + np.cumsum(length, dtype=np.int64) - length
        self.known = known[order]
        self.start = np.concatenate([self.start, start])[order]
        self.length = np.concatenate([self.length, length])[order]
        self.ids = np.concatenate([self.ids, *parts])

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of the chunks of all texts, and where those of each text begin (and end)."""
        if len(self.known) > _KEPT:
            self._forget()
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        begin = np.cumsum([0] + [len(t) for t in texts])
        starts = chunk_starts(data, begin[:-1])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        own, example, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        new = self.known[at] != own if len(self.known) else np.ones(len(own), bool)
        if new.any():
            some = example[new]
            self._learn(own[new], [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            at = np.searchsorted(self.known, own)
        return at[which], np.searchsorted(starts, begin)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, first = self._numbers(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.length[numbers], dtype=np.int64)])[first])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where those of each text begin (and end)."""
        numbers, first = self._numbers(texts)
        length = self.length[numbers]
        before = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        at = np.repeat(self.start[numbers] - before[:-1], length) + np.arange(before[-1])
        return self.ids[at], before[first]


_OPEN: dict[str, ChunkTokenizer] = {}


def open_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this worker for a file."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = ChunkTokenizer(path)
    return _OPEN[path]
