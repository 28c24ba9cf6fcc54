"""Language identification by n-grams in bit-sliced Bloom filters.

A language is the set of 4-byte n-grams that are typical of it: of lower-cased
letters, a blank standing for anything else. All languages share one Bloom
filter in bit slices: each position holds a bit mask with a bit per language,
and the masks at an n-gram's positions, and-ed, are all the languages that
(seem to) contain it. Per document the bits of each language are counted; with
``n`` n-grams and false-positive rate ``p``, a count ``c`` is corrected to
``(c - n p) / (1 - p)``. The largest corrected count decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import cut_long, encoded, mix, release, sliced, text_parts

UNKNOWN = "und"
TRAINING_DOCUMENTS = 20_000
_HASHES = 3
_END = 10
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_ASCII_LETTER = re.compile(rb"[a-z]")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of lower-cased texts, and where those of each text begin (and end)."""
    data = np.frombuffer(b" \n" + b" \n".join(b" " + t for t in texts) + b" \n", np.uint8).copy()
    begin = np.cumsum([1] + [len(t) + 3 for t in texts])
    letter = _LETTER[data]
    data[~letter] = 32
    data[begin] = _END
    keep = letter
    keep[1:] |= _LETTER[data[:-1]]
    keep[begin] = True
    keep[begin[:-1] + 1] = True  # each text begins with a blank
    data = data[keep]
    wide = data.astype(np.uint32)
    codes = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    end = data == _END
    inside = ~(end[:-3] | end[1:-2] | end[2:-1] | end[3:])
    return codes[inside], np.concatenate([[0], np.cumsum(inside)])[
        np.minimum(np.flatnonzero(end), len(inside))
    ]


def _lower(texts: list[bytes]) -> list[bytes]:
    return [t.decode().lower().encode() for t in texts]


@dataclass
class Model:
    """``table[position]`` has bit ``i`` (of word ``i // 64``) set for language ``i``."""

    languages: list[str]
    table: np.ndarray
    false_rates: np.ndarray
    default: int

    @classmethod
    def build(cls, languages: list[str], default: int, owner: np.ndarray, codes: np.ndarray) -> Model:
        """From pairs (number of a language, n-gram that it contains)."""
        most = int(np.bincount(owner, minlength=1).max()) if len(owner) else 1
        size = 1 << max(10, int(np.ceil(np.log2(16 * max(1, most)))))
        table = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
        for i in range(len(languages)):
            for at in cls.positions(codes[owner == i], size):
                table[at, i // 64] |= np.uint64(1 << (i % 64))
        filled = [np.mean(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))]
        return cls(languages, table, np.array(filled) ** _HASHES, default)

    @staticmethod
    def positions(codes: np.ndarray, size: int) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [(h >> np.uint64(21 * k) & np.uint64(size - 1)).astype(np.int64) for k in range(_HASHES)]

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each n-gram."""
        masks = None
        for at in self.positions(codes, len(self.table)):
            masks = self.table[at] if masks is None else masks & self.table[at]
        return masks

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Corrected counts, a row per text and a column per language."""
        parts, owner = cut_long(_lower(texts))
        seen, n, at = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), 0
        for group in sliced(parts):
            own, at = owner[at : at + len(group)], at + len(group)
            codes, begin = _grams(group)
            masks = self.containing(codes)
            n += np.bincount(own, np.diff(begin), len(texts))
            for i in range(len(self.languages)):
                bits = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int32)
                sums = np.concatenate([[0], np.cumsum(bits)])[begin]
                seen[:, i] += np.bincount(own, np.diff(sums), len(texts))
        p = self.false_rates
        return np.maximum(seen - n[:, None] * p, 0) / np.maximum(1 - p, 1e-9)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        counts = self.counts(texts)
        best, total = counts.argmax(1), counts.sum(1)
        names, scores = [], []
        for k, text in enumerate(texts):
            if not has_letters(text):
                names.append(UNKNOWN)
                scores.append(0.0)
            elif total[k] <= 0:
                names.append(self.languages[self.default])
                scores.append(0.0)
            else:
                names.append(self.languages[best[k]])
                scores.append(float(min(1.0, counts[k, best[k]] / total[k])))
        return names, scores


def has_letters(text: bytes) -> bool:
    lower = text[:4096].lower()
    return bool(_ASCII_LETTER.search(lower)) or any(c.isalpha() for c in text.decode())


def quotas(sizes: dict[str, int], most: int) -> dict[str, float]:
    """How many of each language's documents are taken: the same number of each, or all where there
    are fewer, ``most`` together, but one of each language at least."""
    quota, left, open_ = {}, most, len(sizes)
    for lang, size in sorted(sizes.items(), key=lambda x: x[1]):
        quota[lang] = min(size, max(1.0, left / open_))
        left, open_ = left - quota[lang], open_ - 1
    return quota


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key: Column | None = None,
    max_documents: int = TRAINING_DOCUMENTS,
    typical: float = 0.5,
    least_count: int = 3,
) -> Model | None:
    """Learn from the rows with a language; None if there are none.

    Of more than ``max_documents`` rows about that many are taken, by a hash of
    ``key`` (default: the text), each language as many as ``quotas`` gives it, so
    that one with few documents keeps them all beside large ones. An n-gram belongs
    to each language in which its share of all n-grams is at least ``typical``
    times the largest share in any, if it was seen there ``least_count`` times (once
    per document taken, if a language has fewer). Rows without language teach
    nothing, rows without key are never taken when there are too many; missing and
    empty texts have no n-grams.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        (F.col(text_col) if key is None else key).alias("key"),
    )
    known = rows.groupBy("lang").count().collect()  # one row per language
    if not known:
        return None
    languages = sorted(r["lang"] for r in known)
    common = max(known, key=lambda r: (r["count"], r["lang"]))["lang"]
    sizes = {r["lang"]: r["count"] for r in known}
    taken = quotas(sizes, max_documents)
    if sum(sizes.values()) > max_documents:
        shares = F.create_map(*(F.lit(x) for lang in languages for x in (lang, taken[lang] / sizes[lang])))
        part = F.pmod(F.xxhash64("key", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.where((part < shares[F.col("lang")]) & F.col("key").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = _lower(encoded(batch.column(1)))
            for lang in set(langs):
                own, _ = cut_long([t for t, x in zip(texts, langs, strict=True) if x == lang])
                for part in sliced(own):
                    codes, times = np.unique(_grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes)), pa.array(codes, pa.int64()), pa.array(times, pa.int64())],
                        names=["lang", "gram", "n"],
                    )
        release()

    counted = (
        rows.select("lang", "text")
        .mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    seen = counted.toPandas()  # the n-grams of at most ``max_documents`` texts
    seen["share"] = seen["n"] / seen.groupby("lang")["n"].transform("sum")
    kept = seen[
        (seen["share"] >= typical * seen.groupby("gram")["share"].transform("max"))
        & (seen["n"] >= seen["lang"].map(lambda lang: min(least_count, math.ceil(taken[lang]))).astype("int64"))
    ]
    owner = np.searchsorted(np.array(languages, dtype=object), kept["lang"].to_numpy(dtype=object))
    return Model.build(
        languages, languages.index(common), owner.astype(np.int64), kept["gram"].to_numpy().astype(np.uint32)
    )


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a column ``into``: {lang_pred, score}.

    ``lang_pred`` is the language with the largest corrected count (ties: the
    first by name) and ``score`` its part of all languages' counts. Texts that
    are null or hold no letter are ``und`` with score 0, as is everything
    without a model. Letters without a known n-gram give the commonest language
    of the training rows, with score 0. Other columns are kept; one named
    ``into`` is replaced.
    """
    if model is None:
        return docs.withColumn(
            into, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for part in text_parts(texts):
                some, shares = shared.value.predict(part)
                names += some
                scores += shares
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
            )
        release()

    return docs.withColumn(into, predict.asNondeterministic()(F.col(text_col)))
