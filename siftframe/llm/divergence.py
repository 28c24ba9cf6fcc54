"""How the sources of a language differ in their words.

Terms are counted by length-bucketed packing. In a slice of texts, a term of at
most eight bytes becomes one big-endian uint64 word and one of at most sixteen two;
no term holds a zero byte, so the words tell terms apart and sort as their bytes
do. Words are put in order by a radix sort (stable, sixteen bits at a time) and
runs of equal words are counted in numpy. Longer terms go into buckets by length
that are sorted as bytes. Within a run the texts stay in order of their group, so
the same pass gives occurrences and documents of each (group, term).

Counts are combined before each shuffle. A language is spread over buckets of its
terms; a pair of sources is summed up in every bucket and the sums are added.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored
from .text import LOWER, encoded, release

LEAST_DOCUMENTS, TOP_TERMS = 30, 50
SLICE_BYTES = 8 << 20
UNIT, PRIOR = 1_000_000_000, 5

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[ord("a") : ord("z") + 1] = True
_IN_TERM[128:] = True
_WIDEST = 256  # bytes of a term that fixed-width sorting still takes
_CELL_ROWS = 400_000
_BLOCK_SOURCES = 256
_CHUNK = 4096
_SMALL = 50_000  # groups up to which their totals are broadcast
_SALTS = 16

_COUNTS = "lang string, source string, term binary, occurrences bigint, documents bigint"


def _radix(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by several uint64 words, the first the most significant."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word[order] >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit, kind="stable")]
    return order


def _runs(new_term: np.ndarray, group: np.ndarray, doc: np.ndarray):
    """(first place, group, occurrences, documents) of each run of one term in one group."""
    new = new_term | np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(new)
    new_doc = new | np.append(True, doc[1:] != doc[:-1])
    return first, group[first], np.diff(np.append(first, len(group))), np.add.reduceat(new_doc.astype(np.int64), first)


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def count_terms(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts that are in order of their ``groups``."""
    joined = b"\n" + b"\n".join(texts) + b"\n" + bytes(16)
    data = LOWER[np.frombuffer(joined, np.uint8)]
    inside = _IN_TERM[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(begin, starts, side="right") - 1
    size = ends - starts
    eight = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data.tobytes(), strides=(1,))
    out_group, out_terms, out_count, out_docs = [], [], [], []

    def add(found, terms: list[bytes]) -> None:
        out_group.append(found[1])
        out_terms.extend(terms)
        out_count.append(found[2])
        out_docs.append(found[3])

    def packed(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        word = eight[at].astype(np.uint64)
        drop = (8 * (8 - np.clip(length, 1, 8))).astype(np.uint64)
        return word >> drop << drop

    for n_words, some in ((1, np.flatnonzero(size <= 8)), (2, np.flatnonzero((size > 8) & (size <= 16)))):
        if not len(some):
            continue
        words = [packed(starts[some] + 8 * w, size[some] - 8 * w) for w in range(n_words)]
        order = _radix(words)
        some, words = some[order], [w[order] for w in words]
        found = _runs(_changes(*words), groups[doc[some]], doc[some])
        spelled = np.stack([w[found[0]] for w in words], axis=1).astype(">u8")
        add(found, spelled.view(f"S{8 * n_words}")[:, 0].tolist())
    width = 32
    while width <= _WIDEST:
        some = np.flatnonzero((size > width // 2) & (size <= width))
        if len(some):
            spelled = np.zeros((len(some), width), np.uint8)
            for k in range(width):
                has = size[some] > k
                spelled[has, k] = data[starts[some[has]] + k]
            terms = spelled.view(f"S{width}")[:, 0]
            order = np.argsort(terms, kind="stable")
            some, terms = some[order], terms[order]
            found = _runs(_changes(terms), groups[doc[some]], doc[some])
            add(found, terms[found[0]].tolist())
        width *= 2
    some = np.flatnonzero(size > _WIDEST)
    if len(some):
        long = sorted((data[starts[i] : ends[i]].tobytes(), i) for i in some.tolist())
        some, terms = np.array([i for _, i in long]), np.array([t for t, _ in long], dtype=object)
        found = _runs(_changes(terms), groups[doc[some]], doc[some])
        add(found, terms[found[0]].tolist())
    if not out_group:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_group), out_terms, np.concatenate(out_count), np.concatenate(out_docs)


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A long text in parts; no cut goes through a term."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        while end < len(text) and _IN_TERM[LOWER[text[end]]]:
            end += 1
        yield text[at:end]
        at = end


def _count_long(text: bytes, most: int):
    """``count_terms`` of one text that is taken in parts."""
    total: Counter[bytes] = Counter()
    for piece in _pieces(text, most):
        _, terms, count, _ = count_terms([piece], np.zeros(1, np.int64))
        for term, n in zip(terms, count.tolist(), strict=True):
            total[term] += n
    n = len(total)
    return np.zeros(n, np.int64), list(total), np.fromiter(total.values(), np.int64, n), np.ones(n, np.int64)


def _counter(most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch["lang"].to_pylist(), batch["source"].to_pylist()
            names = sorted(set(zip(lang, source, strict=True)))
            number = {name: i for i, name in enumerate(names)}
            group = np.array([number[n] for n in zip(lang, source, strict=True)], np.int64)
            # A row without a term for each group, as it may have none.
            yield _counted(names, np.arange(len(names)), [None] * len(names), *[np.zeros(len(names), np.int64)] * 2)
            length = batch["size"].to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            long, order = order[length[order] > most], order[length[order] <= most]
            for i in long.tolist():
                text = encoded(batch["text"].slice(i, 1))[0]
                found = _count_long(text, most)
                yield _counted(names, found[0] + group[i], *found[1:])
            upto = np.cumsum(length[order] + 1) // most
            for part in np.split(order, np.flatnonzero(np.diff(upto)) + 1):
                if len(part):
                    yield _counted(names, *count_terms(encoded(batch["text"].take(pa.array(part))), group[part]))
        release()

    return count


def _counted(names, group, terms, count, docs) -> pa.RecordBatch:
    take = pa.array(group)
    return pa.record_batch(
        [
            pa.array([n[0] for n in names], pa.string()).take(take),
            pa.array([n[1] for n in names], pa.string()).take(take),
            pa.array(terms, pa.binary()),
            pa.array(count, pa.int64()),
            pa.array(docs, pa.int64()),
        ],
        names=["lang", "source", "term", "occurrences", "documents"],
    )


def term_counts(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", most: int = SLICE_BYTES):
    """(lang, source, term, occurrences, documents); a row with a null term for every group."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        F.coalesce(docs[lang_col], F.lit("")).alias("lang"),
        F.coalesce(docs[source_col], F.lit("")).alias("source"),
        text.alias("text"),
        F.octet_length(text).alias("size"),
    )
    found = rows.mapInArrow(_counter(most), _COUNTS).withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")
    )


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), exact beyond 64 bits too."""
    above = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def _share_of(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same in a task."""
    wide = count.max(initial=0) >= (2**63 - 1) // UNIT - PRIOR
    count = count.astype(object) if wide else count
    return (1 + (UNIT * (count + PRIOR)) // (total + PRIOR * terms)).astype(np.int64)


def _distances(key: tuple, kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of differences of all pairs of sources in a cell, over its terms."""
    i, j = key[2].as_py(), key[3].as_py()
    groups = groups.sort_by("source")
    names, block = groups["source"], groups["block"].to_numpy()
    total, terms = groups["total"].to_numpy(), int(groups["terms"][0].as_py()) if len(groups) else 0
    n = len(groups)
    sums = np.zeros((n, n), np.int64)
    if len(kept):
        none = _share_of(np.zeros(n, np.int64), total, terms)
        coded = kept["term"].combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy()
        place = {s: k for k, s in enumerate(names.to_pylist())}
        coded_source = kept["source"].combine_chunks().dictionary_encode()
        source = np.array([place[s] for s in coded_source.dictionary.to_pylist()])[coded_source.indices.to_numpy()]
        share = _share_of(kept["occurrences"].to_numpy(), total[source], terms)
        order = np.argsort(term, kind="stable")
        term, source, share = term[order], source[order], share[order]
        for a in range(0, len(coded.dictionary), _CHUNK):
            lo, hi = np.searchsorted(term, (a, a + _CHUNK))
            table = np.repeat(none[:, None], min(_CHUNK, len(coded.dictionary) - a), axis=1)
            table[source[lo:hi], term[lo:hi] - a] = share[lo:hi]
            for s in range(n):
                sums[s, s + 1 :] += np.abs(table[s + 1 :] - table[s]).sum(axis=1)
    x, y = np.triu_indices(n, 1)
    if i != j:
        other = block[x] != block[y]
        x, y = x[other], y[other]
    release()
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(x), pa.string()),
            "x": names.take(pa.array(x)).cast(pa.string()),
            "y": names.take(pa.array(y)).cast(pa.string()),
            "value": pa.array(sums[x, y], pa.int64()),
        }
    )


def _cells(table: DataFrame, blocks: int) -> DataFrame:
    """Rows of a block of sources to every pair of blocks that it is part of."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = table.withColumn("_o", other)
    i, j = F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j")
    return both.select(*table.columns, i, j)


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
    slice_bytes: int = SLICE_BYTES,
    cell_rows: int = _CELL_ROWS,
    block_sources: int = _BLOCK_SOURCES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart.

    A term is a run of ASCII letters (A-Z as a-z) and characters beyond ASCII; a language
    keeps the terms in at least ``least_documents`` of its documents. A kept term has
    smoothed share ``1 + floor(10^9 * (count + 5) / (N + 5 * V))`` in a group, where N is
    the group's count of kept terms and V their number. Part ``pair`` has the sum of
    absolute differences of shares for every other source of the language, part ``term``
    the ``top`` terms of which the source has more than its language has. Ranks go by value
    (descending), then item in UTF-8 order. Null text, language or source is ''. Repeated
    rows are separate documents. A language without kept terms has pairs of value 0 and no
    terms; an empty table gives no rows. Texts of any length and terms of any length are
    counted whole. Other columns play no part. Two jobs run first: counts are stored, then
    the totals of the groups are.
    """
    spark = docs.sparkSession
    counts = term_counts(docs, text_col, lang_col, source_col, slice_bytes)
    of_term = Window.partitionBy("lang", "term")
    first = F.row_number().over(of_term.orderBy("source")) == 1
    counts = counts.select(
        "*",
        F.sum("documents").over(of_term).alias("in_documents"),
        F.sum("occurrences").over(of_term).alias("in_lang"),
        first.cast("bigint").alias("first"),
    )
    chosen = F.col("term").isNotNull() & (F.col("in_documents") >= least_documents)
    rows = stored(counts.where(chosen | F.col("term").isNull()), "divergence-terms")
    kept = rows.where("term IS NOT NULL")
    totals = rows.groupBy("lang", "source").agg(
        F.sum(F.when(F.col("term").isNotNull(), F.col("occurrences")).otherwise(0)).alias("total"),
        F.sum(F.when(F.col("term").isNotNull(), F.col("first")).otherwise(0)).alias("own"),
    )
    of_lang = Window.partitionBy("lang")
    totals = totals.select(
        "lang", "source", "total",
        F.sum("total").over(of_lang).alias("lang_total"), F.sum("own").over(of_lang).alias("terms"),
        F.count(F.lit(1)).over(of_lang).alias("sources"),
    )
    groups = stored(totals, "divergence-groups")
    n_groups, most_sources = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("sources"), F.lit(1))).head()
    n_rows = kept.count()

    blocks = max(1, -(-most_sources // block_sources))
    cores = spark.sparkContext.defaultParallelism
    buckets = max(1, -(-n_rows // cell_rows), min(8 * cores, -(-n_rows // _CHUNK)))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    left = _cells(kept.select("lang", "source", "term", "occurrences", bucket, block), blocks)
    spread = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    right = _cells(groups.select("lang", "source", "total", "terms", spread, block), blocks)
    cell = ["lang", "bucket", "i", "j"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * cores)
    left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)
    sums = (
        left.groupBy(*cell)
        .cogroup(right.groupBy(*cell))
        .applyInArrow(_distances, "lang string, x string, y string, value bigint")
        .groupBy("lang", "x", "y")
        .agg(F.sum("value").alias("value"))
    )
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    pairs = sums.select("lang", F.inline(F.array(way("x", "y"), way("y", "x"))), "value")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    sizes = groups.select("lang", "source", "total", "lang_total", "terms")
    if n_groups <= _SMALL:
        known = kept.join(F.broadcast(sizes), ["lang", "source"])
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(_SALTS)).cast("int"))
        known = salted.join(sizes.select("*", salt), ["lang", "source", "salt"])
    known = known.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (
            _share(F.col("occurrences"), F.col("total"), F.col("terms"))
            - _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
        ).alias("value"),
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order)
    terms = known.where("value > 0").withColumn("rank", ranked).where(F.col("rank") <= top)
    return pairs.withColumn("rank", ranked).unionByName(terms)
