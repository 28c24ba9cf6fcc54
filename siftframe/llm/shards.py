"""Token sequences in training order: binary shards of a fixed stride.

Documents are cut into sequences of at most ``seq_len`` tokens, numbered in the
order of the scan. A keyed Feistel network permutes the numbers: it is a
bijection on a power of four, and a value beyond the number of sequences is put
through it again (cycle-walking) until it falls inside. The result is a
sequence's *slot* in the training order, so the order needs no sort of the corpus
by random keys and can be computed in either direction for any slot.

Slots are split into ranges, one per shard; each is written by one task, in order,
as records of one size. A reader finds any slot by a multiplication and goes on
from there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .archives import _open
from .chunks import SLICE_BYTES, open_tokenizer
from .text import mix, release, text_parts

SEQ_LEN = 512
SHARD_ROWS = 32_768
NO_ID = -(1 << 63)  # how a null id is stored
_HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4")])


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    size: int
    key: int
    rounds: int = 6

    @property
    def half(self) -> int:
        """Bits of one half of the network's domain."""
        return max(1, -(-max(1, self.size - 1).bit_length() // 2))

    def _round(self, side: np.ndarray, n: int) -> np.ndarray:
        seed = np.uint64((self.key * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) % (1 << 64))
        return mix(side ^ seed) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, backward: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        with np.errstate(over="ignore"):
            if backward:
                for n in reversed(range(self.rounds)):
                    left, right = right ^ self._round(left, n), left
            else:
                for n in range(self.rounds):
                    left, right = right, left ^ self._round(right, n)
        return left << half | right

    def _walk(self, values: np.ndarray, backward: bool) -> np.ndarray:
        out = self._once(np.asarray(values).astype(np.uint64), backward)
        while (far := np.flatnonzero(out >= np.uint64(self.size))).size:
            out[far] = self._once(out[far], backward)
        return out.astype(np.int64)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def number(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


@dataclass(frozen=True)
class Layout:
    """How records look: ids of ``token`` type, padded with the closing id."""

    seq_len: int
    end_id: int
    token: str

    @property
    def record(self) -> np.dtype:
        return np.dtype([*_HEAD.descr, ("ids", self.token, (self.seq_len,))])


_MANIFEST = "shard bigint, path string, first_slot bigint, records bigint, stride bigint, crc32 bigint"


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of some documents at a time."""
    ids, at = batch.column(0).to_pylist(), 0
    for part in text_parts(batch.column(1), SLICE_BYTES):
        yield ids[at : at + len(part)], part
        at += len(part)


def write_shards(
    docs: DataFrame,
    root: str,
    tokenizer: str,
    end_id: int,
    key: int = 20,
    seq_len: int = SEQ_LEN,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, Layout]:
    """Write all sequences of ``docs`` into shards below ``root``; their manifest and the layout.

    A document's tokens are the ids of its text and ``end_id`` (null and empty
    texts: that alone), cut every ``seq_len``. Every row is a document of its own,
    repeated rows too; a null id is stored as ``NO_ID``. Without rows there are
    no shards. Other columns are not used.

    The documents are scanned twice: to count sequences per task, which gives the
    numbers each task begins with, and to write. A scan that does not repeat the
    first one's tasks is an error, never a wrong order.
    """
    spark = docs.sparkSession
    token = "<u2" if max(end_id, open_tokenizer(tokenizer).tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4"
    layout = Layout(seq_len, end_id, token)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, total, check = open_tokenizer(tokenizer), 0, 0
        for batch in batches:
            for _, texts in _parts(batch):
                n = -(-(tok.counts(texts) + 1) // seq_len)
                total, check = total + int(n.sum()), zlib.crc32(n.astype("<i8").tobytes(), check)
        columns = [pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), total, check)]
        yield pa.RecordBatch.from_arrays(columns, names=["task", "n", "check"])
        release()

    counts = sorted(rows.mapInArrow(count, "task bigint, n bigint, check bigint").collect())  # a row per task
    first, total = {}, 0
    for task, n, check in counts:
        first[task] = (total, n, check)
        total += n
    begin = spark.sparkContext.broadcast(first)
    order = Permutation(max(1, total), key)
    stride, size = layout.record.itemsize, order.size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = open_tokenizer(tokenizer)
        number, expected, check = begin.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        seen, checked = 0, 0
        for batch in batches:
            for ids, texts in _parts(batch):
                flat, place = tok.encode(texts)
                tokens = np.diff(place) + 1
                n = -(-tokens // seq_len)
                owner = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                out = np.zeros(len(owner), layout.record)
                out["doc_id"] = np.array([NO_ID if i is None else i for i in ids], np.int64)[owner]
                out["piece"] = piece
                out["length"] = np.minimum(tokens[owner] - piece * seq_len, seq_len)
                # The rows of a document follow each other, so its tokens do in the flat table.
                padded = np.full(len(owner) * seq_len, end_id, layout.token)
                shift = (np.cumsum(n) - n) * seq_len - place[:-1]
                padded[np.repeat(shift, tokens - 1) + np.arange(len(flat))] = flat
                out["ids"] = padded.reshape(-1, seq_len)
                slots = order.slot(number + seen + np.arange(len(owner)))
                seen, checked = seen + len(owner), zlib.crc32(n.astype("<i8").tobytes(), checked)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots // shard_rows),
                        pa.array(slots),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(stride), len(out), [None, pa.py_buffer(out.tobytes())]
                        ).cast(pa.binary()),
                    ],
                    names=["shard", "slot", "record"],
                )
        release()
        if (seen, checked) != (expected, check):
            raise RuntimeError("the documents were not scanned in the same way twice")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, path, shard, slot, check = None, "", -1, 0, 0
        for batch in batches:
            for own, at, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    shard, slot = own, own * shard_rows
                    path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                    system, place = _open(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(place)
                if own != shard or at != slot:
                    raise RuntimeError(f"shard {shard} lacks slot {slot}")
                stream.write(record)
                slot, check = slot + 1, zlib.crc32(record, check)
        if stream is None:
            return
        stream.close()
        if slot != min((shard + 1) * shard_rows, size):
            raise RuntimeError(f"shard {shard} lacks slot {slot}")
        columns = (shard, path, shard * shard_rows, slot - shard * shard_rows, stride, check)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in columns], names=[x.split(" ")[0] for x in _MANIFEST.split(", ")]
        )

    shards = -(-total // shard_rows)
    records = rows.mapInArrow(emit, "shard bigint, slot bigint, record binary")
    if shards:  # a shard per task: its number is the number of the partition
        records = records.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    manifest = records.mapInArrow(write, _MANIFEST)
    path = scratch_path(spark, "shards")
    manifest.write.parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path), layout


def read_from(path: str, skip: int, layout: Layout, rows: int = 1024) -> Iterator[np.ndarray]:
    """Records of one shard from its record ``skip`` on, some at a time."""
    system, place = _open(path)
    stride = layout.record.itemsize
    with system.open_input_file(place) as f:
        f.seek(skip * stride)
        while data := f.read(rows * stride):
            yield np.frombuffer(data, layout.record)


def read_shards(manifest: DataFrame, layout: Layout, first_slot: int = 0) -> DataFrame:
    """The sequences from ``first_slot`` on: slot, shard, offset in bytes, doc_id, piece, ids.

    Shards before it are not opened, and the one that holds it is entered at its place.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = max(0, first_slot - first)
                for records in read_from(path, at, layout):
                    place = np.arange(at, at + len(records))
                    length = records["length"]
                    ids = pa.ListArray.from_arrays(
                        np.concatenate([[0], np.cumsum(length)]).astype(np.int32),
                        pa.array(records["ids"][np.arange(layout.seq_len) < length[:, None]].astype(np.int32)),
                    )
                    docs = [None if i == NO_ID else i for i in records["doc_id"].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(first + place),
                            pa.array([shard] * len(place), pa.int64()),
                            pa.array(place * layout.record.itemsize),
                            pa.array(docs, pa.int64()),
                            pa.array(np.ascontiguousarray(records["piece"])),
                            ids,
                        ],
                        names=["slot", "shard", "offset", "doc_id", "piece", "ids"],
                    )
                    at += len(records)

    some = manifest.where(F.col("first_slot") + F.col("records") > first_slot).select("shard", "path", "first_slot")
    spread = some.repartition(max(1, min(some.count(), 100_000)))
    return spread.mapInArrow(
        read, "slot bigint, shard bigint, offset bigint, doc_id bigint, piece int, ids array<int>"
    )
