"""Legacy ARC archives to WARC: read, convert with revisits, and read back.

ARC (version 1 and 2) is a line per record that ends in the length of the block
behind it; the versions differ in the fields of that line, and the first record
of a file says which one it uses. The converter makes a WARC record of each:
identifier from the archive's name and the record's number, ISO date from the
14 digits, type from the scheme and the block, digests from the bytes.

Files are written by tasks into a shared folder under names that no other
attempt uses, and listed in a Parquet manifest; only listed files are read, so
an attempt that was lost leaves nothing behind that counts. Payloads never go
through a shuffle: what is joined is one narrow row per record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .storage import stored

FILE_BYTES = 256 << 20
REVISIT_BYTES = 1000
_LEVEL = 3
# The lines that the two versions of the format begin with.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records bigint, bytes bigint"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


class _Writer:
    """A gzip member per record, in files of about ``FILE_BYTES`` uncompressed."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix, self.attempt = root, suffix, uuid.uuid4().hex
        self.files, self.stream = 0, None
        self.path, self.records, self.bytes = "", 0, 0

    def open(self) -> str:
        """Begin the next file; its name without the part that tells attempts apart."""
        name = f"part-{_task():05d}-{self.files:04d}"
        system, path = _open(f"{self.root}/{name}-{self.attempt}.{self.suffix}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.path, self.files = f"{self.root}/{name}-{self.attempt}.{self.suffix}", self.files + 1
        self.stream, self.records, self.bytes = system.open_output_stream(path, compression=None), 0, 0
        return name

    def write(self, *parts: bytes) -> None:
        packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        for part in parts:
            self.stream.write(packer.compress(part))
            self.bytes += len(part)
        self.stream.write(packer.flush())
        self.records += 1

    @property
    def full(self) -> bool:
        return self.bytes >= FILE_BYTES

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        self.stream = None
        row = [[self.path], [self.records], [self.bytes]]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["path", "records", "bytes"]
        )


def _kept(spark: SparkSession, manifest: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    manifest.write.parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path)


def _spread(manifest: DataFrame) -> DataFrame:
    """A file per task, as far as a job can have that many tasks."""
    return manifest.repartition(max(1, min(manifest.count(), 100_000)))


def _uri(url: str | None) -> str:
    """A URL without blanks and control characters; ``-`` if there is none."""
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def write_arc(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "20050101000000",
    versions: tuple[int, ...] = (1, 2),
) -> DataFrame:
    """Write pages as HTTP responses into ARC files below ``root``; the manifest of the files.

    The id goes into a header of the response. Files take turns in ``versions``.
    Null payloads are empty, null URLs ``-``, null ids are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, version = _Writer(root, "arc.gz"), versions[_task() % len(versions)]
        for batch in batches:
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out.stream is None:
                    name = out.open()
                    block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
                    more = "" if version == 1 else f" 200 - - 0 {name}.arc"
                    line = f"filedesc://{name}.arc 0.0.0.0 {date} text/plain{more} {len(block)}\n"
                    out.write(line.encode(), block, b"\n")
                payload = payload or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                head += f"Content-Length: {len(payload)}\r\n" + (f"X-Source-Id: {key}\r\n" if key is not None else "")
                head = (head + "\r\n").encode()
                more = "" if version == 1 else f" 200 - - {out.bytes} {name}.arc"
                line = f"{_uri(url)} 0.0.0.0 {date} text/html{more} {len(head) + len(payload)}\n"
                out.write(line.encode(), head, payload, b"\n")
                if out.full:
                    yield out.close()
        if out.stream is not None:
            yield out.close()

    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(payload_col).cast("binary").alias("payload"),
    )
    return _kept(pages.sparkSession, rows.mapInArrow(write, _MANIFEST), "arc-files")


def read_arc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the header line, block) of each record of an uncompressed ARC stream.

    The first record is the file's own description; its second line's version
    says which fields the lines have. ValueError where a line has others or a
    block ends early.
    """
    fields = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        words = text.split(" ")
        if fields is None:
            if not text.startswith("filedesc://"):
                raise ValueError(f"not an ARC file: {text[:80]!r}")
            block = stream.read(int(words[-1]))
            version = int(block.split(b" ", 1)[0])
            fields = ARC_FIELDS[version].split(" ")
        else:
            block = stream.read(int(words[-1]) if words[-1].isdigit() else -1)
        if len(words) < len(fields) or not words[-1].isdigit() or len(block) != int(words[-1]):
            raise ValueError(f"damaged ARC record: {text[:80]!r}")
        extra = len(words) - len(fields)  # a URL with blanks
        words = [" ".join(words[: extra + 1]), *words[extra + 1 :]]
        yield dict(zip(fields, words, strict=True)), block


def _http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header lines (with the empty one) and payload; no header: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$".encode(), head)
    return found[1].decode() if found else None


def _isodate(digits: str) -> str:
    """ISO date of an ARC date; missing digits are the first month, day or zero."""
    d = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, number: int) -> str:
    """Identifier of record ``number`` of an archive, by its name without folder."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def _records(path: str) -> Iterator[tuple[int, str, dict[str, str], bytes]]:
    """(number, archive name, fields, block) of the records of an ARC file."""
    system, place = _open(path)
    with system.open_input_stream(place, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) if path.endswith(".gz") else io.BufferedReader(raw)
        archive = ""
        for number, (fields, block) in enumerate(read_arc(stream)):
            archive = archive or fields["URL"].removeprefix("filedesc://")
            yield number, archive, fields, block


_SALTS = 256
_INDEX = "path string, number bigint, archive string, id string, uri string, date string, digest string, payload_bytes bigint"


def index(manifest: DataFrame) -> DataFrame:
    """A narrow row per record of the listed ARC files: place, id, URI, date, digest, size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _INDEX.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for number, archive, fields, block in _records(path):
                    head, payload = _http(block)
                    digest = hashlib.sha1(payload).hexdigest()
                    date = _isodate(fields["Archive-date"])
                    rows.append((path, number, archive, _header(head, "X-Source-Id"), fields["URL"], date, digest, len(payload)))
                    if len(rows) == 10_000:
                        yield _batch(names, rows)
                        rows = []
                if rows:
                    yield _batch(names, rows)

    return _spread(manifest.select("path")).mapInArrow(scan, _INDEX)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "number": pa.int64(),
        "payload_bytes": pa.int64(),
        "payload": pa.binary(),
    }
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names
    )


def decide(records: DataFrame, order: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with ``first``: of equal payloads of ``least`` bytes or more, the one that the
    others revisit (largest ``order``; ties: last by place); null for it and for smaller ones.

    Records of a digest are in up to ``_SALTS`` parts, by their place, and the response is sent to
    those parts that a repeated digest has, so a payload served any number of times is no single key.
    """
    large, small = F.col("payload_bytes") >= least, F.col("payload_bytes") < least
    place = F.struct(order.alias("order"), "path", "number", "archive", "id", "uri", "date")
    salted = records.where(large).withColumn("salt", F.pmod(F.xxhash64("path", "number"), F.lit(_SALTS)).cast("int"))
    parts = salted.groupBy("digest", "salt").agg(F.max(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = parts.groupBy("digest").agg(
        F.max("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")
    )
    first = first.where("n > 1").select("digest", "first", F.explode("salts").alias("salt"))
    decided = salted.join(first, ["digest", "salt"], "left").drop("salt")
    own = (F.col("first.path") == F.col("path")) & (F.col("first.number") == F.col("number"))
    decided = decided.withColumn("first", F.when(~own, F.col("first")))
    return decided.unionByName(records.where(small), allowMissingColumns=True)


def _warc(fields: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes, bytes]:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogateescape"), block, b"\r\n\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _converted(number: int, archive: str, fields: dict[str, str], block: bytes, first: dict | None) -> tuple:
    """The WARC record of an ARC record."""
    uri, head, payload = fields["URL"], *_http(block)
    common = [("WARC-Record-ID", record_id(archive, number)), ("WARC-Date", _isodate(fields["Archive-date"]))]
    if uri.startswith("filedesc://"):
        return _warc([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", archive), ("Content-Type", "text/plain")], block)
    common += [("WARC-Target-URI", uri)]
    if fields["IP-address"] != "0.0.0.0":
        common += [("WARC-IP-Address", fields["IP-address"])]
    if not head:  # DNS and other records without HTTP
        kind = [("WARC-Type", "resource"), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", fields["Content-type"])]
        return _warc([*kind, *common], block)
    common += [("WARC-Payload-Digest", _sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        return _warc([("WARC-Type", "response"), *common, ("WARC-Block-Digest", _sha1(block))], block)
    refers = [
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", record_id(first["archive"], first["number"])),
        ("WARC-Refers-To-Target-URI", first["uri"]),
        ("WARC-Refers-To-Date", first["date"]),
        ("X-Payload-Length", str(len(payload))),
    ]
    if first["id"] is not None:
        refers.append(("X-Refers-To-Source-Id", first["id"]))
    return _warc([("WARC-Type", "revisit"), *common, *refers, ("WARC-Block-Digest", _sha1(head))], head)


def convert(manifest: DataFrame, root: str, order: Column | None = None, least: int = REVISIT_BYTES) -> DataFrame:
    """Convert the listed ARC files to WARC files below ``root``; the manifest of those.

    ``order`` chooses the response among equal payloads (default: the id as a
    whole number); see ``decide``. Each ARC file becomes a WARC file.
    """
    records = stored(index(manifest), "archive-index")  # the files are read and hashed once for it
    order = F.expr("try_cast(id AS bigint)") if order is None else order
    decided = decide(records, order, least).select("path", "number", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, source, open_path = _Writer(root, "warc.gz"), iter(()), None
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("path", "number", "first"))
            for path, number, first in zip(*columns, strict=True):
                if path != open_path:
                    if out.stream is not None:
                        yield out.close()
                    source, open_path = _records(path), path
                    out.open()
                at, archive, fields, block = next(source)
                if at != number:
                    raise ValueError(f"{path} changed while it was converted")
                out.write(*_converted(number, archive, fields, block, first))
        if out.stream is not None:
            yield out.close()

    tasks = max(1, min(manifest.count(), 100_000))
    rows = decided.repartition(tasks, "path").sortWithinPartitions("path", "number")
    return _kept(manifest.sparkSession, rows.mapInArrow(write, _MANIFEST), "warc-files")


def _read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError(f"damaged WARC record: {fields.get('warc-record-id')}")
        yield fields, block


_WARC = (
    "id string, record_id string, record_type string, uri string, date string, payload_bytes bigint, "
    "payload_digest string, refers_to string, refers_to_record string"
)


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per response, resource and revisit record of the listed WARC files.

    ``payload_digest`` (hexadecimal SHA-1) and ``payload_bytes`` are of the full
    payload, also for revisits; ``refers_to`` is the id of the record that a
    revisit points to. Stored digests are compared with the bytes: ValueError if
    they differ. ``with_payload`` adds the payload (null for revisits).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _WARC.split(", ")] + ["payload"] * with_payload
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                system, place = _open(path)
                with system.open_input_stream(place, compression=None) as raw:
                    for fields, block in _read_warc(gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20))):
                        kind = fields["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        head, payload = _http(block)
                        if fields["warc-block-digest"] != _sha1(block):
                            raise ValueError(f"{fields['warc-record-id']}: the block is not the one written")
                        digest = fields.get("warc-payload-digest") or _sha1(payload)
                        if kind == "response" and digest != _sha1(payload):
                            raise ValueError(f"{fields['warc-record-id']}: the payload is not the one written")
                        n = int(fields["x-payload-length"]) if kind == "revisit" else len(payload)
                        row = (
                            _header(head, "X-Source-Id"),
                            fields["warc-record-id"],
                            kind,
                            fields.get("warc-target-uri"),
                            fields["warc-date"],
                            n,
                            base64.b32decode(digest.removeprefix("sha1:")).hex(),
                            fields.get("x-refers-to-source-id"),
                            fields.get("warc-refers-to"),
                        )
                        rows.append((*row, None if kind == "revisit" else payload) if with_payload else row)
                        size += len(payload) if with_payload else 200
                        if size > 8 << 20:
                            yield _batch(names, rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(names, rows)

    schema = _WARC + ", payload binary" * with_payload
    return _spread(manifest.select("path")).mapInArrow(scan, schema)
