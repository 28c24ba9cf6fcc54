import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from siftframe.llm import archives
from siftframe.sources.scratch import scratch_path

BIG = "<p>" + "x" * 2000


def written(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, id string")
    root = scratch_path(spark, "test-archives")
    legacy = archives.write_arc(pages, f"{root}/arc", **more)
    return legacy, archives.convert(legacy, f"{root}/warc")


@pytest.mark.parametrize("versions", [(1,), (2,)])
def test_round_trip(spark, versions):
    rows = [
        (1, "http://a/ b", BIG, "c"),
        (2, None, None, "c"),
        (3, "http://a/é", "", None),
        (4, "http://a", "short\n\nWARC/1.1\r\n", "c"),
        (5, "http://a", BIG, "c"),
        (6, "http://a", "short\n\nWARC/1.1\r\n", "c"),
        (None, "http://n", BIG, "c"),
        (7, "http://b", "é" * 500, "c"),
        (8, "http://b", "é" * 500, "c"),
        (8, "http://b", "é" * 500, "c"),
        (9, "http://l", "日" * 300_000, "c"),
    ]
    _, warc = written(spark, rows, versions=versions)
    out = archives.read_warc(warc, with_payload=True).collect()
    assert len(out) == len(rows) == len({r["record_id"] for r in out})
    ids = {r["record_id"]: r for r in out}
    for i, _, html, _ in rows:
        own = [r for r in out if r["id"] == (None if i is None else str(i))]
        assert {r["payload_digest"] for r in own} == {hashlib.sha1((html or "").encode()).hexdigest()}
        assert {r["payload_bytes"] for r in own} == {len((html or "").encode())}
    kinds = sorted((r["id"] or "", r["record_type"], r["refers_to"]) for r in out)
    assert kinds == [
        ("", "revisit", "5"),
        ("1", "revisit", "5"),
        *((str(i), "response", None) for i in (2, 3, 4, 5, 6)),
        ("7", "revisit", "8"),
        ("8", "response", None),
        ("8", "revisit", "8"),
        ("9", "response", None),
    ]
    for r in out:
        assert r["date"] == "2005-01-01T00:00:00Z"
        if r["record_type"] == "revisit":
            assert ids[r["refers_to_record"]]["id"] == r["refers_to"]
            assert r["payload"] is None
        else:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]


def test_records_are_separate_members(spark):
    _, warc = written(spark, [(1, "http://a", BIG, None), (2, "http://b", BIG, None)])
    data = b""
    for r in warc.collect():
        system, place = archives._open(r["path"])
        data += system.open_input_stream(place, compression=None).read()
    assert data.count(b"\x1f\x8b\x08") >= 3
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in text


def test_responses_are_those_of_the_plain_rule(spark):
    rows = [(f"p{i % 7}", i, "a", str(i // 3), "u", "d", f"hot{i % 50 // 49}" if i % 3 else f"cold{i}", 999 + i % 2) for i in range(3_000)]
    records = spark.createDataFrame(rows, archives._INDEX)
    order = F.expr("try_cast(id AS bigint)")
    decided = archives.decide(records, order).collect()
    assert len(decided) == len(rows)
    last = {}
    for path, number, _, i, _, _, digest, size in rows:
        if size >= 1000:
            last[digest] = max(last.get(digest, (-1, "", 0)), (int(i), path, number))
    for r in decided:
        response = last.get(r["digest"]) if r["payload_bytes"] >= 1000 else None
        expected = None if response is None or response[1:] == (r["path"], r["number"]) else response
        assert (r["first"] and (r["first"]["order"], r["first"]["path"], r["first"]["number"])) == expected


def test_empty_table(spark):
    legacy, warc = written(spark, [])
    assert legacy.count() == warc.count() == archives.read_warc(warc).count() == 0


ARC1 = (
    b"filedesc://old.arc 0.0.0.0 1996 text/plain 76\n"
    b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"
    b"\nhttp://a/x y 1.2.3.4 199612 text/html 22\nHTTP/1.0 200 OK\n\nbody\n"
    b"\ndns:a 9.9.9.9 19961231235959 text/dns 7\na A 1.1\n"
)


def test_legacy_lines():
    (_, head), (page, block), (dns, answer) = archives.read_arc(io.BytesIO(ARC1))
    assert page["URL"] == "http://a/x y"
    assert archives._http(block) == (b"HTTP/1.0 200 OK\n\n", b"body\n")
    record = b"".join(archives._converted(1, "old.arc", page, block, None))
    assert b"WARC-Date: 1996-12-01T00:00:00Z" in record
    assert b"WARC-IP-Address: 1.2.3.4" in record
    resource = b"".join(archives._converted(2, "old.arc", dns, answer, None))
    assert resource.startswith(b"WARC/1.1\r\nWARC-Type: resource")
    assert len(head) == 76


@pytest.mark.parametrize("cut", [ARC1[:-10], ARC1.replace(b"text/dns 7", b"text/dns x"), b"no archive\n"])
def test_damage_is_an_error(cut):
    with pytest.raises(ValueError, match="ARC"):
        list(archives.read_arc(io.BytesIO(cut)))
