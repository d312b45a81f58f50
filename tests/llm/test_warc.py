import hashlib
import struct

import pytest
import zstandard

from reviewlake.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest int, refers_to string"
LONG = "<p>é" * 600


@pytest.fixture(scope="module")
def rows():
    return [
        (1, "http://a/1", LONG), (5, "http://a/\r\n5", LONG), (3, None, LONG), (2, "http://a/2", "short"), (4, "u", "short"),
        (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000),
        (12, "u", "WARC/1.1\r\n\r\n" * 3), (None, "u", "y" * 1000), (None, "u", "z" * 5000), (13, "u", "big " * 600_000),
        (14, "u", "t" * 2000), (14, "u", "t" * 2000),
    ]


@pytest.fixture(scope="module")
def archive(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc")) + "/a"
    pages = spark.createDataFrame([(*r, "p", 1, "r") for r in rows], SCHEMA).repartition(2, "page_id")
    warc.write_archives(pages, folder, frame_bytes=3000, bundle_bytes=20_000)
    return folder


def _expected(rows):
    """By brute force: every row looks at all others."""
    for page_id, _, html in rows:
        data = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "").encode() == data and len(data) >= 1000]
        last = max(equal, key=lambda p: -1 if p is None else p, default=page_id)
        revisit = last != page_id
        yield (page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None)


def test_round_trip(spark, rows, archive):
    read = warc.read_archives(spark, archive)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()]
    assert sorted(got, key=repr) == sorted(_expected(rows), key=repr)
    texts = {(r.page_id, bytes(r.payload)) for r in read.where("record_type = 'response'").collect()}
    assert texts == {(p, (h or "").encode()) for (p, _, h), e in zip(rows, _expected(rows)) if e[3] == "response"}
    assert read.where("record_type = 'revisit' and payload is not null").count() == 0


def test_index_and_lookup(spark, rows, archive):
    index = warc.record_index(spark, archive).cache()
    assert index.count() == len(rows) and index.select("path").distinct().count() > 1
    found = warc.lookup(index, [3, 12, 14, 99])
    assert sorted(r.page_id for r in found.collect()) == [3, 12, 14, 14]
    assert found.where("page_id = 3").first().refers_to == 5
    assert warc.lookup(index, [99]).count() == 0
    assert {r.frame for r in index.collect()} > {0}


def test_any_zstandard_reader_reads_a_bundle(archive, spark):
    path = warc.record_index(spark, archive).first().path.removeprefix("file:")
    data = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    table = warc.seek_table(data)
    assert whole == b"".join(warc.frame_content(data, place) for place in table[:-1])
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1 and whole.startswith(b"WARC/1.1\r\n")
    for name, frame, at, size in warc.record_map(data, table):
        record = warc.frame_content(data, table[frame])[at : at + size]
        assert warc.decode_record(record)[1] == size and name.encode() in record


def test_damage_is_told():
    record = warc.encode_record(1, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError, match="page:1"):
        warc.decode_record(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="seekable"):
        warc.seek_table(b"x" * 40)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, html string")
    warc.write_archives(none, str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    assert warc.record_index(spark, str(tmp_path / "none")).count() == 0
