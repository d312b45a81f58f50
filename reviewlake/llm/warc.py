"""WARC archives as seekable Zstandard bundles.

Each page is one record: an HTTP response with its payload, or a ``revisit`` that names the response holding the same
payload. Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``, frames into bundles of about
``BUNDLE_BYTES``, one file each. A bundle ends in two skippable frames, which ordinary Zstandard readers pass over: the
record map (record id, frame, offset within the frame's content, length) and the seek table of the public seekable
format (sizes of all frames, their number, the format's magic number). One record is read by seeking to one frame.

Tasks pack their rows as they come, so writing needs no shuffle beyond the join that finds equal payloads: payloads are
known by SHA-1 and length, and a group of copies is one row of that join's other side. Files go through Spark's own
text sink, whose line separator is set to the last four bytes of a bundle, so a retried task replaces its files
whole, on any store that Spark writes to; they are read by the binary file source.

Results in special cases: a null text is an empty payload; a null page_id counts as the smallest one; rows that share the
largest page_id of their payload are all responses, as nothing earlier is there to refer to; a payload beyond the bundle's
size makes a frame and a bundle of its own (2 GB is the limit of a Spark value). An empty table gives no files and no
rows. Other columns than page_id, url and html are not read, whatever their names; a missing url is left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.llm.common import NULL_ID, real_id, whole
from reviewlake.session import materialize, new_folder

#: Payloads below this size are always written in full.
REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 * 2**10, 32 * 2**20, 3
#: Fixed values of the formats: skippable frames, the end of a seek table, and the profile of revisit records.
MAP_FRAME, SEEK_FRAME = 0x184D2A50, 0x184D2A5E
SEEKABLE = b"\xb1\xea\x92\x8f"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary"
)
MAP = "record_id string, frame int, at long, size long, frame_at long, frame_size long"


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def page_of(record: str) -> int:
    return int(record.removeprefix("<urn:page:").removesuffix(">"))


# --- one record ----------------------------------------------------------------------------------


def _head(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *(f"{name}: {value}" for name, value in fields), "", ""]).encode()


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def encode_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head of its response, and no payload."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def decode_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one does. A response's digest is taken from its payload."""
    end = data.index(b"\r\n\r\n", at)
    warc = _fields(data[at:end])
    block, next_at = end + 4, end + 8 + int(warc["Content-Length"])
    end = data.index(b"\r\n\r\n", block)
    http = _fields(data[block:end])
    told = warc["WARC-Payload-Digest"].removeprefix("sha1:")
    row = {
        "page_id": page_of(warc["WARC-Record-ID"]), "url": warc.get("WARC-Target-URI"), "record_type": warc["WARC-Type"],
        "refers_to": None, "payload_bytes": int(http["Content-Length"]), "payload_digest": told, "payload": None,
    }
    if warc["WARC-Type"] == "revisit":
        row["refers_to"] = page_of(warc["WARC-Refers-To"])
    else:
        row["payload"] = data[end + 4 : next_at - 4]
        row["payload_digest"] = hashlib.sha1(row["payload"]).hexdigest()
        if row["payload_digest"] != told or len(row["payload"]) != row["payload_bytes"]:
            raise ValueError(f"{warc['WARC-Record-ID']}: the payload is not the one that was written")
    return row, next_at


# --- one bundle ----------------------------------------------------------------------------------


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def pack(records: Iterable[tuple[str, bytes]], frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> Iterator[bytes]:
    """Bundles of (record id, record) pairs; a bundle ends where its records reach ``bundle_bytes``."""
    compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
    frames: list[bytes] = []
    sizes: list[tuple[int, int]] = []
    places: list[tuple[str, int, int, int]] = []
    open_: list[bytes] = []
    in_frame = in_bundle = 0

    def close_frame():
        nonlocal in_frame
        frames.append(compress(b"".join(open_)))
        sizes.append((len(frames[-1]), in_frame))
        open_.clear()
        in_frame = 0

    def close_bundle():
        nonlocal in_bundle
        if open_:
            close_frame()
        frames.append(_skippable(MAP_FRAME, zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(places).encode())))
        sizes.append((len(frames[-1]), 0))
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IB", len(sizes), 0) + SEEKABLE
        out = b"".join([*frames, _skippable(SEEK_FRAME, table)])
        frames.clear(), sizes.clear(), places.clear()
        in_bundle = 0
        return out

    for name, record in records:
        places.append((name, len(frames), in_frame, len(record)))
        open_.append(record)
        in_frame += len(record)
        in_bundle += len(record)
        if in_frame >= frame_bytes:
            close_frame()
        if in_bundle >= bundle_bytes:
            yield close_bundle()
    if places:
        yield close_bundle()


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame, from the footer alone."""
    n, flags = struct.unpack_from("<IB", bundle, len(bundle) - 9)
    if bundle[-4:] != SEEKABLE or flags:
        raise ValueError("not a bundle of seekable frames")
    found, at = [], 0
    for stored, content in struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * n : len(bundle) - 9]):
        found.append((at, stored, content))
        at += stored
    return found


def record_map(bundle: bytes, table: list[tuple[int, int, int]]) -> list[list]:
    """[record id, frame, offset within the frame's content, length] of each record."""
    at, size, _ = table[-1]
    packed = bundle[at + 8 : at + size]
    return json.loads(zstandard.ZstdDecompressor().decompressobj().decompress(packed))


def frame_content(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    at, stored, content = place
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + stored], max_output_size=content)


# --- over Spark ----------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to``: the page that holds an equal payload, else null."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.encode(whole(F.col("html")), "UTF-8")
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id"), url.alias("url"),
        payload.alias("payload"), F.sha1(payload).alias("digest"),
    ).withColumn("n", F.octet_length("payload"))
    # written, as Spark splits a hot payload only between two sides that it has dealt for the join itself
    several = materialize(rows.where(F.col("n") >= least).groupBy("digest", "n").agg(
        F.max("page_id").alias("first"), F.count("*").alias("copies")
    ).where("copies > 1").drop("copies"), "equal-payloads")
    joined = rows.join(several, ["digest", "n"], "left")
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    )


def _write(frame_bytes: int, bundle_bytes: int):
    def records(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                yield record_id(row["page_id"]), encode_record(**row)

    def run(batches):
        for bundle in pack(records(batches), frame_bytes, bundle_bytes):
            # the sink puts the separator after it, which is the end of the bundle
            yield pa.RecordBatch.from_arrays([pa.array([bundle[: -len(SEEKABLE)]], pa.binary())], ["bundle"])

    return run


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """One record per page, in bundles below ``folder``."""
    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    bundles = rows.mapInArrow(_write(frame_bytes, bundle_bytes), "bundle binary")
    one_each = bundles.select(F.col("bundle").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    one_each.option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE.decode("latin-1")).text(folder)


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).where("length > 0")


def _bundles(batches) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            yield path.as_py(), content.as_py()


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in kinds], [n for n, _ in kinds])


def _read_all(batches):
    for _, bundle in _bundles(batches):
        for place in seek_table(bundle)[:-1]:
            content, at, rows = frame_content(bundle, place), 0, []
            while at < len(content):
                row, at = decode_record(content, at)
                rows.append(row)
            yield _record_batch(rows)


def _real(records: DataFrame) -> DataFrame:
    return records.withColumns({"page_id": real_id(F.col("page_id")), "refers_to": real_id(F.col("refers_to"))})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the bundles below ``folder``, each response checked against its digest."""
    return _real(_files(spark, folder).select("path", "content").mapInArrow(_read_all, RECORDS))


def _read_maps(batches):
    for path, bundle in _bundles(batches):
        table = seek_table(bundle)
        rows = [(path, *r, *table[r[1]][:2]) for r in record_map(bundle, table)]
        names = ["path", "record_id", "frame", "at", "size", "frame_at", "frame_size"]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def record_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each record is: ``path``, ``record_id``, ``frame``, its offset ``at`` and ``size`` there, and the frame's place."""
    return _files(spark, folder).select("path", "content").mapInArrow(_read_maps, f"path string, {MAP}")


def _read_wanted(batches):
    for batch in batches:
        for row in batch.to_pylist():
            bundle, table = row["content"], seek_table(row["content"])
            for frame in sorted({w["frame"] for w in row["wanted"]}):
                content = frame_content(bundle, table[frame])
                found = [decode_record(content, w["at"])[0] for w in row["wanted"] if w["frame"] == frame]
                yield _record_batch(found)


def lookup(index: DataFrame, page_ids: list[int]) -> DataFrame:
    """The records of a list of pages by a (written) ``record_index``: their bundles are read, and of those their frames.

    The list is given by the caller; the paths of its bundles, at most one each, go through the driver. A page that is
    not there has no record; one that is there several times has all of its records.
    """
    spark = index.sparkSession
    wanted = index.where(F.col("record_id").isin([record_id(p) for p in page_ids]))
    paths = [row.path for row in wanted.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], RECORDS)
    places = wanted.groupBy("path").agg(F.collect_list(F.struct("frame", "at")).alias("wanted"))
    found = _files(spark, *paths).select("path", "content").join(places, "path")
    return _real(found.select("content", "wanted").mapInArrow(_read_wanted, RECORDS))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes the pages into a new folder of the shared place and reads the archives back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder)
