"""Duplicated code: runs of lines that stand elsewhere too, in the same file or in another.

A shingle is ``LINES`` lines in a row, stripped, blank ones left out. Shingles are hashed with their place, hashes are
counted over the corpus, and places whose hash is there more than once are joined into regions as long as they go on
line by line. Equal shingles never meet as pairs: their number is a sum, known to each place. The most frequent hashes, as
many as the session lets Spark broadcast, are looked up where the places are written, and neighbours become one run there;
the other places get theirs by an equi-join whose other side has one row per hash, so a hot shingle that is left there
is split like any skewed key. Texts stay where they are read. Places are written by file, as arrays of 128-bit hashes and of line
numbers, and only what is counted, joined or merged becomes a row of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewlake.operators.scan import reviewable
from reviewlake.session import materialize

LINES = 4
KEY = ["k1", "k2"]
CHUNK = 1 << 16  # places in a row of the written table
_OFTEN_BYTES, _MOST_BYTES = 32, 64 << 20  # of a hash and its number, as broadcast, and of all of them
_PIECE_BYTES = 8 << 20  # what a worker takes apart at once
_COUNTED = 1 << 20  # places that a worker counts before they are rows
_HASH_KEYS = ("reviewlake.dup.1", "reviewlake.dup.2")
_BLANK = "".join(char for char in map(chr, range(0x3001)) if char.isspace())  # what ``text.strip`` strips
_CHUNKS = "own int, start int, k1 binary, k2 binary, first_line binary, last_line binary"


def shingles(files: DataFrame, lines: int = LINES) -> DataFrame:
    """Every ``lines`` lines in a row of every code file, in a row per file, or several for a long one: ``file_id``, ``own`` (the
    file's lines that are not blank), ``start`` (the place of the first one), and for each its hash ``k1`` and ``k2`` (64-bit) and
    its ``first_line`` and ``last_line`` (32-bit)."""
    texts = reviewable(files).select("file_id", F.make_valid_utf8("content").alias("content"))
    return texts.mapInArrow(_shingles(lines), f"file_id {_kind(texts)}, {_CHUNKS}")


def duplicated_regions(files: DataFrame, lines: int = LINES) -> DataFrame:
    """Maximal regions: ``file_id``, ``first_line``, ``last_line``, ``lines`` (without blank ones), and ``copies``, how often
    its most frequent shingle is there in all files."""
    return _regions(materialize(shingles(files, lines), "shingles"), lines)


def duplication_ratio(files: DataFrame, lines: int = LINES) -> DataFrame:
    """Per code file with content: its lines that are not blank, those in duplicated regions, and their share."""
    found = materialize(shingles(files, lines), "shingles")
    regions = _regions(found, lines).groupBy("file_id").agg(F.sum("lines").alias("duplicated"))
    sizes = found.where("start = 0").select("file_id", F.col("own").cast("long").alias("lines"))
    joined = sizes.join(regions, "file_id", "left").withColumn("duplicated", F.coalesce("duplicated", F.lit(0).cast("long")))
    return joined.withColumn("ratio", F.when(F.col("lines") > 0, F.col("duplicated") / F.col("lines")).otherwise(0.0))


def _regions(found: DataFrame, lines: int) -> DataFrame:
    spark, kind = found.sparkSession, _kind(found)
    counted = found.select(*KEY).mapInArrow(_counts, "k1 long, k2 long, n long")
    # written: Spark splits a hot key only between two sides that it has dealt for the join itself
    several = materialize(counted.groupBy(*KEY).agg(F.sum("n").alias("copies")).where("copies > 1"), "repeated")
    often = spark.sparkContext.broadcast(_often(several))
    runs = found.mapInArrow(_runs(often), f"file_id {kind}, pos int, first_line int, last_line int, copies long, n int")
    rest = found.mapInArrow(_rest(often), f"file_id {kind}, pos int, first_line int, last_line int, k1 long, k2 long")
    repeated = runs.unionByName(rest.join(several, KEY).drop(*KEY).withColumn("n", F.lit(1)))
    before = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    islands = repeated.withColumn("island", F.col("pos") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    return islands.groupBy("file_id", "island").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"),
        (F.sum("n") + (lines - 1)).alias("lines"), F.max("copies").alias("copies"),
    ).drop("island")


def _kind(files: DataFrame) -> str:
    return files.schema["file_id"].dataType.simpleString()


def _broadcast_bytes(spark: SparkSession) -> int:
    number, unit = re.match(r"(-?\d+)\s*([kmgt]?)", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()).groups()
    return max(int(number), 0) << 10 * " kmgt".index(unit or " ")


def _often(several: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and copies of the most frequent shingles, by hash: those with more than an n-th of all places, n at most."""
    n = min(_broadcast_bytes(several.sparkSession), _MOST_BYTES) // _OFTEN_BYTES
    least = (several.agg(F.sum("copies")).first()[0] or 0) // n + 1 if n else None
    found = several.where(F.col("copies") >= least if n else F.lit(False)).toArrow()
    k1, k2, copies = (found[name].to_numpy() for name in (*KEY, "copies"))
    order = np.argsort(k1)
    return k1[order], k2[order], copies[order]


def _pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``_PIECE_BYTES`` of a column, each of one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + _PIECE_BYTES, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrays as binary values, one up to each end."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The arrays of a column, one after the other."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data[int(offsets[0]):int(offsets[-1])], kind) if data else np.empty(0, kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _shingles(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for piece in _pieces(batches, "content"):
            split = pc.split_pattern(piece.column("content"), "\n")
            file = pc.list_parent_indices(split).to_numpy().astype(np.int64)
            sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
            line = np.arange(1, len(file) + 1) - (np.cumsum(sizes) - sizes)[file]
            # each distinct line is hashed once
            coded = pc.utf8_trim(split.flatten(), characters=_BLANK).dictionary_encode()
            code, texts = coded.indices.to_numpy(), coded.dictionary
            filled = (pc.binary_length(texts).to_numpy() > 0)[code]
            file, line, code = file[filled], line[filled].astype(np.int32), code[filled]
            first = np.flatnonzero(file[:max(len(file) - k + 1, 0)] == file[k - 1:])
            texts = texts.to_numpy(zero_copy_only=False)

            def hashed(key):
                by_line, h = hash_array(texts, hash_key=key, categorize=False)[code], np.zeros(len(first), np.uint64)
                for at in range(k):
                    h = _mixed(h + by_line[first + at] + np.uint64(0x9E3779B97F4A7C15))
                return h

            own = np.bincount(file, minlength=len(piece))
            places = np.maximum(own - k + 1, 0)
            chunks = np.maximum(-(-places // CHUNK), 1)
            row = np.repeat(np.arange(len(piece)), chunks)
            start = (np.arange(len(row)) - (np.cumsum(chunks) - chunks)[row]) * CHUNK
            ends = np.cumsum(np.minimum(places[row] - start, CHUNK))
            yield pa.RecordBatch.from_arrays([
                piece.column("file_id").take(pa.array(row)), pa.array(own[row].astype(np.int32)), pa.array(start.astype(np.int32)),
                *(_packed(hashed(key), ends) for key in _HASH_KEYS), _packed(line[first], ends), _packed(line[first + k - 1], ends),
            ], ["file_id", "own", "start", *KEY, "first_line", "last_line"])

    return run


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes with their number, summed up over some of the places."""
    held, places = [], 0
    for piece in _pieces(batches, "k1"):
        held.append([_unpacked(piece.column(name), np.int64) for name in KEY])
        places += len(held[-1][0])
        if places >= _COUNTED:
            yield _counted(held)
            held, places = [], 0
    if places:
        yield _counted(held)


def _counted(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    k1, k2 = map(np.concatenate, zip(*held))
    order = np.argsort(k1)
    k1, k2 = k1[order], k2[order]
    starts = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
    n = np.diff(np.append(starts, len(k1)))
    return pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(n)], [*KEY, "n"])


def _places(batches: Iterable[pa.RecordBatch], often) -> Iterator[tuple]:
    """Pieces as (file_id, row, pos, first_line, last_line, k1, k2, copies) by place, copies 0 where the hash is not among those
    looked up; ``file_id`` by row."""
    known1, known2, copies = often.value
    for piece in _pieces(batches, "k1"):
        k1, k2 = (_unpacked(piece.column(name), np.int64) for name in KEY)
        first, last = (_unpacked(piece.column(name), np.int32) for name in ("first_line", "last_line"))
        sizes = pc.binary_length(piece.column("k1")).to_numpy().astype(np.int64) // 8
        row = np.repeat(np.arange(len(piece)), sizes)
        pos = np.arange(len(row)) - (np.cumsum(sizes) - sizes - piece.column("start").to_numpy())[row]
        number = np.zeros(len(k1), np.int64)
        if len(known1):
            at = np.minimum(np.searchsorted(known1, k1), len(known1) - 1)
            number = np.where((known1[at] == k1) & (known2[at] == k2), copies[at], 0)
        yield piece.column("file_id"), row, pos.astype(np.int32), first, last, k1, k2, number


def _runs(often) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places with a frequent hash that follow each other, as one row with their number."""
    def run(batches):
        for file_id, row, pos, first, last, _, _, copies in _places(batches, often):
            at = np.flatnonzero(copies)
            if not len(at):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])]))
            ends = np.append(starts[1:], len(at))
            begin, end = at[starts], at[ends - 1]
            yield pa.RecordBatch.from_arrays([
                file_id.take(pa.array(row[begin])), pa.array(pos[begin]), pa.array(first[begin]), pa.array(last[end]),
                pa.array(np.maximum.reduceat(copies[at], starts)), pa.array((ends - starts).astype(np.int32)),
            ], ["file_id", "pos", "first_line", "last_line", "copies", "n"])

    return run


def _rest(often) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The other places, a row for each."""
    def run(batches):
        for file_id, row, pos, first, last, k1, k2, copies in _places(batches, often):
            at = np.flatnonzero(copies == 0)
            yield pa.RecordBatch.from_arrays(
                [file_id.take(pa.array(row[at])), *(pa.array(values[at]) for values in (pos, first, last, k1, k2))],
                ["file_id", "pos", "first_line", "last_line", *KEY])

    return run
