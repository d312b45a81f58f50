"""File list source: a folder, or a table of raw bytes, to source files and rejects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlake.functions import text

# A Spark value cannot be longer than this; sources.long_files reads what is.
MAX_BYTES = 2**31 - 1


def relative_name(path: Column, root: str) -> Column:
    """A file's path from ``root`` on, so that the root's own name never decides what is a code file."""
    plain = re.sub(r"\A[a-zA-Z0-9]+:/+", "/", root).rstrip("/") + "/"
    path = F.regexp_replace(path, r"\A[a-zA-Z0-9]+:/+", "/")
    at = F.instr(path, plain)
    return F.when(at > 0, F.substring(path, at + len(plain), F.length(path))).otherwise(path)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """``filename``, ``size`` and ``data`` of every file below ``root``, the name as from there.

    A file that is longer than a value has no data here; ``long_files.read_parts`` gives it in parts.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = found.where(F.col("length") <= MAX_BYTES)
    large = found.where(F.col("length") > MAX_BYTES)
    name = relative_name(F.col("path"), root).alias("filename")
    return small.select(name, F.col("length").alias("size"), F.col("content").alias("data")).unionByName(
        large.select(name, F.col("length").alias("size"), F.lit(None).cast("binary").alias("data"))
    )


def source_files(raw: DataFrame) -> DataFrame:
    """Code files with decoded text, ``status='review'`` and an empty patch.

    ``raw`` has ``filename`` and ``data``; further columns go through. Without a ``file_id`` a file is
    known by a hash of its name, and without a ``file_ord`` files are in order of their names, which
    needs no global sort. Files that are not UTF-8 are left to ``skipped_files``.
    """
    if "file_id" not in raw.columns:
        raw = raw.withColumn("file_id", F.xxhash64("filename"))
    if "file_ord" not in raw.columns:
        raw = raw.withColumn("file_ord", F.col("filename"))
    decoded = _decoded(raw.where(text.is_code_file(F.col("filename"))))
    return decoded.where(F.col("content").isNotNull()).withColumns({
        "ext": text.file_ext(F.col("filename")), "status": F.lit("review"), "patch": F.lit(""),
    })


def _decoded(raw: DataFrame) -> DataFrame:
    content = text.unify_newlines(text.decode_utf8(F.col("data")))
    return raw.withColumn("content", content).drop("data")


def skipped_files(raw: DataFrame) -> DataFrame:
    """The files that ``source_files`` leaves out, with the reason."""
    reason = (
        F.when(~text.is_code_file(F.col("filename")), "not a code file")
        .when(F.col("data").isNull(), "too large")
        .when(text.decode_utf8(F.col("data")).isNull(), "not UTF-8")
    )
    return raw.select("filename", reason.alias("reason")).where(F.col("reason").isNotNull())


def missing_files(wanted: DataFrame, raw: DataFrame) -> DataFrame:
    """Names asked for that are not there."""
    names = raw.select("filename")
    return wanted.join(names, "filename", "left_anti").select(
        "filename", F.lit("not found").alias("reason")
    )


def listed_files(wanted: DataFrame, raw: DataFrame) -> DataFrame:
    """The files of a list, in its order: ``wanted`` has ``filename`` and ``file_ord``."""
    return raw.join(wanted, "filename")
