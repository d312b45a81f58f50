"""Change requests: exported headers, changed files, and their content at the head revision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reviewlake.functions import text
from reviewlake.schemas import CHANGED_FILES, CHANGES, EXPORT
from reviewlake.session import materialize


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(CHANGES).load(path)


def read_changed_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(CHANGED_FILES).load(path)


@dataclass(frozen=True)
class Export:
    """What an export held: headers, changed files, and the texts that are not a change."""

    changes: DataFrame
    files: DataFrame
    rejects: DataFrame


def read_export(spark: SparkSession, path: str) -> Export:
    """An export of one JSON object per line, a change with its ``files`` nested in their order.

    It is read and parsed once, into a table that the three parts select from. A line that is not such an object, or whose
    ``change_id`` is missing, is kept as a reject with its text; blank lines are nothing. A change without files
    is a change all the same.
    """
    schema = T.StructType([*EXPORT.fields, T.StructField("_text", T.StringType())])
    rows = spark.read.text(path, recursiveFileLookup=True).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_text"}
    parsed = rows.select("value", F.from_json("value", schema, options).alias("change"))
    parsed = materialize(parsed.select("value", "change.*"), "export")
    known = parsed.where("_text is null and change_id is not null")
    listed = known.select("change_id", F.posexplode("files").alias("file_ord", "file")).select(
        "change_id", F.col("file_ord").cast("long").alias("file_ord"),
        F.xxhash64("change_id", "file.filename", "file_ord").alias("file_id"), "file.*",
    )
    return Export(
        known.select(*CHANGES.fieldNames()), listed.where("filename is not null"),
        parsed.where("_text is not null or change_id is null").select(F.col("value").alias("text")),
    )


def changed_code_files(files: DataFrame) -> DataFrame:
    """Changed code files; a missing patch is an empty one."""
    kept = files.where(text.is_code_file(F.col("filename")))
    return kept.withColumns({
        "ext": text.file_ext(F.col("filename")), "patch": F.coalesce("patch", F.lit("")),
    })


def with_head_content(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds the content at the head revision: NULL for removed, unknown and undecodable files.

    ``contents`` has ``change_id``, ``filename`` and ``data`` (bytes). Removed files look nothing up.
    """
    keys = ["change_id", "filename"]
    removed = F.col("status") == "removed"
    wanted = files.where(F.coalesce(~removed, F.lit(True))).select(*keys).distinct()
    stored = contents.where(text.is_code_file(F.col("filename"))).join(wanted, keys, "left_semi")
    decoded = stored.select(
        *keys, text.decode_utf8(F.col("data")).alias("content"), F.lit(True).alias("looked_up")
    )
    joined = files.join(decoded, keys, "left")
    return joined.withColumns({
        "content": F.when(~removed, F.col("content")),
        "decode_error": ~removed & F.col("looked_up").isNotNull() & F.col("content").isNull(),
    }).drop("looked_up")
