"""Scanner reports: one JSON text each, about one file or a whole tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_reports(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """``filename``, ``change_id``, ``tool`` and ``report`` of every file below ``path``.

    Items say themselves which file they are about; ``filename`` is the report's own name, for those that don't. A report
    in a folder named ``change_id=12`` is about change 12; elsewhere ``change_id`` is NULL.
    """
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    change = F.regexp_extract("_metadata.file_path", r"/change_id=(\d+)/", 1)
    return texts.select(
        F.col("_metadata.file_name").alias("filename"), F.nullif(change, F.lit("")).cast("long").alias("change_id"),
        F.lit(tool).alias("tool"), F.col("value").alias("report"),
    )
