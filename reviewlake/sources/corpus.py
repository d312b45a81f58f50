"""A corpus of files as a table laid out for scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from reviewlake.operators.scan import with_ext


def write_corpus(files: DataFrame, path: str) -> None:
    """Files with their suffix, sorted by it inside each task's output.

    Checks of one language then skip the row groups of all others. Nothing is shuffled, and tasks stay
    even however uneven the suffixes are, which folders per suffix would not give.
    """
    with_ext(files).sortWithinPartitions("ext").write.parquet(path)


def read_corpus(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``schema`` is that of the written files, with or without ``ext``."""
    full = schema if "ext" in schema.fieldNames() else StructType([*schema.fields]).add("ext", "string")
    return spark.read.schema(full).parquet(path)
