"""Review output: one row per change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def review_texts(summaries: DataFrame, reviews: DataFrame) -> DataFrame:
    """Summary, blank line, review. ``reviews`` has ``change_id`` and ``review``, written elsewhere.

    A change without a review keeps its summary alone.
    """
    joined = summaries.join(reviews, "change_id", "left")
    return joined.select("change_id", F.concat_ws("\n\n", "summary", "review").alias("text"))


def write_reviews(texts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet or JSON with all columns, in as many files as tasks; or plain text with one folder per change, for few changes."""
    if fmt == "text":
        texts.select("change_id", "text").write.partitionBy("change_id").text(path)
    else:
        texts.write.format(fmt).save(path)
