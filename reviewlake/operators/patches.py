"""Unified diffs as tables: one row per hunk, or one row per line of a hunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.functions import text
from reviewlake.operators.findings import file_keys


def _kind(line: Column) -> Column:
    """``+++`` and ``---`` lines are context, like every line that is neither added nor removed."""
    return (
        F.when(line.startswith("+") & ~line.startswith("+++"), "added")
        .when(line.startswith("-") & ~line.startswith("---"), "removed")
        .otherwise("context")
    )


def _text(line: Column) -> Column:
    return F.when(_kind(line) == "context", line).otherwise(F.substr(line, F.lit(2)))


def _pieces(files: DataFrame) -> DataFrame:
    """Hunks with the lines of their body. A patch is cut in place, with no window over its lines."""
    keys = file_keys(files)
    cut = files.where(text.has_content(F.col("patch"))).select(
        *keys, F.split("patch", r"\n(?=@@)").alias("pieces")
    )
    # Text before the first header is a piece too, but not a hunk.
    lead = F.when(F.get("pieces", 0).startswith("@@"), 0).otherwise(1)
    pieces = cut.select(
        *keys, lead.alias("lead"), F.posexplode_outer("pieces").alias("at", "piece")
    ).where(F.col("piece").startswith("@@"))
    lines = pieces.select(
        *keys, (F.col("at") - F.col("lead")).alias("hunk"),
        text.split_lines(F.col("piece")).alias("lines"),
    )
    return lines.select(
        *keys, "hunk", F.get("lines", 0).alias("header"),
        F.slice("lines", 2, F.size("lines")).alias("body"),
    )


def hunks(files: DataFrame) -> DataFrame:
    """``header``, ``added``, ``removed`` and ``context`` lines per hunk; no rows for empty patches."""

    def lines_of(kind):
        return F.transform(F.filter("body", lambda line: _kind(line) == kind), _text)

    return _pieces(files).select(
        *file_keys(files), "hunk", "header",
        *[lines_of(kind).alias(kind) for kind in ("added", "removed", "context")],
    )


def patch_lines(files: DataFrame) -> DataFrame:
    """One row per body line with its ``kind`` and its text without the leading sign."""
    keys = file_keys(files)
    exploded = _pieces(files).select(*keys, "hunk", F.posexplode_outer("body").alias("pos", "line"))
    return exploded.where(F.col("line").isNotNull()).select(
        *keys, "hunk", "pos", _kind(F.col("line")).alias("kind"), _text(F.col("line")).alias("text")
    )
