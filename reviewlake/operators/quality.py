"""Quality findings of all kinds, and metrics per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake import catalog
from reviewlake.functions import text
from reviewlake.functions.regex import java_pattern
from reviewlake.operators.findings import file_keys
from reviewlake.operators.python_structure import (
    python_counts, python_findings, python_trees,
)
from reviewlake.operators.scan import comment_ratio, reviewable, text_quality_findings


def quality_findings(files: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """Line and file checks on every file, structure checks on Python files; no duplicates removed.

    ``trees`` are the ``python_trees`` of the files, if they are there already.
    """
    structure = python_findings(python_trees(files) if trees is None else trees)
    return text_quality_findings(files).unionByName(structure)


def script_functions(content: Column) -> Column:
    """Function count of a script: three patterns, each counted on its own."""
    return reduce(Column.__add__, [
        F.regexp_count(content, F.lit(java_pattern(pattern)))
        for pattern in catalog.SCRIPT_FUNCTION_PATTERNS
    ])


def text_metrics(files: DataFrame) -> DataFrame:
    """Lines, comment ratio, and number of functions of scripts, per file. No shuffle."""
    source = reviewable(files)
    content, is_script = F.col("content"), F.col("ext").isin(*catalog.SCRIPT_EXTENSIONS)
    lines = F.length(content) - F.length(F.translate(content, "\n", "")) + 1
    measured = source.select(
        *file_keys(source), lines.alias("lines_of_code"),
        text.comment_lines(content, F.col("ext")).alias("comment_lines"),
        text.non_blank_lines(content).alias("non_blank_lines"),
        F.when(is_script, script_functions(content)).alias("functions"),
    )
    return measured.withColumn(
        "comment_ratio", comment_ratio(F.col("comment_lines"), F.col("non_blank_lines"))
    )


def file_metrics(files: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """``text_metrics`` with function and class counts of Python files that parse.

    The counts are stacked on the metrics and grouped by file, so numbers are all that is shuffled.
    """
    metrics = text_metrics(files)
    counts = python_counts(python_trees(files) if trees is None else trees)
    keys = file_keys(metrics)
    values = [name for name in metrics.columns if name not in keys] + ["classes"]
    stacked = metrics.unionByName(counts, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(name).alias(name) for name in values])
