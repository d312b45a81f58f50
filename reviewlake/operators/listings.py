"""First-N listings in discovery order, and files without findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from reviewlake import catalog
from reviewlake.operators.scan import code_files
from reviewlake.schemas import ORDER_KEY


def first_rows(df: DataFrame, n: int, order: Sequence[str], by: str | None = None) -> DataFrame:
    """The first ``n`` rows, of everything or per ``by``, with their ``rank``.

    Both forms keep n rows per partition before anything moves, so a change with a third of all
    findings sends no more than any other.
    """
    if by is None:
        top = df.orderBy(*order).limit(n)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    window = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def first_findings(
    findings: DataFrame, severities: Sequence[str], n: int, by: str | None = None
) -> DataFrame:
    return first_rows(findings.where(F.col("severity").isin(*severities)), n, ORDER_KEY, by)


def first_security(findings: DataFrame, by: str | None = None) -> DataFrame:
    return first_findings(findings, ("critical", "high"), catalog.LISTED_FINDINGS, by)


def first_quality(findings: DataFrame, by: str | None = None) -> DataFrame:
    return first_findings(findings, ("high", "medium"), catalog.LISTED_FINDINGS, by)


def prompt_critical(findings: DataFrame) -> DataFrame:
    return first_findings(findings, ("critical",), catalog.PROMPT_FINDINGS, "change_id")


def prompt_quality(findings: DataFrame) -> DataFrame:
    return first_findings(findings, ("high", "medium"), catalog.PROMPT_FINDINGS, "change_id")


def prompt_files(files: DataFrame) -> DataFrame:
    """The first code files of each change, without their texts."""
    listed = code_files(files).select(
        "change_id", "file_ord", "filename", "status",
        F.coalesce("additions", F.lit(0)).alias("additions"),
        F.coalesce("deletions", F.lit(0)).alias("deletions"),
    )
    return first_rows(listed, catalog.PROMPT_FILES, ["file_ord"], "change_id")


def clean_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with nothing found. Findings are reduced to their distinct files before the join."""
    return files.join(findings.select("file_id").distinct(), "file_id", "left_anti")
