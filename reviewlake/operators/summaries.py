"""Counts over findings and files. All are partial + final aggregates over small rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake import catalog
from reviewlake.operators.scan import code_files
from reviewlake.schemas import ORDER_KEY

SECURITY_SEVERITIES = catalog.SEVERITIES[:4]


def _severity(default: str) -> Column:
    return F.coalesce(F.col("severity"), F.lit(default))


def _severity_counts(severities: Sequence[str], default: str) -> list[Column]:
    return [F.count_if(_severity(default) == name).alias(name) for name in severities]


def security_summary(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, four severities and ``has_critical``; over everything or per ``by``."""
    counts = findings.groupBy(*by).agg(
        F.count("*").alias("total_issues"), *_severity_counts(SECURITY_SEVERITIES, "low")
    )
    return counts.withColumn("has_critical", F.col("critical") > 0)


def security_summary_rollup(findings: DataFrame) -> DataFrame:
    """The security summary of the corpus, of each change and of each file, in one aggregation.

    Findings are counted per file first, so the three scopes are built from one row per file.
    """
    per_file = findings.groupBy("change_id", "file_id").agg(
        F.count("*").alias("total_issues"), *_severity_counts(SECURITY_SEVERITIES, "low")
    )
    sums = [F.sum(name).alias(name) for name in ("total_issues", *SECURITY_SEVERITIES)]
    level = F.grouping_id().alias("level")
    scopes = per_file.rollup("change_id", "file_id").agg(level, *sums)
    scope = F.when(F.col("level") == 3, "corpus").when(F.col("level") == 1, "change").otherwise("file")
    return scopes.select(
        scope.alias("scope"), "change_id", "file_id", "total_issues", *SECURITY_SEVERITIES,
        (F.col("critical") > 0).alias("has_critical"),
    )


def severity_histogram(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of quality findings per severity; a missing one counts as info. Over everything or per ``by``."""
    return findings.groupBy(*by, _severity("info").alias("severity")).agg(F.count("*").alias("findings"))


def order_key(columns: Sequence[str] = ORDER_KEY) -> Column:
    return F.struct(*columns)


def findings_by_tool(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of findings per tool, in the order the tools are first seen.

    Per ``by``, rows are in no order and ``first_seen`` tells the order within a group.
    """
    tools = findings.groupBy(*by, F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        F.count("*").alias("findings"), F.min(order_key()).alias("first_seen")
    )
    return tools if by else tools.orderBy("first_seen").select("tool", "findings")


def tool_summary(
    findings: DataFrame, tools: Sequence[str] = catalog.REPORT_TOOLS, by: Sequence[str] = ()
) -> DataFrame:
    """Scanner totals; ``by_tool`` has every tool of the list, with 0 if it found nothing."""
    ours = findings.where(F.col("tool").isin(*tools))
    counts = ours.groupBy(*by).agg(
        F.count("*").alias("total_issues"),
        F.create_map(*[
            part for tool in tools for part in (F.lit(tool), F.count_if(F.col("tool") == tool))
        ]).alias("by_tool"),
        *_severity_counts(SECURITY_SEVERITIES, "low"),
    )
    return counts.withColumn("has_critical", F.col("critical") > 0).withColumn(
        "has_high", F.col("high") > 0
    )


def quality_summary(metrics: DataFrame, counts: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file: number of findings, lines, functions, classes and findings per severity.

    Text metrics, Python counts and findings are stacked and grouped once: one shuffle and no join.
    """
    sizes = ("lines_of_code", "functions", "classes")

    def rows(df, severity, is_finding):
        return df.select(
            "file_id",
            *[F.coalesce(name, F.lit(0)).alias(name) if name in df.columns else F.lit(0).alias(name)
              for name in sizes],
            severity.alias("severity"), F.lit(is_finding).alias("is_finding"),
        )

    none = F.lit(None).cast("string")
    stacked = rows(metrics, none, 0).unionByName(rows(counts, none, 0)).unionByName(
        rows(findings, _severity("info"), 1)
    )
    return stacked.groupBy("file_id").agg(
        F.sum("is_finding").alias("total_issues"),
        *[F.sum(name).alias(name) for name in sizes],
        *[F.count_if(F.col("severity") == name).alias(name) for name in catalog.SEVERITIES],
    )


def change_totals(files: DataFrame) -> DataFrame:
    """Added and removed lines and number of files per change, over its code files only."""
    return code_files(files).groupBy("change_id").agg(
        F.sum(F.coalesce("additions", F.lit(0))).alias("total_additions"),
        F.sum(F.coalesce("deletions", F.lit(0))).alias("total_deletions"),
        F.count("*").alias("files_changed"),
    )


CHANGE_COUNTERS = (
    "files_changed", "total_additions", "total_deletions",
    "security_issues", *SECURITY_SEVERITIES,
    "quality_issues", "functions", "quality_medium_high",
)


def _counted(df: DataFrame, **counters: Column) -> DataFrame:
    """``change_id`` and one number per counter; counters that are not given are 0."""
    return df.select("change_id", *[
        counters.get(name, F.lit(0)).cast("long").alias(name) for name in CHANGE_COUNTERS
    ])


def change_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Everything counted about a change, one row per change with code files.

    Files and findings of both types are stacked as rows of counters and summed by change: the
    findings are read once, one shuffle moves pre-aggregated rows, and changes without findings get
    zeros. ``functions`` counts the quality findings that are about functions, and ``lines_of_code``
    is the number of added lines.
    """
    security, quality = F.col("type") == "security", F.col("type") == "quality"

    def number(condition):
        return F.when(condition, 1).otherwise(0)

    stacked = _counted(
        code_files(files), files_changed=F.lit(1),
        total_additions=F.coalesce("additions", F.lit(0)),
        total_deletions=F.coalesce("deletions", F.lit(0)),
    ).unionByName(_counted(
        findings, security_issues=number(security), quality_issues=number(quality),
        **{name: number(security & (_severity("low") == name)) for name in SECURITY_SEVERITIES},
        functions=number(quality & F.contains("issue", F.lit("function"))),
        quality_medium_high=number(quality & F.col("severity").isin("high", "medium")),
    ))
    sums = stacked.groupBy("change_id").agg(*[F.sum(name).alias(name) for name in CHANGE_COUNTERS])
    return sums.withColumn("lines_of_code", F.col("total_additions"))
