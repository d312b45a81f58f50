"""The three review flows, from sources to listings and verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from reviewlake.catalog import RULES, Rule
from reviewlake.operators import listings, render, summaries, verdict
from reviewlake.operators.python_structure import python_findings, python_trees
from reviewlake.operators.reports import tool_findings
from reviewlake.operators.scan import scan, with_ext
from reviewlake.session import materialize
from reviewlake.sources.changes import changed_code_files, with_head_content


def all_findings(
    files: DataFrame, reports: DataFrame | None = None, rules: Sequence[Rule] = RULES,
    wildcard: str = "documented",
) -> DataFrame:
    """Findings of every kind.

    Security and quality come from the same pass over the texts; only Python files are read again,
    by the structure checks.
    """
    found = scan(files, rules, wildcard=wildcard).unionByName(python_findings(python_trees(files)))
    return found if reports is None else found.unionByName(tool_findings(reports, files))


@dataclass(frozen=True)
class Findings:
    """Findings of a set of files, computed once and written for the steps that follow."""

    written: DataFrame

    @property
    def security(self) -> DataFrame:
        return self.written.where(F.col("type") == "security")

    @property
    def quality(self) -> DataFrame:
        return self.written.where(F.col("type") == "quality")


def find(files: DataFrame, reports: DataFrame | None = None, **options) -> Findings:
    return Findings(materialize(all_findings(files, reports, **options), "findings"))


@dataclass(frozen=True)
class FileReview:
    findings: Findings
    security_summary: DataFrame
    findings_by_tool: DataFrame
    severity_histogram: DataFrame
    first_security: DataFrame
    first_quality: DataFrame


def review_files(files: DataFrame, reports: DataFrame | None = None, **options) -> FileReview:
    """Review of a list of files, or of local changes: one scope, no verdict."""
    found = find(files, reports, **options)
    return FileReview(
        findings=found,
        security_summary=summaries.security_summary(found.security),
        findings_by_tool=summaries.findings_by_tool(found.security),
        severity_histogram=summaries.severity_histogram(found.quality),
        first_security=render.finding_text(listings.first_security(found.security)),
        first_quality=render.finding_text(listings.first_quality(found.quality)),
    )


@dataclass(frozen=True)
class ChangeReview:
    findings: Findings
    headers: DataFrame
    verdicts: DataFrame
    summaries: DataFrame
    prompts: DataFrame
    severity_histogram: DataFrame
    findings_by_tool: DataFrame
    first_security: DataFrame
    first_quality: DataFrame
    security_panels: DataFrame
    quality_panels: DataFrame


def review_changes(
    changes: DataFrame, files: DataFrame, reports: DataFrame | None = None,
    prompts_enabled: bool = True, contents: DataFrame | None = None, **options,
) -> ChangeReview:
    """Review of many change requests at once, each with its own listing, verdict and prompt.

    ``files`` are a table with the texts, or, with ``contents``, changed files whose texts at the head revision are
    there: these are joined once and written, and all steps read that table.
    """
    if contents is not None:
        joined = with_head_content(changed_code_files(files), contents)
        files = materialize(with_ext(joined).sortWithinPartitions("ext"), "changed-files")
    found = find(files, reports, **options)
    counters = summaries.change_summary(files, found.written)
    verdicts = verdict.with_verdict(counters)
    gated = verdict.needs_review(counters, prompts_enabled)
    return ChangeReview(
        findings=found,
        headers=render.change_header(changes, summaries.change_totals(files)),
        verdicts=verdicts,
        summaries=render.summary_markdown(verdicts),
        prompts=render.review_prompts(changes, files, gated, found.security, found.quality),
        severity_histogram=summaries.severity_histogram(found.quality, by=["change_id"]),
        findings_by_tool=summaries.findings_by_tool(found.security, by=["change_id"]),
        first_security=listings.first_security(found.security, "change_id"),
        first_quality=listings.first_quality(found.quality, "change_id"),
        security_panels=render.security_panels(found.security),
        quality_panels=render.quality_panels(found.quality),
    )
