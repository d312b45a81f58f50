"""Scanner reports to findings: parse, map severities, fill defaults, join to the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake import catalog
from reviewlake.functions import text
from reviewlake.operators.findings import file_keys, finding
from reviewlake.operators.scan import code_files
from reviewlake.schemas import BANDIT_REPORT, FINDING, SEMGREP_REPORT

REPORT_PHASES = {"bandit": 2, "semgrep": 3}


def bandit_severity(severity: Column) -> Column:
    upper = F.upper(F.coalesce(severity, F.lit(catalog.BANDIT_DEFAULTS["severity"])))
    return F.when(upper.isin("HIGH", "MEDIUM", "LOW"), F.lower(upper)).otherwise("medium")


def semgrep_severity(severity: Column) -> Column:
    lower = F.lower(F.coalesce(severity, F.lit(catalog.SEMGREP_DEFAULTS["severity"])))
    return (
        F.when(lower == "error", "high").when(lower == "warning", "medium")
        .when(lower == "info", "low").otherwise(lower)
    )


def _not_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def bandit_recommendation(item: Column) -> Column:
    known = F.create_map(*[
        F.lit(text_) for pair in catalog.BANDIT_RECOMMENDATIONS.items() for text_ in pair
    ])
    return F.coalesce(
        F.concat(F.lit(catalog.REFERENCE_TEXT), _not_empty(item.more_info)),
        F.try_element_at(known, item.test_id),
        F.lit(catalog.BANDIT_RECOMMENDATION),
    )


def _first_of(value: Column) -> Column:
    """First element of a list kept as JSON text; a plain string counts as a list of one."""
    return F.when(
        value.startswith("["), F.get(F.from_json(value, "array<string>"), 0)
    ).otherwise(_not_empty(value))


def semgrep_recommendation(metadata: Column) -> Column:
    classes = F.concat_ws(
        "; ",
        F.concat(F.lit(catalog.CWE_TEXT), _first_of(metadata.cwe)),
        F.concat(F.lit(catalog.OWASP_TEXT), _first_of(metadata.owasp)),
    )
    return F.coalesce(
        F.concat(F.lit(catalog.REFERENCE_TEXT), F.get(metadata.references, 0)),
        _not_empty(classes),
        F.lit(catalog.SEMGREP_RECOMMENDATION),
    )


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def _bandit_finding(item: Column, at: Column) -> Column:
    defaults = catalog.BANDIT_DEFAULTS
    return finding(
        type="security", tool="bandit", severity=bandit_severity(item.issue_severity),
        issue=_or(item.test_id, defaults["issue"]),
        description=_or(item.issue_text, defaults["description"]),
        line=item.line_number, code=text.strip(_or(item.code, "")),
        confidence=_or(item.issue_confidence, defaults["confidence"]),
        recommendation=bandit_recommendation(item),
        phase=REPORT_PHASES["bandit"], rule_ord=0, pos=at, match_ord=0,
    )


def _semgrep_finding(item: Column, at: Column) -> Column:
    defaults = catalog.SEMGREP_DEFAULTS
    return finding(
        type="security", tool="semgrep", severity=semgrep_severity(item.extra.severity),
        issue=_or(item.check_id, defaults["issue"]),
        description=_or(item.extra.message, defaults["description"]),
        line=item.start.line, code=text.strip(_or(item.extra.lines, "")),
        recommendation=semgrep_recommendation(item.extra.metadata),
        phase=REPORT_PHASES["semgrep"], rule_ord=0, pos=at, match_ord=0,
    )


_READERS = {
    "bandit": (BANDIT_REPORT, _bandit_finding),
    "semgrep": (SEMGREP_REPORT, _semgrep_finding),
}


#: Where an item of a report names the file that it is about.
_NAMES = {"bandit": "filename", "semgrep": "path"}


def relative_to(name: Column, root: str | None) -> Column:
    """A scanned file's name as from ``root`` on, which scanners may have been given in several spellings."""
    name = F.regexp_replace(name, r"\A(?:\./)+", "")
    if root is None:
        return name
    plain = root.removeprefix("./").rstrip("/") + "/"
    return F.when(name.startswith(plain), F.substring(name, F.lit(len(plain) + 1), F.length(name))).otherwise(name)


def tool_findings(
    reports: DataFrame, files: DataFrame, tools: Sequence[str] = catalog.REPORT_TOOLS, root: str | None = None
) -> DataFrame:
    """Findings of the scanners. A report that is not JSON, or has no results, gives none.

    All tools are read in one pass and joined once. Reports are parsed and taken apart before the
    join; the files side brings the names of code files and no text, as a report is there only for a
    file that had one. Bandit reports count for Python files alone, as only those are given to it.

    A report with a ``file_id`` is about that file. Without one, as read from disk, it may be about a whole tree:
    each of its items belongs to the file that the item names (relative to ``root``, if given), an item that names none to the
    report's ``filename``. Where files are of changes, such reports must tell their ``change_id``, since a name may be in
    several of them.
    """
    by_name = "file_id" not in reports.columns
    keys = ["file_id"] if not by_name else ["change_id", "filename"] if "change_id" in files.columns else ["filename"]
    if by_name and "change_id" in keys and "change_id" not in reports.columns:
        raise ValueError("reports on files of changes need a file_id or a change_id")
    about = [name for name in keys if name in reports.columns]
    items = reports.where(F.col("tool").isin(*tools)).select(*about, "tool", *[
        F.when(F.col("tool") == tool, F.from_json("report", _READERS[tool][0])["results"]).alias(tool)
        for tool in tools
    ])
    # Both arrays are zipped so that one explode serves all tools; only one of them is ever filled.
    zipped = F.arrays_zip(*[F.coalesce(tool, F.array()).alias(tool) for tool in tools])
    exploded = items.select(*about, "tool", F.posexplode_outer(zipped).alias("idx", "item"))
    exploded = exploded.where(F.col("item").isNotNull())
    if by_name:
        own = F.coalesce(*(F.col("item")[tool][_NAMES[tool]] for tool in tools))
        name = F.coalesce(relative_to(own, root), F.col("filename") if "filename" in about else F.lit(None).cast("string"))
        exploded = exploded.withColumn("filename", name)
    scanned = code_files(files)
    joined = exploded.join(scanned.select(*file_keys(scanned)), keys).where(
        (F.col("tool") != "bandit") | F.col("ext").isin(*catalog.PYTHON_EXTENSIONS)
    )
    found = F.lit(None).cast(FINDING)
    for tool in tools:
        built = _READERS[tool][1](F.col("item")[tool], F.col("idx"))
        found = F.when(F.col("tool") == tool, built).otherwise(found)
    return joined.select(*file_keys(scanned), found.alias("finding")).select(
        *file_keys(scanned), "finding.*"
    )
