"""Texts made from rows: summaries, listings, headers and review prompts.

Prompts and summaries are columns; whoever sends them on reads them from the table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake import catalog
from reviewlake.operators.listings import prompt_critical, prompt_files, prompt_quality
from reviewlake.schemas import ORDER_KEY


def fill(template: str, **columns: Column) -> Column:
    """The template with its ``{name}`` places filled from columns; NULL gives an empty text."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        F.coalesce((columns.get(part, F.col(part))).cast("string"), F.lit("")) if at % 2
        else F.lit(part)
        for at, part in enumerate(parts) if part
    ]
    return F.concat(*pieces)


def summary_markdown(verdicts: DataFrame) -> DataFrame:
    """The review summary of each change as Markdown; needs the columns of ``with_verdict``."""
    counts = ("critical", "high", "medium", "low", "quality_issues", "functions", "lines_of_code")
    filled = {name: F.coalesce(name, F.lit(0)) for name in counts}
    return verdicts.select("change_id", fill(catalog.SUMMARY_TEXT, **filled).alias("summary"))


def change_header(changes: DataFrame, totals: DataFrame) -> DataFrame:
    """Title, author, number of files and changed lines of each change."""
    joined = changes.join(totals, "change_id", "left")
    numbers = [
        F.coalesce(name, F.lit(0)).alias(name)
        for name in ("files_changed", "total_additions", "total_deletions")
    ]
    rows = joined.select("change_id", "title", "author", *numbers)
    header = fill(
        "Title: {title}\nAuthor: {author}\nFiles Changed: {files_changed}\n"
        "Changes: +{total_additions} -{total_deletions}"
    )
    return rows.withColumn("header", header)


def _panel_counts(findings: DataFrame, severities: Sequence[str]) -> DataFrame:
    counts = [F.count_if(F.col("severity") == name).alias(name) for name in severities]
    return findings.groupBy("change_id").agg(F.count("*").alias("total"), *counts)


def _severity_lines(severities: Sequence[str]) -> Column:
    """One line per severity, as in ``Critical: 3``."""
    return F.concat_ws("\n", *(fill(f"{name.capitalize()}: {{{name}}}") for name in severities))


def security_panels(findings: DataFrame) -> DataFrame:
    """``title`` and ``panel`` of each change with security findings: counts by severity, then by tool.

    Tools come in the order in which they first found something. Only counts of a few tools are ever gathered.
    """
    severities = ("critical", "high", "medium", "low")
    tools = findings.groupBy("change_id", F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        F.min(F.struct(*ORDER_KEY)).alias("first"), F.count("*").alias("n")
    )
    in_order = F.array_sort(F.collect_list(F.struct("first", "tool", "n")))
    named = F.transform(in_order, lambda t: F.concat(t["tool"], F.lit(": "), t["n"].cast("string")))
    listed = tools.groupBy("change_id").agg(F.array_join(named, ", ").alias("tools"))
    rows = _panel_counts(findings, severities).join(listed, "change_id")
    panel = F.concat(_severity_lines(severities), F.lit("\n\nTools: "), "tools")
    return rows.select("change_id", fill("Security Issues ({total} total)").alias("title"), panel.alias("panel"))


def quality_panels(findings: DataFrame) -> DataFrame:
    """``title`` and ``panel`` of each change with quality findings; one without a severity counts as info."""
    severities = ("high", "medium", "low", "info")
    known = findings.withColumn("severity", F.coalesce("severity", F.lit("info")))
    rows = _panel_counts(known, severities)
    return rows.select(
        "change_id", fill("Quality Issues ({total} total)").alias("title"), _severity_lines(severities).alias("panel")
    )


def finding_text(findings: DataFrame) -> DataFrame:
    """One finding as a few lines of text; lines for absent fields are left out."""
    tool = F.coalesce(fill_if_present("[{tool}] "), F.lit(""))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("● "), tool, F.col("issue")),
        fill_if_present("  File: {filename}"),
        F.when(F.col("line") != 0, fill_if_present("  Line: {line}")),
        fill_if_present("  {description}"),
        fill_if_present("  Confidence: {confidence}"),
        fill_if_present("  → {recommendation}"),
    )
    return findings.withColumn("listing", lines)


def fill_if_present(template: str) -> Column:
    name = re.search(r"\{(\w+)\}", template).group(1)
    return F.when(F.col(name).isNotNull(), fill(template))


# --- JSON lists inside the review prompt -----------------------------------------------------------


_SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _code_unit(number: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(number), 4, "0")))


def _json_character(char: Column) -> Column:
    """As Python's ``json`` writes it: printable ASCII for itself, all else as one or two code units of UTF-16."""
    number = F.ascii(char)
    above = number - 0x10000
    pair = F.concat(
        _code_unit(F.shiftright(above, 10) + 0xD800), _code_unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    )
    escaped = F.when(number > 0xFFFF, pair).when((number < 32) | (number > 126), _code_unit(number)).otherwise(char)
    for plain, short in reversed(_SHORT_ESCAPES.items()):
        escaped = F.when(char == plain, F.lit(short)).otherwise(escaped)
    return escaped


def json_string(value: Column) -> Column:
    """A JSON string literal in ASCII. Texts with nothing to escape are taken as they are; only those with characters that have
    no short escape are written character by character."""
    text = value.cast("string")
    escaped = F.array_join(F.transform(F.split(text, ""), _json_character), "")
    short = F.replace(text, F.lit("\\"), F.lit(_SHORT_ESCAPES["\\"]))  # first, as the others bring backslashes
    for plain, written in _SHORT_ESCAPES.items():
        if plain != "\\":
            short = F.replace(short, F.lit(plain), F.lit(written))
    body = F.when(text.rlike(r"[^ -~\n\r\t\f\x08]"), escaped).when(text.rlike(r'[^ !#-\[\]-~]'), short).otherwise(text)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_object(fields: Sequence[tuple[str, Column, bool]], kept: dict[str, Column] | None = None) -> Column:
    """An indented JSON object of (name, value, is text). A NULL field is absent, or null where ``kept`` says so."""
    entries = []
    for name, value, is_text in fields:
        written = json_string(value) if is_text else value.cast("string")
        entry = F.when(value.isNotNull(), F.concat(F.lit(f'    "{name}": '), written))
        if kept and name in kept:
            entry = F.coalesce(entry, F.when(kept[name], F.lit(f'    "{name}": null')))
        entries.append(entry)
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *entries), F.lit("\n  }"))


_FINDING_FIELDS = (
    "tool", "type", "severity", "issue", "description", "filename", "line", "code", "matched",
    "confidence", "recommendation",
)
_QUALITY_FIELDS = tuple(
    name for name in _FINDING_FIELDS if name not in ("tool", "filename", "matched", "confidence")
)


def _object_of(names: Sequence[str], numbers: Sequence[str], kept: dict[str, Column] | None = None) -> Column:
    return json_object([(name, F.col(name), name not in numbers) for name in names], kept)


def critical_object() -> Column:
    """A security finding; a scanner's has its line even where its report gives none."""
    return _object_of(_FINDING_FIELDS, ("line",), {"line": F.col("tool").isin(*catalog.REPORT_TOOLS)})


def json_lists(ranked: DataFrame, entry: Column, name: str) -> DataFrame:
    """Per change, its ranked rows as one indented JSON list; the lists are a few rows long."""
    rows = ranked.select("change_id", F.struct("rank", entry.alias("entry")).alias("row"))
    listed = rows.groupBy("change_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    joined = F.array_join(F.transform("rows", lambda row: row.entry), ",\n")
    return listed.select("change_id", F.concat(F.lit("[\n"), joined, F.lit("\n]")).alias(name))


def review_prompts(
    changes: DataFrame, files: DataFrame, summary: DataFrame, security: DataFrame, quality: DataFrame
) -> DataFrame:
    """One review prompt per change of ``summary``: header, counts, and the first files and findings.

    ``security`` and ``quality`` are read three times here; pass written tables, not scans.
    """
    lists = [
        json_lists(prompt_files(files), _object_of(
            ("filename", "status", "additions", "deletions"), ("additions", "deletions")),
            "files_json"),
        json_lists(prompt_critical(security), critical_object(), "critical_json"),
        json_lists(prompt_quality(quality), _object_of(_QUALITY_FIELDS, ("line",)),
                   "quality_json"),
    ]
    header = changes.select(
        "change_id", F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
    )
    rows = summary.join(header, "change_id")
    for listed in lists:
        rows = rows.join(listed, "change_id", "left")
    prompt = fill(
        catalog.REVIEW_PROMPT,
        files_json=F.coalesce("files_json", F.lit("[]")),
        critical_json=F.coalesce("critical_json", F.lit("None")),
        quality_json=F.coalesce("quality_json", F.lit("None")),
    )
    return rows.select("change_id", prompt.alias("prompt"))


def file_prompts(files: DataFrame) -> DataFrame:
    """A prompt to review one file; ``context`` is optional."""
    context = F.col("context") if "context" in files.columns else F.lit("")
    line = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context))
    prompt = fill(catalog.FILE_PROMPT, context_line=F.coalesce(line, F.lit("")))
    return files.select("file_id", "filename", prompt.alias("prompt"))


def snippet_prompts(findings: DataFrame) -> DataFrame:
    """A prompt per finding that has code, asking how to improve it."""
    prompt = fill(catalog.SNIPPET_PROMPT, issue_type=F.col("type"))
    rows = findings.where(F.col("code").isNotNull())
    return rows.select("file_id", "issue", "line", prompt.alias("prompt"))
