"""Security and quality detectors over source files, in one pass.

Every detector is a column expression, so a scan is: read files -> split into lines -> build the
array of hits of each line -> explode. There is no shuffle, the text is split once however many
rules there are, and neither texts nor lines outlive the pass: only findings leave it.

A hit is small: the number of its check, the matched text, and a description where that depends on
the line. What is fixed about a check (severity, texts, place in the order) is filled in after the
explode from one constant array.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake import catalog
from reviewlake.catalog import RULES, Rule
from reviewlake.functions import text
from reviewlake.functions.regex import java_pattern
from reviewlake.operators.findings import file_keys

PATTERN_PHASE, FILE_PHASE = 0, 1  # security
LANGUAGE_PHASE, GENERAL_PHASE = 0, 1  # quality


def with_ext(files: DataFrame) -> DataFrame:
    return files if "ext" in files.columns else files.withColumn("ext", text.file_ext(F.col("filename")))


def code_files(files: DataFrame) -> DataFrame:
    """The test on ``ext`` reaches the storage where that is a column of the table."""
    return with_ext(files).where(
        F.col("ext").isin(*catalog.CODE_EXTENSIONS) & ~text.is_skipped_path(F.col("filename"))
    )


def reviewable(files: DataFrame) -> DataFrame:
    """Code files that have content; the columns the detectors need and no others."""
    files = code_files(files).where(text.has_content(F.col("content")))
    return files.select(*file_keys(files), "content")


def select_rules(rules: Sequence[Rule] = RULES, wildcard: str = "documented") -> tuple[Rule, ...]:
    """``wildcard='as_coded'`` leaves out the rules for all files, which never fire as coded."""
    if wildcard == "documented":
        return tuple(rules)
    if wildcard == "as_coded":
        return tuple(rule for rule in rules if rule.extensions is not None)
    raise ValueError(f"wildcard must be 'documented' or 'as_coded', not {wildcard!r}")


@dataclass(frozen=True)
class Detector:
    """A check within a scan. ``hits`` is SQL for the array of its hits on a line, ``found`` SQL for
    whether there are any; both read the columns in ``facts``.
    """

    check: Rule | catalog.Check
    type: str
    phase: int
    rule_ord: int
    found: str
    hits: str
    facts: dict[str, Column]
    by_line: bool = True
    code: str | None = None  # 'stripped' or 'plain' line, or no code

    def constants(self) -> dict:
        return {
            "type": self.type, "tool": catalog.PATTERN_TOOL if self.type == "security" else None,
            "severity": self.check.severity, "issue": self.check.name,
            "description": self.check.description, "recommendation": self.check.recommendation,
            "phase": self.phase, "rule_ord": self.rule_ord, "by_line": self.by_line,
            "code": self.code,
        }


_CONSTANTS = (
    "array<struct<type string, tool string, severity string, issue string, description string, "
    "recommendation string, phase int, rule_ord int, by_line boolean, code string>>"
)


def _hit(matched: str = "null", description: str = "null", match_ord: str = "0") -> str:
    """SQL for one hit; ``{check}`` is replaced by the number of its detector."""
    return (
        f"named_struct('check', {{check}}, 'matched', cast({matched} as string), "
        f"'description', cast({description} as string), 'match_ord', {match_ord})"
    )


def _single(found: str, description: str = "null") -> dict[str, str]:
    return {"found": found, "hits": f"if({found}, array({_hit(description=description)}), array())"}


def _repeated(count: str) -> dict[str, str]:
    """``count`` equal hits, for checks that report no text."""
    at = _hit(match_ord="at")
    return {
        "found": f"{count} > 0",
        "hits": f"if({count} > 0, transform(sequence(0, {count} - 1), at -> {at}), array())",
    }


def _is_script() -> Column:
    return F.col("ext").isin(*catalog.SCRIPT_EXTENSIONS)


def _contains_any(column: str, parts: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(column, F.lit(part)) for part in parts])


# --- line level ----------------------------------------------------------------------------------


def _matches(rule: Rule) -> Column:
    """All matches of a rule on the line; NULL where it does not apply."""
    pattern = java_pattern(rule.pattern, ignore_case=True, multiline=rule.multiline)
    matches = F.regexp_extract_all("line_text", F.lit(pattern), F.lit(0))
    conditions = []
    if rule.extensions is not None:
        conditions.append(F.col("ext").isin(*rule.extensions))
    if rule.literals:
        # Exact for ASCII lines; any other line goes to the pattern, whose case folding is wider.
        conditions.append(_contains_any("lower_text", rule.literals) | ~F.col("is_ascii"))
    return F.when(reduce(Column.__and__, conditions), matches) if conditions else matches


def _rule_detector(rule: Rule, rule_ord: int) -> Detector:
    name = f"rule_{rule_ord}"
    hit = _hit(matched="matched", match_ord="at")
    return Detector(
        rule, "security", PATTERN_PHASE, rule_ord,
        found=f"size({name}) > 0", hits=f"transform({name}, (matched, at) -> {hit})",
        facts={name: _matches(rule)}, code="plain" if rule.multiline else "stripped",
    )


def _first_number() -> Column:
    """First number on the line that is not one of the allowed ones; NULL on ``#`` lines."""
    def numbers(pattern: str) -> Column:
        return F.regexp_extract_all("line_text", F.lit(pattern), F.lit(1))

    # The classes of Unicode are slow; on ASCII lines those of ASCII find the same.
    in_ascii = r"(?=[0-9])(?<![0-9A-Za-z_])([0-9]+\.?[0-9]*)(?:(?<=[0-9])(?![0-9A-Za-z_])|(?<=\.)(?=[0-9A-Za-z_]))"
    literals = F.when(F.col("is_ascii"), numbers(in_ascii)).otherwise(numbers(java_pattern(catalog.NUMBER_PATTERN)))
    first = F.get(F.filter(literals, lambda number: ~number.isin(*catalog.ALLOWED_NUMBERS)), 0)
    hash_line = F.col("line_text").rlike(r"(?U)\A[\s\x1c-\x1f]*+#")
    has_digit = F.when(F.col("is_ascii"), F.col("line_text").rlike("[0-9]")).otherwise(F.col("line_text").rlike(r"\p{Nd}"))
    return F.when(has_digit & ~hash_line, first)


def _quality_detectors() -> list[Detector]:
    line = F.col("line_text")

    def count(pattern_column: str, pattern: str) -> Column:
        return F.regexp_count(pattern_column, F.lit(pattern))

    def detector(check, phase, rule_ord, shape, facts, **options):
        return Detector(check, "quality", phase, rule_ord, **shape, facts=facts, **options)

    consoles = F.when(
        _is_script() & F.contains("line_text", F.lit("console.")),
        count("line_text", java_pattern(catalog.CONSOLE_PATTERN)),
    )
    todo = F.contains("line_text", F.lit(":")) & (
        _contains_any("lower_text", catalog.TODO_LITERALS) | ~F.col("is_ascii")
    ) & line.rlike(java_pattern(catalog.TODO_PATTERN, ignore_case=True))
    length_text = "format_string('{}', line_no, line_length)".format(
        catalog.LONG_LINE.description.replace("{}", "%d"))
    number_text = "format_string('{}', number)".format(
        catalog.MAGIC_NUMBER.description.replace("{}", "%s"))
    return [
        detector(catalog.CONSOLE_LOG, LANGUAGE_PHASE, 0, _repeated("consoles"),
                 {"consoles": consoles}),
        detector(catalog.VAR_USAGE, LANGUAGE_PHASE, 1, _repeated("vars"),
                 {"vars": count("marked", "\x01")}),
        detector(catalog.LOOSE_EQUALITY, LANGUAGE_PHASE, 2, _repeated("equalities"),
                 {"equalities": count("marked", "\x02")}),
        detector(catalog.LONG_LINE, GENERAL_PHASE, 0,
                 _single(f"line_length > {catalog.MAX_LINE_LENGTH}", length_text),
                 {"line_length": F.length(line)}),
        detector(catalog.TODO_COMMENT, GENERAL_PHASE, 1, _single("todo"), {"todo": todo},
                 code="stripped"),
        detector(catalog.MAGIC_NUMBER, GENERAL_PHASE, 3,
                 _single("number is not null", number_text), {"number": _first_number()}),
    ]


def _marked_lines(content: Column) -> Column:
    """Lines of the text with a mark put before every match of the two checks that look across lines.

    The mark lands on the line where the match starts. Control characters already there are replaced
    first by another one that the patterns treat alike. Marks of the first pattern cannot change what
    the second one finds: they sit between a non-word character and a ``v``, where it has no match.
    """
    marked = F.translate(content, "\x01\x02", "\x03\x03")
    marked = F.regexp_replace(marked, java_pattern(catalog.VAR_PATTERN), "\x01$0")
    marked = F.regexp_replace(marked, java_pattern(catalog.LOOSE_EQUALITY_PATTERN), "\x02$0")
    return text.split_lines(marked)


# --- file level ----------------------------------------------------------------------------------


def _needles() -> dict[str, Column]:
    """What the whole-file security checks look for in a text."""
    content = F.col("content")
    return {
        "pickle": F.contains(content, F.lit("pickle")), "safe": F.contains(F.lower(content), F.lit("safe")),
        "flask": F.contains(content, F.lit("Flask")), "ssl": F.contains(content, F.lit("ssl_context")),
        "eval": content.rlike(java_pattern(catalog.EVAL_PATTERN)),
        "inner_html": content.rlike(java_pattern(catalog.INNER_HTML_PATTERN)),
        "select_star": content.rlike(java_pattern(catalog.SELECT_STAR_PATTERN, ignore_case=True)),
    }


def _file_checks(needles: dict[str, Column]) -> list[tuple[catalog.Check, int, Column]]:
    """Whole-file security checks: what, its place in the order, and the condition."""
    python, has = F.col("ext").isin(*catalog.PYTHON_EXTENSIONS), needles
    return [
        (catalog.UNSAFE_PICKLE, 0, python & has["pickle"] & ~has["safe"]),
        (catalog.MISSING_HTTPS, 1, python & has["flask"] & ~has["ssl"]),
        (catalog.EVAL_USAGE, 0, _is_script() & has["eval"]),
        (catalog.INNER_HTML, 1, _is_script() & has["inner_html"]),
        (catalog.SELECT_STAR, 0, F.col("ext").isin(*catalog.SQL_EXTENSIONS) & has["select_star"]),
    ]


def _file_flags(needles: dict[str, Column]) -> Column:
    """The whole-file checks as one bit mask, so that lines carry an integer and not the text."""
    bits = [F.when(hit, 1 << at).otherwise(0) for at, (_, _, hit) in enumerate(_file_checks(needles))]
    return reduce(Column.__add__, bits)


def _file_detectors() -> list[Detector]:
    """Whole-file findings are built on the first line, which every file has."""
    return [
        Detector(check, "security", FILE_PHASE, rule_ord,
                 **_single(f"pos = 0 and getbit(flags, {at}) = 1"), facts={}, by_line=False)
        for at, (check, rule_ord, _) in enumerate(_file_checks(_needles()))
    ]


def comment_ratio(comments: Column, non_blank: Column) -> Column:
    return F.when(non_blank > 0, comments / non_blank).otherwise(F.lit(0.0))


def _file_quality_detectors() -> list[Detector]:
    ratio = comment_ratio(F.col("comment_lines"), F.col("non_blank_lines"))
    before, after = catalog.COMMENT_RATIO.description.split("{}")
    high = F.when(
        (F.col("pos") == 0) & (ratio > catalog.MAX_COMMENT_RATIO),
        F.concat(F.lit(before), text.percent(ratio), F.lit(after)),
    )
    lines_text = "format_string('{}', lines_of_code)".format(
        catalog.LONG_FILE.description.replace("{}", "%d"))
    return [
        Detector(catalog.COMMENT_RATIO, "quality", GENERAL_PHASE, 2,
                 **_single("ratio_text is not null", "ratio_text"), facts={"ratio_text": high},
                 by_line=False),
        Detector(catalog.LONG_FILE, "quality", GENERAL_PHASE, 4,
                 **_single(f"pos = 0 and lines_of_code > {catalog.MAX_FILE_LINES}", lines_text),
                 facts={}, by_line=False),
    ]


# --- scans ---------------------------------------------------------------------------------------


def scan(
    files: DataFrame,
    rules: Sequence[Rule] = RULES,
    security: bool = True,
    quality: bool = True,
    wildcard: str = "documented",
    whole_file: bool = True,
    checks: Collection[str] | None = None,
) -> DataFrame:
    """Findings of all text detectors (everything but Python structure and scanner reports).

    ``files`` needs ``filename`` and ``content``; ``change_id``, ``file_ord`` and ``file_id`` go
    through if they are there. ``checks`` names the only checks to run, besides the rules given: what the others need
    is not worked out.
    """
    rules = select_rules(rules, wildcard) if security else ()
    source = reviewable(files)
    own = (_file_detectors() if security and whole_file else []) + (
        _quality_detectors() + _file_quality_detectors() if quality else [])
    detectors = [
        _rule_detector(rule, at) for at, rule in enumerate(rules)
        if not rule.multiline or rule.within_line
    ] + [detector for detector in own if checks is None or detector.check.name in checks]
    running = {detector.check.name for detector in detectors}
    carried, parts = [], [text.split_lines(F.col("content")).alias("line_text")]
    if running & {check.name for check, _, _ in _file_checks(_needles())}:
        carried.append(_file_flags(_needles()).alias("flags"))
    if running & {catalog.VAR_USAGE.name, catalog.LOOSE_EQUALITY.name}:
        marked = F.when(_is_script(), _marked_lines(F.col("content")))
        parts.append(F.coalesce(marked, F.array().cast("array<string>")).alias("marked"))
    if catalog.COMMENT_RATIO.name in running:
        carried += [
            text.comment_lines(F.col("content"), F.col("ext")).alias("comment_lines"),
            text.non_blank_lines(F.col("content")).alias("non_blank_lines"),
        ]

    by_file = source.select(*file_keys(source), *carried, F.arrays_zip(*parts).alias("lines"))
    found = [_line_scan(by_file, detectors)] if detectors else []
    found += [
        _whole_text_scan(source, rule, at) for at, rule in enumerate(rules)
        if rule.multiline and not rule.within_line
    ]
    if not found:
        raise ValueError("nothing to scan for: no rules and no checks are selected")
    return reduce(DataFrame.unionByName, found)


def _line_scan(by_file: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    keys = file_keys(by_file)
    # The line count is taken here, so that the array itself stops at the explode.
    counted = by_file.withColumn("lines_of_code", F.size("lines"))
    kept = [name for name in counted.columns if name != "lines"]
    by_line = counted.select(*kept, F.posexplode_outer("lines").alias("pos", "entry"))
    first_line = "first_line" if "first_line" in kept else "1"
    by_line = by_line.selectExpr(
        *kept, "pos", f"pos + {first_line} as line_no", "entry.*", "lower(entry.line_text) as lower_text",
        "octet_length(entry.line_text) = length(entry.line_text) as is_ascii",
    )
    return _detect(by_line, keys, detectors)


def _detect(by_line: DataFrame, keys: Sequence[str], detectors: Sequence[Detector]) -> DataFrame:
    # Each detector runs once, as a column; a line without a hit goes no further than that.
    facts = {name: fact for detector in detectors for name, fact in detector.facts.items()}
    known = by_line.select("*", *[fact.alias(name) for name, fact in facts.items()])
    any_found = " or ".join(f"coalesce({detector.found}, false)" for detector in detectors)
    hits = ", ".join(
        f"coalesce({detector.hits.replace('{check}', str(at))}, array())"
        for at, detector in enumerate(detectors)
    )
    hit_lines = known.selectExpr(*keys, "line_no", "line_text", f"if({any_found}, concat({hits}), null) as hits")
    return _to_findings(hit_lines, detectors)


def scan_parts(
    parts: DataFrame,
    rules: Sequence[Rule] = RULES,
    security: bool = True,
    quality: bool = True,
    wildcard: str = "documented",
) -> DataFrame:
    """``scan`` of files that are too long for one value, given in parts (see ``sources.long_files``).

    Lines count from ``first_line``, the number of a part's first one. Whole-file checks look at what the parts of a
    file hold together; flags and counts are all that is grouped. Rules that may match over several lines need the
    whole text and are refused.
    """
    rules = select_rules(rules, wildcard) if security else ()
    across = [rule.name for rule in rules if rule.multiline and not rule.within_line]
    if across:
        raise ValueError(f"rules over several lines need whole texts: {', '.join(across)}")
    source = code_files(parts).where(F.col("content").isNotNull())
    keys = file_keys(source)
    lines = [text.split_lines(F.col("content")).alias("line_text")]
    detectors = [_rule_detector(rule, at) for at, rule in enumerate(rules)]
    if quality:
        marked = F.when(_is_script(), _marked_lines(F.col("content")))
        lines.append(F.coalesce(marked, F.array().cast("array<string>")).alias("marked"))
        detectors += _quality_detectors()
    found = []
    if detectors:
        found.append(_line_scan(source.select(*keys, "first_line", F.arrays_zip(*lines).alias("lines")), detectors))

    held = list(_needles())
    facts = source.select(
        *keys, *(has.alias(name) for name, has in _needles().items()),
        text.comment_lines(F.col("content"), F.col("ext")).alias("comment_lines"),
        text.non_blank_lines(F.col("content")).alias("non_blank_lines"), F.size(lines[0]).alias("lines_of_code"),
    )
    counts = [F.sum(name).alias(name) for name in ("comment_lines", "non_blank_lines", "lines_of_code")]
    by_file = facts.groupBy(*keys).agg(*(F.bool_or(name).alias(name) for name in held), *counts)
    by_file = by_file.select(
        *keys, _file_flags({name: F.col(name) for name in held}).alias("flags"), "comment_lines", "non_blank_lines",
        "lines_of_code", F.lit(0).alias("pos"), F.lit(1).alias("line_no"), F.lit("").alias("line_text"),
    )
    whole = (_file_detectors() if security else []) + (_file_quality_detectors() if quality else [])
    if whole:
        found.append(_detect(by_file, keys, whole))
    if not found:
        raise ValueError("nothing to scan for: no rules and no checks are selected")
    return reduce(DataFrame.unionByName, found)


def _to_findings(hit_lines: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """Explodes ``hits`` and fills in what is fixed about each check.

    The outer explode plus a filter on its output is deliberate: below an inner explode Catalyst adds
    a ``size(..) > 0`` filter, which would evaluate every detector a second time.
    """
    keys = file_keys(hit_lines)
    constants = F.from_json(
        F.lit(json.dumps([detector.constants() for detector in detectors])), _CONSTANTS
    )
    exploded = hit_lines.select(*keys, "line_no", "line_text", F.explode_outer("hits").alias("hit"))
    exploded = exploded.where("hit is not null")
    known = exploded.select("*", F.get(constants, F.col("hit.check")).alias("fixed"))
    return known.selectExpr(
        *keys, "fixed.type", "fixed.tool", "fixed.severity", "fixed.issue",
        "coalesce(hit.description, fixed.description) as description",
        "if(fixed.by_line, line_no, null) as line",
        f"case fixed.code when 'plain' then line_text when 'stripped' then {text.strip_sql('line_text')} end as code",
        "hit.matched", "cast(null as string) as confidence", "fixed.recommendation",
        "fixed.phase", "fixed.rule_ord",
        "cast(if(fixed.by_line, line_no, 0) as bigint) as pos", "hit.match_ord",
    )


def lines_of_marks(marked: Column) -> Column:
    """For each mark in an array of lines, the number of its line."""
    return F.flatten(F.transform(
        marked, lambda line, at: F.array_repeat(at + 1, F.regexp_count(line, F.lit("\x01")))
    ))


def _whole_text_scan(source: DataFrame, rule: Rule, rule_ord: int) -> DataFrame:
    """Hits of a rule that may match across line breaks.

    Spark gives all matches but not their positions, so the lines come from a second copy of the text
    with a mark before every match: the i-th mark belongs to the i-th match.
    """
    pattern = java_pattern(rule.pattern, ignore_case=True, multiline=True)
    markable = F.translate("content", "\x01", "\x02")
    marked = text.split_lines(F.regexp_replace(markable, pattern, "\x01$0"))
    if rule.extensions is not None:
        source = source.where(F.col("ext").isin(*rule.extensions))
    matched = source.select(
        *file_keys(source), text.split_lines(F.col("content")).alias("lines"),
        F.arrays_zip(
            lines_of_marks(marked).alias("line_no"),
            F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("matched"),
        ).alias("matches"),
    )
    # Lines are looked up before the explode, so that it copies one line per match and not all.
    hit = _hit(matched="m.matched", match_ord="at").replace("{check}", "0")
    located = matched.selectExpr(
        *file_keys(source),
        "transform(matches, (m, at) -> named_struct('line_no', m.line_no, "
        f"'line_text', get(lines, m.line_no - 1), 'hits', array({hit}))) as found",
    )
    by_match = located.select(*file_keys(source), F.explode_outer("found").alias("entry"))
    detector = Detector(rule, "security", PATTERN_PHASE, rule_ord, "", "", {}, code="plain")
    return _to_findings(by_match.selectExpr(*file_keys(source), "entry.*"), [detector])


def security_findings(files: DataFrame, rules: Sequence[Rule] = RULES, wildcard: str = "documented"):
    return scan(files, rules, quality=False, wildcard=wildcard)


def text_quality_findings(files: DataFrame, checks: Collection[str] | None = None) -> DataFrame:
    return scan(files, security=False, checks=checks)
