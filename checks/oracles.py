"""The same answers in DuckDB SQL, written from the definitions rather than from the Spark code."""

from __future__ import annotations

from checks import corpora
from checks.corpora import PY_BLOCKS, PY_PARTS, block_selector, is_broken
from reviewlake import catalog

SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
CSRF = r"@app\.route.*methods.*POST"


def text(value) -> str:
    return "'" + value.replace("'", "''") + "'"


def members(values) -> str:
    return "(" + ", ".join(text(value) for value in values) + ")"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


EXT = r"lower(regexp_extract(regexp_extract(filename, '([^/]+)/*$', 1), '^.+(\.[^.]+)$', 1))"
IS_CODE = f"{EXT} IN {members(catalog.CODE_EXTENSIONS)}" + "".join(
    f" AND NOT contains(filename, {text(part)})" for part in catalog.SKIPPED_PATHS
)
SCRIPT = f"ext IN {members(catalog.SCRIPT_EXTENSIONS)}"
NEWLINE = "chr(10)"


def source(corpus: str, keys: str = "change_id, file_ord, file_id") -> str:
    """CTEs: the reviewed files and their numbered lines."""
    return f"""
files AS ({corpus}),
src AS (SELECT {keys}, filename, {EXT} AS ext, content FROM files
        WHERE {IS_CODE} AND content IS NOT NULL AND content <> ''),
lines AS (SELECT {keys}, filename, ext, unnest(string_split(content, {NEWLINE})) AS line_text,
                 CAST(generate_subscripts(string_split(content, {NEWLINE}), 1) AS INTEGER) AS line
          FROM src)"""


FILE_KEYS = "file_id"
KEYS = "change_id, file_ord, file_id"


def _scope(extensions) -> str:
    return "TRUE" if extensions is None else f"ext IN {members(extensions)}"


def rule_hits(rule, at: int, keys: str = KEYS) -> str:
    """Hits of one pattern rule: all matches on each line."""
    constants = (
        f"{text(rule.severity)} AS severity, {text(rule.name)} AS issue, "
        f"{text(rule.description)} AS description, {text(rule.recommendation)} AS recommendation"
    )
    code = "line_text" if rule.multiline else strip("line_text")
    if rule.name == "missing_csrf_protection":
        found = (
            f"CASE WHEN regexp_matches(line_text, '(?i){CSRF}') AND NOT contains(lower("
            f"regexp_replace(line_text, '(?i)^.*?{CSRF}', '')), 'csrf') "
            f"THEN [regexp_extract(line_text, '(?i){CSRF}')] ELSE [] END"
        )
    else:
        found = f"regexp_extract_all(line_text, {text('(?i)' + rule.pattern)})"
    return f"""
SELECT {keys}, filename, 'pattern-matcher' AS tool, {constants}, line, {code} AS code,
       unnest(found) AS matched, CAST(NULL AS VARCHAR) AS confidence,
       0 AS phase, {at} AS rule_ord, line AS pos, generate_subscripts(found, 1) - 1 AS match_ord
FROM (SELECT *, {found} AS found FROM lines WHERE {_scope(rule.extensions)})"""


def file_check_hits(keys: str = KEYS) -> str:
    checks = [
        (catalog.UNSAFE_PICKLE, 0, "ext = '.py' AND contains(content, 'pickle') "
                                   "AND NOT contains(lower(content), 'safe')"),
        (catalog.MISSING_HTTPS, 1, "ext = '.py' AND contains(content, 'Flask') "
                                   "AND NOT contains(content, 'ssl_context')"),
        (catalog.EVAL_USAGE, 0, f"{SCRIPT} AND regexp_matches(content, {text(catalog.EVAL_PATTERN)})"),
        (catalog.INNER_HTML, 1,
         f"{SCRIPT} AND regexp_matches(content, {text(catalog.INNER_HTML_PATTERN)})"),
        (catalog.SELECT_STAR, 0, "ext = '.sql' AND regexp_matches(content, "
                                 f"{text('(?i)' + catalog.SELECT_STAR_PATTERN)})"),
    ]
    return " UNION ALL ".join(f"""
SELECT {keys}, filename, 'pattern-matcher' AS tool, {text(check.severity)} AS severity,
       {text(check.name)} AS issue, {text(check.description)} AS description,
       {text(check.recommendation)} AS recommendation, CAST(NULL AS INTEGER) AS line,
       CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS matched,
       CAST(NULL AS VARCHAR) AS confidence, 1 AS phase, {at} AS rule_ord, 0 AS pos, 0 AS match_ord
FROM src WHERE {condition}""" for check, at, condition in checks)


def all_rule_hits(rules=tuple(enumerate(catalog.RULES)), keys: str = KEYS) -> str:
    return " UNION ALL ".join(rule_hits(rule, at, keys) for at, rule in rules)


# A report is about a code file by its name; that it is there says that the file had content.
_REPORT_CTES = f"""
reports AS ({corpora.REPORTS}),
named AS (SELECT {KEYS}, filename, {EXT} AS ext FROM files WHERE {IS_CODE})"""


def report_hits(tool: str) -> str:
    """Findings of one scanner, by DuckDB's own JSON functions."""
    items = f"""
SELECT r.file_id, s.change_id, s.file_ord, s.filename, unnest(json_extract(r.report, '$.results[*]')) AS item,
       generate_subscripts(json_extract(r.report, '$.results[*]'), 1) - 1 AS idx
FROM (SELECT file_id, report FROM reports WHERE tool = '{tool}' AND json_valid(report)) r
JOIN named s ON r.file_id = s.file_id {"WHERE s.ext = '.py'" if tool == "bandit" else ""}"""

    def get(path):
        return f"json_extract_string(item, '$.{path}')"

    if tool == "bandit":
        known = " ".join(
            f"WHEN {text(key)} THEN {text(value)}"
            for key, value in catalog.BANDIT_RECOMMENDATIONS.items()
        )
        return f"""
SELECT {KEYS}, filename, 'bandit' AS tool,
       CASE upper(coalesce({get("issue_severity")}, 'LOW')) WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low'
            ELSE 'medium' END AS severity,
       coalesce({get("test_id")}, 'Unknown') AS issue,
       coalesce({get("issue_text")}, 'Security issue detected') AS description,
       CASE WHEN coalesce({get("more_info")}, '') <> '' THEN concat('See: ', {get("more_info")})
            ELSE CASE {get("test_id")} {known}
                 ELSE 'Review security best practices for this pattern' END END AS recommendation,
       CAST({get("line_number")} AS INTEGER) AS line, {strip(f"coalesce({get('code')}, '')")} AS code,
       CAST(NULL AS VARCHAR) AS matched, coalesce({get("issue_confidence")}, 'MEDIUM') AS confidence,
       2 AS phase, 0 AS rule_ord, idx AS pos, 0 AS match_ord
FROM ({items})"""

    def first(name):
        path = f"'$.extra.metadata.{name}'"
        return (
            f"CASE json_type(item, {path}) WHEN 'ARRAY' THEN "
            f"json_extract_string(item, '$.extra.metadata.{name}[0]') "
            f"ELSE json_extract_string(item, {path}) END"
        )

    return f"""
SELECT {KEYS}, filename, 'semgrep' AS tool,
       CASE lower(coalesce({get("extra.severity")}, 'INFO')) WHEN 'error' THEN 'high'
            WHEN 'warning' THEN 'medium' WHEN 'info' THEN 'low'
            ELSE lower({get("extra.severity")}) END AS severity,
       coalesce({get("check_id")}, 'Unknown') AS issue,
       coalesce({get("extra.message")}, 'Security pattern detected') AS description,
       CASE WHEN {first("references")} IS NOT NULL THEN concat('See: ', {first("references")})
            WHEN {first("cwe")} IS NOT NULL AND {first("owasp")} IS NOT NULL
              THEN concat('Related to CWE-', {first("cwe")}, '; OWASP: ', {first("owasp")})
            WHEN {first("cwe")} IS NOT NULL THEN concat('Related to CWE-', {first("cwe")})
            WHEN {first("owasp")} IS NOT NULL THEN concat('OWASP: ', {first("owasp")})
            ELSE 'Follow security best practices to address this finding' END AS recommendation,
       CAST({get("start.line")} AS INTEGER) AS line, {strip(f"coalesce({get('extra.lines')}, '')")} AS code,
       CAST(NULL AS VARCHAR) AS matched, CAST(NULL AS VARCHAR) AS confidence,
       3 AS phase, 0 AS rule_ord, idx AS pos, 0 AS match_ord
FROM ({items})"""


def security() -> str:
    """CTE ``sec``: every security finding of the changed files."""
    return f"""
{_REPORT_CTES},
sec AS ({all_rule_hits()} UNION ALL {file_check_hits()} UNION ALL {report_hits("bandit")}
        UNION ALL {report_hits("semgrep")})"""


# --- quality --------------------------------------------------------------------------------------

# ASCII word boundaries are enough once every letter is one: \p{L} is turned into x.
_NUMBERS = (
    r"list_filter(regexp_extract_all(regexp_replace(line_text, '\p{L}', 'x', 'g'), "
    r"'\b(\d+\.?\d*)\b', 1), lambda n: n NOT IN " + members(catalog.ALLOWED_NUMBERS) + ")"
)


def _marked(pattern: str, check, at: int, keys: str) -> str:
    """Hits by line of a pattern that may span lines: a mark is put before each match."""
    marks = "len(regexp_extract_all(marked, chr(1)))"
    return f"""
SELECT {keys}, filename, {text(check.severity)} AS severity, {text(check.name)} AS issue,
       {text(check.description)} AS description, {text(check.recommendation)} AS recommendation,
       line, CAST(NULL AS VARCHAR) AS code, 0 AS phase, {at} AS rule_ord, line AS pos,
       unnest(range({marks})) AS match_ord
FROM (SELECT {keys}, filename, unnest(string_split(marks, {NEWLINE})) AS marked,
             CAST(generate_subscripts(string_split(marks, {NEWLINE}), 1) AS INTEGER) AS line
      FROM (SELECT *, regexp_replace(content, {text("(" + pattern + ")")}, concat(chr(1), '\\1'), 'g')
            AS marks FROM src WHERE {SCRIPT}))"""


def text_quality(keys: str = KEYS) -> str:
    """CTEs ``sizes`` and ``textqual``: line and whole-file quality findings."""
    marker = f"CASE WHEN ext IN {members(catalog.HASH_COMMENT_EXTENSIONS)} THEN '#' ELSE '//' END"

    def line_hit(check, at, condition, description=None, code="CAST(NULL AS VARCHAR)"):
        return f"""
SELECT {keys}, filename, {text(check.severity)} AS severity, {text(check.name)} AS issue,
       {description or text(check.description)} AS description,
       {text(check.recommendation)} AS recommendation, line, {code} AS code,
       1 AS phase, {at} AS rule_ord, line AS pos, 0 AS match_ord
FROM lines WHERE {condition}"""

    def file_hit(check, at, condition, description):
        return f"""
SELECT {keys}, filename, {text(check.severity)} AS severity, {text(check.name)} AS issue,
       {description} AS description, {text(check.recommendation)} AS recommendation,
       CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS code,
       1 AS phase, {at} AS rule_ord, 0 AS pos, 0 AS match_ord
FROM sizes WHERE {condition}"""

    console = f"""
SELECT {keys}, filename, {text(catalog.CONSOLE_LOG.severity)} AS severity, 'console_log' AS issue,
       {text(catalog.CONSOLE_LOG.description)} AS description,
       {text(catalog.CONSOLE_LOG.recommendation)} AS recommendation, line, CAST(NULL AS VARCHAR) AS code,
       0 AS phase, 0 AS rule_ord, line AS pos,
       unnest(range(len(regexp_extract_all(line_text, {text(catalog.CONSOLE_PATTERN)})))) AS match_ord
FROM lines WHERE {SCRIPT}"""
    parts = [
        console,
        _marked(catalog.VAR_PATTERN, catalog.VAR_USAGE, 1, keys),
        _marked(catalog.LOOSE_EQUALITY_PATTERN, catalog.LOOSE_EQUALITY, 2, keys),
        line_hit(catalog.LONG_LINE, 0, "length(line_text) > 120",
                 "concat('Line ', line, ' exceeds 120 characters (', length(line_text), ')')"),
        line_hit(catalog.TODO_COMMENT, 1,
                 f"regexp_matches(line_text, {text('(?i)' + catalog.TODO_PATTERN)})",
                 code=strip("line_text")),
        file_hit(catalog.COMMENT_RATIO, 2, "comment_ratio > 0.3",
                 "concat('High comment ratio (', printf('%.1f', comment_ratio * 100), '%)')"),
        line_hit(catalog.MAGIC_NUMBER, 3,
                 f"len({_NUMBERS}) > 0 AND NOT starts_with({strip('line_text')}, '#')",
                 f"concat('Magic number ', ({_NUMBERS})[1], ' found')"),
        file_hit(catalog.LONG_FILE, 4, "lines_of_code > 500",
                 "concat('File is very long (', lines_of_code, ' lines)')"),
    ]
    return f"""
sizes AS (SELECT *, CASE WHEN non_blank_lines > 0 THEN comment_lines / non_blank_lines ELSE 0.0 END
                 AS comment_ratio
          FROM (SELECT {keys}, filename, ext, CAST(count(*) AS INTEGER) AS lines_of_code,
                  CAST(count(*) FILTER ({strip("line_text")} <> '') AS INTEGER) AS non_blank_lines,
                  CAST(count(*) FILTER (starts_with({strip("line_text")}, {marker})) AS INTEGER)
                    AS comment_lines
                FROM lines GROUP BY ALL)),
textqual AS ({" UNION ALL ".join(parts)})"""


def _python_facts() -> str:
    """CTEs ``placed`` and ``nodes``: functions and classes of Python files, known by construction."""
    blocks = ", ".join(
        f"({at}, {len(block.split(chr(10)))})" for at, (block, _) in enumerate(PY_BLOCKS)
    )
    facts = ", ".join(
        f"({at}, {text(kind)}, {text(name)}, {line}, {end}, {depth}, "
        f"{'NULL' if complexity is None else complexity}, {documented})"
        for at, (_, found) in enumerate(PY_BLOCKS)
        for kind, name, line, end, depth, complexity, documented in found
    )
    picks = " UNION ALL ".join(
        f"SELECT {KEYS}, filename, {is_broken('file_id')} AS broken, {at} AS part, "
        f"({block_selector('file_id', 'change_id', at)}) % {len(PY_BLOCKS)} AS block FROM python"
        for at in range(PY_PARTS)
    )
    return f"""
python AS (SELECT * FROM src WHERE ext = '.py'),
blocks(block, size) AS (VALUES {blocks}),
facts(block, kind, name, first, last, depth, complexity, documented) AS (VALUES {facts}),
placed AS (SELECT p.*, b.size,
             coalesce(sum(b.size + 1) OVER (PARTITION BY file_id ORDER BY part
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM ({picks}) p JOIN blocks b USING (block)),
nodes AS (SELECT {KEYS}, filename, kind, replace(name, '{{n}}', CAST(file_id AS VARCHAR)) AS name,
                 CAST(before + first AS INTEGER) AS line, CAST(complexity AS INTEGER) AS complexity,
                 CAST(last - first AS INTEGER) AS length, documented,
                 row_number() OVER (PARTITION BY file_id ORDER BY depth, before + first) - 1 AS pos
          FROM placed JOIN facts USING (block) WHERE NOT broken)"""


def quality() -> str:
    """CTE ``qual``: every quality finding of the changed files."""

    def node_hit(check, at, condition, description, match_ord=0):
        return f"""
SELECT {KEYS}, filename, {text(check.severity)} AS severity, {text(check.name)} AS issue,
       {description} AS description, {text(check.recommendation)} AS recommendation, line,
       CAST(NULL AS VARCHAR) AS code, 0 AS phase, {at} AS rule_ord, pos, {match_ord} AS match_ord
FROM nodes WHERE {condition}"""

    parts = [
        "SELECT * FROM textqual",
        node_hit(catalog.HIGH_COMPLEXITY, 0, "complexity > 10",
                 "concat('Function \"', name, '\" has high complexity (', complexity, ')')"),
        node_hit(catalog.LONG_FUNCTION, 0, "kind = 'function' AND length > 50",
                 "concat('Function \"', name, '\" is ', length, ' lines long')", 1),
        node_hit(catalog.MISSING_DOCSTRING, "CASE kind WHEN 'function' THEN 1 ELSE 2 END",
                 "NOT documented",
                 "concat(upper(kind[1]), kind[2:], ' \"', name, '\" missing docstring')"),
        f"""
SELECT {KEYS}, filename, 'critical' AS severity, 'syntax_error' AS issue, '' AS description,
       {text(catalog.SYNTAX_ERROR.recommendation)} AS recommendation,
       CAST(sum(size + 1) AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS code,
       0 AS phase, 0 AS rule_ord, 0 AS pos, 0 AS match_ord
FROM placed WHERE broken GROUP BY ALL""",
    ]
    return text_quality() + f", {_python_facts()}, qual AS ({' UNION ALL '.join(parts)})"


# --- queries --------------------------------------------------------------------------------------

_LINE = "file_id, filename, severity, line, code, matched, description, recommendation"
_COUNTS = (
    "count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, "
    "count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low"
)
_ORDER = "file_ord, phase, rule_ord, pos, match_ord"
_LISTED = "file_id, severity, issue, line, description"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


def _files() -> str:
    return source(corpora.FILES)


def _security() -> str:
    return _with(_files(), security())


def _both() -> str:
    return _with(_files(), security(), quality())


def _quality() -> str:
    return _with(_files(), quality())


_CHANGE_CTES = f"""
changed AS (SELECT change_id, CAST(sum(additions) AS BIGINT) AS total_additions,
                   CAST(sum(deletions) AS BIGINT) AS total_deletions, count(*) AS files_changed
            FROM files WHERE {IS_CODE} GROUP BY change_id),
seccount AS (SELECT change_id, count(*) AS security_issues, {_COUNTS} FROM sec GROUP BY change_id),
qualcount AS (SELECT change_id, count(*) AS quality_issues,
                     count(*) FILTER (contains(issue, 'function')) AS functions,
                     count(*) FILTER (severity IN ('high', 'medium')) AS quality_medium_high
              FROM qual GROUP BY change_id),
counters AS (SELECT change_id, total_additions, total_deletions, files_changed,
               coalesce(security_issues, 0) AS security_issues, coalesce(critical, 0) AS critical,
               coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
               coalesce(quality_issues, 0) AS quality_issues, coalesce(functions, 0) AS functions,
               coalesce(quality_medium_high, 0) AS quality_medium_high
             FROM changed LEFT JOIN seccount USING (change_id) LEFT JOIN qualcount USING (change_id)),
verdicts AS (SELECT *,
               CASE WHEN critical > 0 THEN '❌' WHEN high > 0 OR quality_issues > 10 THEN '⚠️' ELSE '✅' END
                 AS mark,
               CASE WHEN critical > 0 OR high > 0 OR quality_issues > 10 THEN 'Request Changes'
                    ELSE 'Approve with Comments' END AS verdict,
               CASE WHEN critical > 0 THEN 'Critical security issues must be addressed'
                    WHEN high > 0 THEN 'High priority security issues found'
                    WHEN quality_issues > 10 THEN 'Multiple quality issues should be addressed'
                    ELSE 'Minor issues can be addressed in follow-up' END AS reason
             FROM counters)"""


def _changes() -> str:
    return _both() + ", " + _CHANGE_CTES


def _first(table: str, severities, n: int, by: str = "") -> str:
    partition = f"PARTITION BY {by}" if by else ""
    columns = f"{by + ', ' if by else ''}CAST(rank AS INTEGER) AS rank"
    return (
        f" SELECT {columns}, {_LISTED} FROM (SELECT *, row_number() OVER ({partition} ORDER BY {_ORDER})"
        f" AS rank FROM {table} WHERE severity IN {members(severities)}) WHERE rank <= {n}"
    )


def _listing(table: str, severities, tool: bool) -> str:
    confidence = "CASE WHEN confidence IS NULL THEN NULL ELSE concat('  Confidence: ', confidence) END"
    head = "concat('● [', tool, '] ', issue)" if tool else "concat('● ', issue)"
    return f"""
SELECT CAST(rank AS INTEGER) AS rank, concat_ws(chr(10), {head}, concat('  File: ', filename),
         CASE WHEN line IS NULL THEN NULL ELSE concat('  Line: ', line) END,
         concat('  ', description), {confidence if tool else "NULL"},
         concat('  → ', recommendation)) AS listing
FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM {table}
      WHERE severity IN {members(severities)}) WHERE rank <= 10"""


def _template(template: str, **values: str) -> str:
    """A concat over a text with {name} places; each place is filled by SQL (its own name if not given)."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(
        values.get(part, part) if at % 2 else text(part) for at, part in enumerate(parts) if part
    ) + ")"


def _object(fields, null_where: str = "FALSE") -> str:
    entries = ", ".join(
        f"CASE WHEN {name} IS NULL THEN {absent(name, null_where)} ELSE concat('    \"{name}\": ', "
        f"{f'to_json({name})' if is_text else name}) END" for name, is_text in fields
    )
    return f"concat('  {{', chr(10), concat_ws(concat(',', chr(10)), {entries}), chr(10), '  }}')"


def absent(name: str, null_where: str) -> str:
    return f"CASE WHEN {null_where} THEN '    \"line\": null' END" if name == "line" else "NULL"


def _json_list(table: str, where: str, order: str, n: int, fields, name: str, null_where: str = "FALSE") -> str:
    return f"""
{name} AS (SELECT change_id, concat('[', chr(10), string_agg(entry, concat(',', chr(10)) ORDER BY rank),
             chr(10), ']') AS {name}
  FROM (SELECT change_id, {_object(fields, null_where)} AS entry,
               row_number() OVER (PARTITION BY change_id ORDER BY {order}) AS rank
        FROM {table} WHERE {where}) WHERE rank <= {n} GROUP BY change_id)"""


def _review_prompt() -> str:
    texts = ("tool", "type", "severity", "issue", "description", "filename", "code", "matched",
             "confidence", "recommendation")
    order = ("tool", "type", "severity", "issue", "description", "filename", "line", "code", "matched",
             "confidence", "recommendation")
    quality_order = ("type", "severity", "issue", "description", "line", "code", "recommendation")
    lists = [
        _json_list("files", IS_CODE, "file_ord", 10,
                   [("filename", True), ("status", True), ("additions", False), ("deletions", False)],
                   "files_json"),
        _json_list("(SELECT *, 'security' AS type FROM sec)", "severity = 'critical'", _ORDER, 5,
                   [(name, name in texts) for name in order], "critical_json", "tool IN ('bandit', 'semgrep')"),
        _json_list("(SELECT *, 'quality' AS type FROM qual)", "severity IN ('high', 'medium')", _ORDER,
                   5, [(name, name in texts) for name in quality_order], "quality_json"),
    ]
    prompt = _template(
        catalog.REVIEW_PROMPT, title="coalesce(title, 'Untitled')",
        description="coalesce(description, '')", files_json="coalesce(files_json, '[]')",
        critical_json="coalesce(critical_json, 'None')", quality_json="coalesce(quality_json, 'None')",
    )
    return _changes() + f""", changes AS ({corpora.CHANGES}), {", ".join(lists)}
SELECT change_id, {prompt} AS prompt FROM counters JOIN changes USING (change_id)
LEFT JOIN files_json USING (change_id) LEFT JOIN critical_json USING (change_id)
LEFT JOIN quality_json USING (change_id) WHERE security_issues + quality_issues > 0"""


def _user_rules() -> str:
    """Two rules by line, and two over the whole text through marks before each match."""
    def marked(name, pattern, severity, scope):
        replaced = f"regexp_replace(content, {text('(?im)(' + pattern + ')')}, concat(chr(1), '\\1'), 'g')"
        return f"""
SELECT '{name}' AS issue, file_id, '{severity}' AS severity, line,
       string_split(content, {NEWLINE})[line] AS code, matched
FROM (SELECT file_id, content, unnest(regexp_extract_all(content, {text('(?im)' + pattern)})) AS matched,
        unnest(flatten(list_transform(string_split({replaced}, {NEWLINE}),
          lambda l, i: list_transform(regexp_extract_all(l, chr(1)), lambda x: CAST(i AS INTEGER))))) AS line
      FROM src WHERE {scope})"""

    return _with(_files()) + rf"""
SELECT 'import_statement' AS issue, file_id, 'low' AS severity, line, {strip("line_text")} AS code,
       unnest(regexp_extract_all(line_text, '(?i)^\s*import\s+(\w+)')) AS matched FROM lines
UNION ALL
SELECT 'call_of_save', file_id, 'unusual', line, {strip("line_text")},
       unnest(regexp_extract_all(line_text, '(?i)\bsave\(\)')) FROM lines WHERE ext IN ('.py', '.rb')
UNION ALL {marked("split_statement", r"==\s*\n\s*\w+", "medium", "TRUE")}
UNION ALL {marked("last_word", r"\w+$", "info", "ext = '.sql'")}"""


def _part_rules() -> str:
    """Every number a rule could be about, looked up among the parts; the rules themselves are not run."""

    def numbers(pattern, family, scope="TRUE", lines="lines"):
        found = f"regexp_extract_all(line_text, '(?i){pattern}', {{}})"
        return f"""
SELECT file_id, line, line_text, {family} AS family, unnest({found.format(0)}) AS matched,
       unnest({found.format(1)}) AS number, generate_subscripts({found.format(1)}, 1) AS nth
FROM {lines} WHERE {scope}"""

    two_lines = (
        f"(SELECT file_id, line, concat(line_text, {NEWLINE}, lead(line_text) OVER (PARTITION BY file_id ORDER BY line)) "
        "AS line_text FROM lines)"
    )
    stripped = f"CASE WHEN family = 3 THEN string_split(line_text, {NEWLINE})[1] ELSE {strip('line_text')} END"
    return _with(_files()) + rf""",
hits AS ({numbers(r"\bx\s*=\s*(\d+)\b", 0)}
  UNION ALL {numbers(r"short_(\d+)\b", 1, "ext IN ('.py', '.rb')")}
  UNION ALL {numbers(r"(?:later|note) (\d+)\b", 2)}
  UNION ALL {numbers(r"later (\d+)\n# note", 3, lines=two_lines)})
SELECT concat('part_', p_partkey) AS issue, file_id, CASE WHEN family = 3 THEN 'high' ELSE 'low' END AS severity,
       p_name AS description, p_brand AS recommendation, line, {stripped} AS code, matched,
       CAST(row_number() OVER (PARTITION BY p_partkey, file_id, CASE WHEN family < 3 THEN line END ORDER BY line, nth) - 1
            AS INTEGER) AS match_ord
FROM hits JOIN part ON p_partkey % 4 = family AND CAST(p_partkey + 1000 AS VARCHAR) = number"""


def _duplication() -> str:
    """CTEs: four stripped lines in a row, in words rather than hashes, and the regions of those that come again."""
    return _with(_files()) + f""",
filled AS (SELECT file_id, line, {strip("line_text")} AS t,
                  row_number() OVER (PARTITION BY file_id ORDER BY line) AS pos
           FROM lines WHERE {strip("line_text")} <> ''),
fours AS (SELECT file_id, pos, line AS first_line, lead(line, 3) OVER w AS last_line,
                 concat(t, chr(10), lead(t, 1) OVER w, chr(10), lead(t, 2) OVER w, chr(10), lead(t, 3) OVER w) AS body
          FROM filled WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
counted AS (SELECT *, count(*) OVER (PARTITION BY body) AS copies FROM fours WHERE last_line IS NOT NULL),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY file_id ORDER BY pos) AS island FROM counted WHERE copies > 1),
regions AS (SELECT file_id, min(first_line) AS first_line, max(last_line) AS last_line, count(*) + 3 AS lines,
                   max(copies) AS copies FROM islands GROUP BY file_id, island)"""


def _hunks() -> str:
    """Hunks by running count of header lines over the numbered lines of each patch."""
    kind = (
        "CASE WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'added' "
        "WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'removed' ELSE 'context' END"
    )
    return f"""
WITH patches AS ({corpora.PATCHES}),
numbered AS (SELECT file_id, unnest(string_split(patch, {NEWLINE})) AS line,
                    generate_subscripts(string_split(patch, {NEWLINE}), 1) AS idx
             FROM patches WHERE patch IS NOT NULL AND patch <> ''),
grouped AS (SELECT *, CAST(sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END)
              OVER (PARTITION BY file_id ORDER BY idx) - 1 AS INTEGER) AS hunk FROM numbered),
body AS (SELECT file_id, hunk, idx, {kind} AS kind,
                CASE WHEN {kind} = 'context' THEN line ELSE line[2:] END AS text,
                CAST(row_number() OVER (PARTITION BY file_id, hunk ORDER BY idx) - 1 AS INTEGER) AS pos
         FROM grouped WHERE hunk >= 0 AND NOT starts_with(line, '@@')),
heads AS (SELECT file_id, hunk, line AS header FROM grouped WHERE starts_with(line, '@@'))"""


def _hunk_table() -> str:
    columns = ", ".join(
        f"coalesce(string_agg(text, {NEWLINE} ORDER BY idx) FILTER (kind = '{kind}'), '') AS {kind}, "
        f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("added", "removed", "context")
    )
    return _hunks() + f"""
SELECT file_id, hunk, header, {columns}
FROM heads LEFT JOIN body USING (file_id, hunk) GROUP BY file_id, hunk, header"""


def _binary() -> str:
    name = (
        "concat('in/d_', CAST(doc_id AS VARCHAR), CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' "
        "WHEN 2 THEN '.Sql' ELSE '.js' END)"
    )
    return f"SELECT doc_id AS file_id, {name} AS filename, text FROM documents"


def _change_content() -> str:
    return _with(f"files AS ({corpora.FILES})") + f"""
SELECT change_id, filename, status, '' AS patch,
       CASE WHEN status = 'removed' OR file_id % 23 = 2 THEN NULL ELSE content END AS content,
       status <> 'removed' AND file_id % 23 = 2 AND content IS NOT NULL AS decode_error
FROM files WHERE {IS_CODE}"""


def _snapshot_diff() -> str:
    head, index, work = corpora.IN_SNAPSHOT
    content = f"CASE WHEN {work} THEN {corpora.SNAPSHOT_CONTENT[2]} END AS content"
    columns = f"{corpora.SNAPSHOT_NAME} AS filename, {{stage}} AS stage, 'modified' AS status, '' AS patch, {content}"
    return f"""
SELECT {columns.format(stage=0)} FROM documents
WHERE (({head}) <> ({index}) OR (({head}) AND ({index}) AND {corpora.STAGED}))
UNION ALL
SELECT {columns.format(stage=1)} FROM documents
WHERE ({index}) AND (NOT ({work}) OR {corpora.EDITED})"""


def _stream() -> str:
    keys = "file_id, ts"
    return _with(source(corpora.ARRIVALS, keys), text_quality(keys)) + f""",
found AS (SELECT {keys}, severity, issue, line, code, matched
          FROM ({all_rule_hits(keys=keys)} UNION ALL {file_check_hits(keys)})
          UNION ALL
          SELECT {keys}, severity, issue, line, code, CAST(NULL AS VARCHAR) FROM textqual)"""


def _long_file_parts() -> str:
    columns = "file_id, severity, issue, description, line, code"
    return _with(source(corpora.SIZE_FILES, FILE_KEYS), text_quality(FILE_KEYS)) + f"""
SELECT {columns}, matched FROM ({all_rule_hits(keys=FILE_KEYS)} UNION ALL {file_check_hits(FILE_KEYS)})
UNION ALL
SELECT {columns}, CAST(NULL AS VARCHAR) FROM textqual"""


def oracle_sql() -> dict[str, str]:
    found = {
        "file_ext": _with(f"files AS ({corpora.FILES})")
        + f" SELECT file_id, filename, {EXT} AS ext FROM files",
        "code_files": _with(f"files AS ({corpora.FILES})")
        + f" SELECT file_id, filename, {EXT} AS ext FROM files WHERE {IS_CODE}",
        "has_content": _with(f"files AS ({corpora.FILES})")
        + " SELECT file_id, status, content FROM files WHERE status <> 'removed' AND content <> ''",
        "binary_ingest": f"""
SELECT file_id, filename, lower(filename[-(CASE WHEN file_id % 4 = 2 THEN 4 ELSE 3 END):]) AS ext,
       'review' AS status,
       CASE WHEN file_id % 3 = 2 THEN replace(text, '. ', concat('.', chr(10))) ELSE text END AS content
FROM ({_binary()}) WHERE file_id % 4 <> 1 AND file_id % 17 <> 3""",
        "binary_rejects": f"""
SELECT filename, CASE WHEN file_id % 4 = 1 THEN 'not a code file' ELSE 'not UTF-8' END AS reason
FROM ({_binary()}) WHERE file_id % 4 = 1 OR file_id % 17 = 3""",
        "scan_rules_documented": _with(_files())
        + f" SELECT issue, {_LINE} FROM ({all_rule_hits()})",
        "scan_rules_as_coded": _with(_files()) + f" SELECT issue, {_LINE} FROM ("
        + all_rule_hits([(at, rule) for at, rule in enumerate(catalog.RULES) if rule.extensions]) + ")",
        "scan_user_rules": _user_rules(),
        "scan_incremental": _quality() + f"""
SELECT change_id, file_id, 'security' AS type, severity, issue, description, line, code, matched
FROM ({all_rule_hits()} UNION ALL {file_check_hits()})
UNION ALL
SELECT change_id, file_id, 'quality', severity, issue, CASE WHEN issue <> 'syntax_error' THEN description END, line, code,
       CAST(NULL AS VARCHAR) FROM qual""",
        "duplication": _duplication() + " SELECT * FROM regions",
        "duplication_ratio": _duplication() + """
, sizes AS (SELECT src.file_id, count(pos) AS lines FROM src LEFT JOIN filled USING (file_id) GROUP BY src.file_id),
copied AS (SELECT file_id, sum(lines)::BIGINT AS duplicated FROM regions GROUP BY file_id)
SELECT file_id, lines, coalesce(duplicated, 0) AS duplicated,
       CASE WHEN lines > 0 THEN coalesce(duplicated, 0) / lines ELSE 0.0 END AS ratio
FROM sizes LEFT JOIN copied USING (file_id)""",
        "scan_rules_join": _part_rules(),
        "long_file_parts": _long_file_parts(),
        "scan_rules_table": f"SELECT * FROM ({_user_rules()}) WHERE severity <> 'unusual'",
    }
    for rule in catalog.RULES:
        found[f"rule_{rule.name}"] = _with(_files()) + f" SELECT {_LINE} FROM ({rule_hits(rule, 0)})"
        if rule.name == "weak_crypto":
            found["raw_weak_crypto"] = _with(source(corpora.RAW_FILES, FILE_KEYS)) + (
                f" SELECT file_id, line, code, matched FROM ({rule_hits(rule, 0, FILE_KEYS)})"
            )
    quality_columns = "file_id, filename, severity, description, recommendation"
    textqual = _with(_files(), text_quality())
    for name in ("long_line", "todo_comment", "magic_number", "console_log", "var_usage",
                 "loose_equality"):
        found[f"rule_{name}"] = (
            textqual + f" SELECT {quality_columns}, line, code FROM textqual WHERE issue = '{name}'"
        )
    found["rule_high_comment_ratio"] = (
        textqual + f" SELECT {quality_columns} FROM textqual WHERE issue = 'high_comment_ratio'"
    )
    found["long_file"] = _with(source(corpora.LONG_FILES, FILE_KEYS), text_quality(FILE_KEYS)) + (
        " SELECT file_id, severity, description FROM textqual WHERE issue = 'long_file'"
    )
    found["raw_quality"] = _with(source(corpora.RAW_FILES, FILE_KEYS), text_quality(FILE_KEYS)) + (
        " SELECT file_id, severity, issue, description, line, code FROM textqual"
    )
    for key, check in (
        ("unsafe_pickle", catalog.UNSAFE_PICKLE), ("missing_https", catalog.MISSING_HTTPS),
        ("eval_usage", catalog.EVAL_USAGE), ("inner_html", catalog.INNER_HTML),
        ("select_star", catalog.SELECT_STAR),
    ):
        found[key] = _with(_files()) + (
            f" SELECT {quality_columns} FROM ({file_check_hits()}) WHERE issue = {text(check.name)}"
        )
    js_functions = " + ".join(
        f"len(regexp_extract_all(content, {text(pattern)}))" for pattern in catalog.SCRIPT_FUNCTION_PATTERNS
    )
    facts = _with(_files(), _python_facts())
    structure = "file_id, line, severity, description"
    found |= {
        "comment_ratio": textqual
        + " SELECT file_id, comment_lines, non_blank_lines, comment_ratio FROM sizes",
        "lines_of_code": textqual + " SELECT file_id, lines_of_code FROM sizes",
        "js_functions": _with(_files()) + f" SELECT file_id, CAST({js_functions} AS INTEGER) AS functions"
        f" FROM src WHERE {SCRIPT}",
        "file_metrics": _quality() + f"""
, counts AS (SELECT file_id, CAST({js_functions} AS INTEGER) AS functions, CAST(NULL AS INTEGER) AS classes
             FROM src WHERE {SCRIPT}
  UNION ALL
  SELECT file_id, CAST(count(*) FILTER (kind = 'function') AS INTEGER),
         CAST(count(*) FILTER (kind = 'class') AS INTEGER)
  FROM (SELECT DISTINCT file_id FROM placed WHERE NOT broken) LEFT JOIN nodes USING (file_id)
  GROUP BY file_id)
SELECT file_id, lines_of_code, functions, classes, comment_ratio FROM sizes LEFT JOIN counts USING (file_id)""",
        "py_counts": facts + """
SELECT p.file_id, CAST(count(*) FILTER (kind = 'function') AS INTEGER) AS functions,
       CAST(count(*) FILTER (kind = 'class') AS INTEGER) AS classes
FROM (SELECT DISTINCT file_id FROM placed WHERE NOT broken) p LEFT JOIN nodes USING (file_id)
GROUP BY p.file_id""",
        "py_complexity": facts + " SELECT file_id, name AS function, line, complexity, length, documented"
        " FROM nodes WHERE kind = 'function'",
        "py_high_complexity": _quality() + f" SELECT {structure} FROM qual WHERE issue = 'high_complexity'",
        "py_long_function": _quality() + f" SELECT {structure} FROM qual WHERE issue = 'long_function'",
        "py_docstrings": _quality() + f" SELECT {structure} FROM qual WHERE issue = 'missing_docstring'",
        "py_syntax_errors": _quality()
        + " SELECT file_id, line, severity, issue FROM qual WHERE issue = 'syntax_error'",
        "hunks": _hunk_table(),
        "patch_lines": _hunks() + " SELECT file_id, hunk, pos, kind, text FROM body",
    }
    report_columns = (
        "file_id, filename, tool, severity, issue, description, line, code, confidence, recommendation"
    )
    with_reports = _with(_files(), _REPORT_CTES)
    for tool in catalog.REPORT_TOOLS:
        found[f"{tool}_findings"] = with_reports + f" SELECT {report_columns} FROM ({report_hits(tool)})"
    found |= {
        "tool_summary": with_reports + f"""
SELECT count(*) AS total_issues, {_COUNTS}, count(*) FILTER (severity = 'critical') > 0 AS has_critical,
       count(*) FILTER (severity = 'high') > 0 AS has_high,
       count(*) FILTER (tool = 'bandit') AS bandit, count(*) FILTER (tool = 'semgrep') AS semgrep
FROM ({report_hits("bandit")} UNION ALL {report_hits("semgrep")})""",
        "security_summary": _security() + f"""
SELECT count(*) AS total_issues, {_COUNTS}, count(*) FILTER (severity = 'critical') > 0 AS has_critical
FROM sec""",
        "security_summary_rollup": _security() + f"""
SELECT CASE WHEN grouping(change_id) = 1 THEN 'corpus' WHEN grouping(file_id) = 1 THEN 'change'
            ELSE 'file' END AS scope, change_id, file_id,
       count(*) AS total_issues, {_COUNTS}, count(*) FILTER (severity = 'critical') > 0 AS has_critical
FROM sec GROUP BY GROUPING SETS ((), (change_id), (change_id, file_id))""",
        "quality_summary": _quality() + f"""
, functions AS (SELECT file_id, {js_functions} AS functions, 0 AS classes FROM src WHERE {SCRIPT}
  UNION ALL SELECT file_id, count(*) FILTER (kind = 'function'), count(*) FILTER (kind = 'class')
  FROM nodes GROUP BY file_id),
found AS (SELECT file_id, count(*) AS total_issues, {_COUNTS},
                 count(*) FILTER (severity = 'info') AS info FROM qual GROUP BY file_id)
SELECT file_id, coalesce(total_issues, 0) AS total_issues, CAST(lines_of_code AS BIGINT) AS lines_of_code,
       CAST(coalesce(functions, 0) AS BIGINT) AS functions, CAST(coalesce(classes, 0) AS BIGINT) AS classes,
       coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
       coalesce(low, 0) AS low, coalesce(info, 0) AS info
FROM sizes LEFT JOIN found USING (file_id) LEFT JOIN functions USING (file_id)""",
        "severity_histogram": _quality()
        + " SELECT severity, count(*) AS findings FROM qual GROUP BY severity",
        "findings_by_tool": _security() + " SELECT tool, count(*) AS findings FROM sec GROUP BY tool",
        "change_severity_histogram": _quality()
        + " SELECT change_id, severity, count(*) AS findings FROM qual GROUP BY change_id, severity",
        "change_findings_by_tool": _security()
        + " SELECT change_id, tool, count(*) AS findings FROM sec GROUP BY change_id, tool",
        "change_totals": _with(f"files AS ({corpora.FILES})") + f"""
SELECT change_id, CAST(sum(additions) AS BIGINT) AS total_additions,
       CAST(sum(deletions) AS BIGINT) AS total_deletions, count(*) AS files_changed
FROM files WHERE {IS_CODE} GROUP BY change_id""",
        "change_quality": _changes()
        + " SELECT change_id, quality_issues, functions, total_additions AS lines_of_code FROM counters",
        "prompt_counts": _changes() + " SELECT change_id, critical, high, quality_medium_high FROM counters",
        "verdict": _changes() + " SELECT change_id, mark, verdict, reason FROM verdicts",
        "ai_gate": _changes() + " SELECT change_id FROM counters WHERE security_issues + quality_issues > 0",
        "first10_security": _security() + _first("sec", ("critical", "high"), 10),
        "first10_quality": _quality() + _first("qual", ("high", "medium"), 10),
        "change_first10_security": _security() + _first("sec", ("critical", "high"), 10, "change_id"),
        "change_first10_quality": _quality() + _first("qual", ("high", "medium"), 10, "change_id"),
        "prompt_files": _with(f"files AS ({corpora.FILES})") + f"""
SELECT change_id, CAST(rank AS INTEGER) AS rank, filename, status, additions, deletions
FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY file_ord) AS rank
      FROM files WHERE {IS_CODE}) WHERE rank <= 10""",
        "prompt_critical": _security() + _first("sec", ("critical",), 5, "change_id"),
        "prompt_quality": _quality() + _first("qual", ("high", "medium"), 5, "change_id"),
        "clean_files": _security()
        + " SELECT file_id, filename FROM src WHERE file_id NOT IN (SELECT file_id FROM sec)",
        "security_panels": _security() + f"""
, tools AS (SELECT change_id, tool, count(*) AS n, min(row(file_ord, phase, rule_ord, pos, match_ord)) AS first
            FROM sec GROUP BY change_id, tool),
listed AS (SELECT change_id, string_agg(concat(tool, ': ', n), ', ' ORDER BY first) AS tools FROM tools GROUP BY change_id)
SELECT change_id, concat('Security Issues (', count(*), ' total)') AS title,
       concat('Critical: ', count(*) FILTER (severity = 'critical'), {NEWLINE}, 'High: ', count(*) FILTER (severity = 'high'), {NEWLINE},
              'Medium: ', count(*) FILTER (severity = 'medium'), {NEWLINE}, 'Low: ', count(*) FILTER (severity = 'low'),
              {NEWLINE}, {NEWLINE}, 'Tools: ', any_value(tools)) AS panel
FROM sec JOIN listed USING (change_id) GROUP BY change_id""",
        "quality_panels": _quality() + f"""
SELECT change_id, concat('Quality Issues (', count(*), ' total)') AS title,
       concat('High: ', count(*) FILTER (severity = 'high'), {NEWLINE}, 'Medium: ', count(*) FILTER (severity = 'medium'), {NEWLINE},
              'Low: ', count(*) FILTER (severity = 'low'), {NEWLINE}, 'Info: ', count(*) FILTER (severity = 'info')) AS panel
FROM qual GROUP BY change_id""",
        "security_listing": _security() + _listing("sec", ("critical", "high"), True),
        "quality_listing": _quality() + _listing("qual", ("high", "medium"), False),
        "report_files": _with(f"files AS ({corpora.FILES})") + f"""
SELECT change_id, file_id, filename, 'semgrep' AS tool, 'high' AS severity, 'r' AS issue, CAST(file_id % 70 AS INTEGER) AS line
FROM files WHERE {IS_CODE}
UNION ALL
SELECT change_id, file_id, filename, 'bandit', 'high', 'B1', CAST(file_id % 90 AS INTEGER)
FROM files WHERE {IS_CODE} AND {EXT} = '.py'""",
        "change_export": _with(f"files AS ({corpora.FILES})", f"changes AS ({corpora.CHANGES})") + """
SELECT c.change_id, author, title,
       CASE WHEN f.file_id IS NOT NULL THEN row_number() OVER (PARTITION BY c.change_id ORDER BY f.file_ord) - 1 END AS file_ord,
       filename, status, additions, deletions
FROM changes c LEFT JOIN files f USING (change_id) WHERE c.change_id % 17 <> 3""",
        "change_rejects": f"""
SELECT concat('{{"change_id": ', change_id, ', "title": "cut') AS text FROM ({corpora.CHANGES}) WHERE change_id % 17 = 3""",
        "change_content": _change_content(),
        "snapshot_diff": _snapshot_diff(),
        "change_header": _with(f"files AS ({corpora.FILES})", f"changes AS ({corpora.CHANGES})") + f"""
, changed AS (SELECT change_id, sum(additions) AS adds, sum(deletions) AS dels, count(*) AS n
  FROM files WHERE {IS_CODE} GROUP BY change_id)
SELECT change_id, concat('Title: ', coalesce(title, ''), chr(10), 'Author: ', author, chr(10),
       'Files Changed: ', coalesce(n, 0), chr(10), 'Changes: +', coalesce(adds, 0), ' -', coalesce(dels, 0))
       AS header
FROM changes LEFT JOIN changed USING (change_id)""",
        "summary_markdown": _changes() + " SELECT change_id, "
        + _template(catalog.SUMMARY_TEXT, lines_of_code="total_additions") + " AS summary FROM verdicts",
        "review_output": _changes() + f", changes AS ({corpora.CHANGES}), summed AS (SELECT change_id, "
        + _template(catalog.SUMMARY_TEXT, lines_of_code="total_additions") + " AS summary FROM verdicts)" + f"""
SELECT change_id, CASE WHEN change_id % 3 = 0 AND author IS NOT NULL
       THEN concat(summary, {NEWLINE}, {NEWLINE}, 'Review of ', author) ELSE summary END AS text
FROM summed LEFT JOIN changes USING (change_id)""",
        "review_prompt": _review_prompt(),
        "file_prompt": _with(_files()) + " SELECT file_id, filename, " + _template(
            catalog.FILE_PROMPT, context_line="CASE WHEN file_id % 2 = 0 THEN "
            "concat('Context: change ', change_id) ELSE '' END") + " AS prompt FROM src",
        "snippet_prompt": _security() + " SELECT file_id, issue, line, " + _template(
            catalog.SNIPPET_PROMPT, issue_type="'security'") + " AS prompt FROM sec WHERE code IS NOT NULL",
        "stream_scan": _stream() + " SELECT file_id, severity, issue, line, code, matched FROM found",
        "stream_first10": _with(_files(), f"sec AS ({all_rule_hits()} UNION ALL {file_check_hits()})")
        + _first("sec", ("critical", "high"), 10, "change_id"),
        "stream_windows": _stream() + """
SELECT strftime(ts, '%Y-%m-%d') AS day, severity, count(*) AS findings FROM found GROUP BY ALL""",
    }
    return found
