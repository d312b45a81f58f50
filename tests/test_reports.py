import json

import pytest

from reviewlake.operators import reports, summaries
from reviewlake.sources import reports as source


def report_rows(spark, rows):
    texts = [(at, tool, r if isinstance(r, str) else json.dumps(r)) for at, tool, r in rows]
    return spark.createDataFrame(texts, "file_id long, tool string, report string")


def test_bandit_and_semgrep_findings(spark, make_files, hits):
    files = make_files([("a.py", "x"), ("b.js", "x"), ("c.txt", "x")])
    bandit = {"results": [
        {"issue_severity": "high", "test_id": "B602", "issue_text": "t", "line_number": 4, "code": " c\n",
         "issue_confidence": "LOW", "more_info": ""},
        {"issue_severity": "odd", "more_info": "https://example.org"},
        {"test_id": "B000"},
    ]}
    semgrep = {"results": [
        {"check_id": "r", "start": {"line": 2}, "extra": {"severity": "ERROR", "message": "m", "lines": " l ",
         "metadata": {"references": ["u", "v"], "cwe": ["79"]}}},
        {"extra": {"severity": "Strange", "metadata": {"references": [], "cwe": ["89", "x"], "owasp": ["A1"]}}},
        {"extra": {"metadata": {"cwe": [], "owasp": "A3"}}},
        {},
    ]}
    table = report_rows(spark, [
        (0, "bandit", bandit), (0, "semgrep", semgrep), (1, "bandit", bandit), (1, "semgrep", "{bad"),
        (1, "semgrep", {"errors": []}), (2, "semgrep", semgrep), (0, "other", bandit), (9, "semgrep", semgrep),
    ])
    found = reports.tool_findings(table, files)
    assert hits(found.where("tool = 'bandit'"), "pos", "severity", "issue", "description", "line", "code",
                "confidence", "recommendation", "filename") == [
        (0, "high", "B602", "t", 4, "c", "LOW", "Avoid shell=True in subprocess calls", "a.py"),
        (1, "medium", "Unknown", "Security issue detected", None, "", "MEDIUM", "See: https://example.org", "a.py"),
        (2, "low", "B000", "Security issue detected", None, "", "MEDIUM",
         "Review security best practices for this pattern", "a.py"),
    ]
    assert hits(found.where("tool = 'semgrep'"), "pos", "severity", "issue", "description", "line", "code",
                "recommendation") == [
        (0, "high", "r", "m", 2, "l", "See: u"),
        (1, "strange", "Unknown", "Security pattern detected", None, "", "Related to CWE-89; OWASP: A1"),
        (2, "low", "Unknown", "Security pattern detected", None, "", "OWASP: A3"),
        (3, "low", "Unknown", "Security pattern detected", None, "",
         "Follow security best practices to address this finding"),
    ]
    summary = summaries.tool_summary(found.where("tool = 'semgrep'")).first()
    assert summary.by_tool == {"bandit": 0, "semgrep": 4}
    assert (summary.total_issues, summary.high, summary.low, summary.has_high, summary.has_critical) == (
        4, 1, 2, True, False)


BANDIT_TREE = {"results": [
    {"filename": "./src/a.py", "test_id": "B1", "line_number": 1}, {"filename": "/repo/src/b.py", "test_id": "B2", "line_number": 2},
    {"filename": "src/a.py", "test_id": "B3"}, {"filename": "src/none.py", "test_id": "B4"}, {"test_id": "B5"},
    {"filename": "src/c.js", "test_id": "B6"},
]}
SEMGREP_TREE = {"results": [{"path": "src/c.js", "check_id": "S1"}, {"path": "src/a.py", "check_id": "S2", "start": {"line": 9}}]}


def test_report_over_a_tree_gives_each_file_its_own(spark, make_files, hits):
    pairs = [("src/a.py", "x"), ("src/b.py", "x"), ("src/c.js", "x"), ("whole.py", "x")]
    table = spark.createDataFrame(
        [("whole.py", 1, "bandit", json.dumps(BANDIT_TREE)), ("s.json", 1, "semgrep", json.dumps(SEMGREP_TREE)),
         ("s.json", 2, "semgrep", json.dumps(SEMGREP_TREE)), ("x", None, "semgrep", json.dumps(SEMGREP_TREE))],
        "filename string, change_id long, tool string, report string")
    files = make_files(pairs, 1).unionByName(make_files(pairs[:1], 2))
    found = reports.tool_findings(table, files, root="/repo/")
    assert hits(found, "change_id", "filename", "issue", "line") == sorted([
        (1, "src/a.py", "B1", 1), (1, "src/a.py", "B3", None), (1, "src/b.py", "B2", 2), (1, "whole.py", "B5", None),
        (1, "src/c.js", "S1", None), (1, "src/a.py", "S2", 9), (2, "src/a.py", "S2", 9)], key=repr)
    with pytest.raises(ValueError, match="change_id"):
        reports.tool_findings(table.drop("change_id"), files)
    alone = reports.tool_findings(table.where("change_id = 1").drop("change_id"), files.where("change_id = 1").drop("change_id"))
    assert alone.count() == 5  # without the root, b.py is not known by its long name


def test_reports_from_folders_of_changes(spark, make_files, tmp_path, hits):
    for change in (1, 2):
        (tmp_path / f"change_id={change}").mkdir()
        (tmp_path / f"change_id={change}/tree.json").write_text(json.dumps(SEMGREP_TREE))
    table = source.read_reports(spark, str(tmp_path), "semgrep")
    files = make_files([("src/a.py", "x"), ("src/c.js", "x")], 1).unionByName(make_files([("src/a.py", "x")], 2))
    assert hits(reports.tool_findings(table, files), "change_id", "filename", "issue") == [
        (1, "src/a.py", "S2"), (1, "src/c.js", "S1"), (2, "src/a.py", "S2")]
