import json
import time

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import listings, render, scan, summaries, verdict
from reviewlake.plans import review
from reviewlake.sinks import reviews


@pytest.fixture(scope="module")
def findings(spark):
    rows = []
    for change, severity, kind, count in [
        (1, "critical", "security", 7), (1, "high", "security", 6), (1, None, "security", 1),
        (2, "odd", "security", 2), (2, "medium", "quality", 3), (2, "critical", "quality", 2),
        (3, "high", "security", 1), (4, "low", "quality", 11),
    ]:
        for at in range(count):
            rows.append((change, change * 100 - at, change, f"f{change}.py", kind, "t" if at else None,
                         severity, "long_function" if kind == "quality" else "issue", "d", at, "c", None, None,
                         "r", 0, 0, at, 0))
    return spark.createDataFrame(
        rows, "change_id long, file_ord long, file_id long, filename string, type string, tool string, "
              "severity string, issue string, description string, line int, code string, matched string, "
              "confidence string, recommendation string, phase int, rule_ord int, pos long, match_ord int")


def test_security_summary(findings):
    row = summaries.security_summary(findings.where("type = 'security'")).first()
    assert (row.total_issues, row.critical, row.high, row.medium, row.low, row.has_critical) == (
        17, 7, 7, 0, 1, True)
    empty = summaries.security_summary(findings.where("false")).first()
    assert (empty.total_issues, empty.critical, empty.has_critical) == (0, 0, False)


def test_rollup_has_three_scopes(findings, hits):
    rows = hits(summaries.security_summary_rollup(findings), "scope", "change_id", "file_id", "total_issues")
    assert ("corpus", None, None, 33) in rows and ("change", 1, None, 14) in rows and ("file", 4, 4, 11) in rows
    assert len(rows) == 9


def test_first_rows_in_discovery_order(findings):
    top = listings.first_security(findings.where("type = 'security'"))
    ranked = [(r.rank, r.file_ord) for r in top.orderBy("rank").collect()]
    assert ranked == sorted(ranked) and ranked[0] == (1, 94) and len(ranked) == 10
    by_change = listings.first_security(findings.where("type = 'security'"), "change_id")
    assert by_change.groupBy("change_id").count().orderBy("change_id").collect() == [(1, 10), (3, 1)]
    plan = by_change._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_histogram_and_tools(findings, hits):
    assert hits(summaries.severity_histogram(findings.where("type = 'quality'")), "severity", "findings") == [
        ("critical", 2), ("low", 11), ("medium", 3)]
    rows = summaries.findings_by_tool(findings.where("change_id = 1")).collect()
    assert [tuple(r) for r in rows] == [("t", 11), ("unknown", 3)]


def test_verdicts_of_all_kinds(spark, findings):
    files = spark.createDataFrame(
        [(c, c, c, f"f{c}.py", "modified", 5 * c, c) for c in (1, 2, 3, 4, 5)] + [(5, 9, 9, "x.txt", "m", 99, 9)],
        "change_id long, file_ord long, file_id long, filename string, status string, additions int, deletions int")
    counters = summaries.change_summary(files, findings)
    rows = {r.change_id: r for r in verdict.with_verdict(counters).collect()}
    assert [rows[c].verdict for c in (1, 2, 3, 4, 5)] == [
        "Request Changes", "Approve with Comments", "Request Changes", "Request Changes",
        "Approve with Comments"]
    assert rows[1].reason.startswith("Critical") and rows[3].reason.startswith("High")
    assert rows[4].reason.startswith("Multiple") and rows[4].functions == 11
    assert (rows[5].files_changed, rows[5].lines_of_code, rows[5].security_issues) == (1, 25, 0)
    assert {r.change_id for r in verdict.needs_review(counters).collect()} == {1, 2, 3, 4}
    assert verdict.needs_review(counters, enabled=False).count() == 0


def test_listing_text(spark, findings):
    row = render.finding_text(findings.where("change_id = 3")).first()
    assert row.listing == "● issue\n  File: f3.py\n  d\n  → r"


CODE = 'password = "é\\"x"\nos.system("a" + b)\n' + "x = 42\n" * 3


@pytest.fixture(scope="module")
def change_review(spark, make_files):
    changes = spark.createDataFrame(
        [(1, None, 'De "scribed"', "ann"), (2, "Two", None, None)],
        "change_id long, title string, description string, author string")
    files = make_files([("a.py", CODE), ("b.js", "var a = b == c"), ("c.md", "md5")]).unionByName(
        make_files([("d.py", "def f(x):\n    '''Doc.'''\n    return x")], change_id=2).selectExpr(
            "change_id", "file_ord + 10 as file_ord", "file_id + 10 as file_id", "filename", "status",
            "additions", "deletions", "content"))
    return review.review_changes(changes, files)


def test_review_prompt(change_review):
    prompts = {r.change_id: r.prompt for r in change_review.prompts.collect()}
    assert list(prompts) == [1]  # change 2 has no findings
    lines = prompts[1].split("\n")
    assert lines[2:6] == ["Pull Request: Untitled", 'Description: De "scribed"', "Author: ann", "Files Changed: 2"]
    parts = prompts[1].split("Files Modified:\n")[1].split("\n\nAutomated Analysis Found:")
    assert json.loads(parts[0]) == [
        {"filename": "a.py", "status": "modified", "additions": 1, "deletions": 0},
        {"filename": "b.js", "status": "modified", "additions": 1, "deletions": 0}]
    assert parts[0] == json.dumps(json.loads(parts[0]), indent=2)
    critical = prompts[1].split("\nCritical Security Issues:\n")[1].split("\n\nHigh Priority")[0]
    assert critical == json.dumps(json.loads(critical), indent=2, ensure_ascii=False)
    assert [list(entry) for entry in json.loads(critical)] == [
        ["tool", "type", "severity", "issue", "description", "filename", "line", "code", "matched",
         "recommendation"]]


def test_verdict_and_summary(change_review):
    rows = {r.change_id: r.summary for r in change_review.summaries.collect()}
    assert "- **Critical**: 1 issues\n- **High**: 1 issues" in rows[1]
    assert rows[1].endswith("❌ **Request Changes** - Critical security issues must be addressed\n")
    assert rows[2].endswith("✅ **Approve with Comments** - Minor issues can be addressed in follow-up\n")
    assert {r.header for r in change_review.headers.where("change_id = 1").collect()} == {
        "Title: \nAuthor: ann\nFiles Changed: 2\nChanges: +2 -0"}


def test_written_reviews(spark, change_review, tmp_path):
    texts = reviews.review_texts(
        change_review.summaries, spark.createDataFrame([(1, "Review.")], "change_id long, review string"))
    for fmt in ("parquet", "json"):
        reviews.write_reviews(texts, str(tmp_path / fmt), fmt)
        rows = {r.change_id: r.text for r in spark.read.format(fmt).load(str(tmp_path / fmt)).collect()}
        assert rows[1].endswith("addressed\n\n\nReview.") and rows[2].endswith("follow-up\n")
    reviews.write_reviews(texts, str(tmp_path / "text"), "text")
    assert spark.read.text(str(tmp_path / "text")).select("change_id").distinct().count() == 2


def test_review_of_files(make_files):
    result = review.review_files(make_files([("a.py", CODE), ("b.py", "def f(:")]))
    assert result.security_summary.first().critical == 1
    assert [r.issue for r in result.first_security.orderBy("rank").collect()] == [
        "hardcoded_password", "command_injection"]
    assert {r.severity: r.findings for r in result.severity_histogram.collect()} == {"low": 3, "critical": 1}
    assert result.first_quality.count() == 0  # critical quality findings are not listed


TEXTS = ["plain", 'quote " and \\ back', "tab\tline\nreturn\rfeed\x0cback\b", "\x00\x01\x1b\x1f\x7f", "é ñ ß İ ſ", "  ￿",
         "\U0001f600 a\U0010ffff\U00010000", "</script>&<>'/", "", "x" * 300 + "é"]


def test_prompt_json_is_that_of_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    written = rows.select("i", render.json_string(F.col("t")).alias("json")).collect()
    assert {r.i: r.json for r in written} == {i: json.dumps(t) for i, t in enumerate(TEXTS)}


def test_prompt_objects_are_those_of_python(spark):
    schema = ("change_id long, rank int, tool string, type string, severity string, issue string, description string, "
              "filename string, line int, code string, matched string, confidence string, recommendation string")
    found = [
        {"tool": "semgrep", "type": "security", "severity": "critical", "issue": "Unknown", "description": "dé \U0001f600",
         "filename": "a.py", "line": None, "code": "", "recommendation": 'say "x"'},
        {"tool": "bandit", "type": "security", "severity": "critical", "issue": "B1", "description": "d", "filename": "a.py",
         "line": 3, "code": "\tx", "confidence": "HIGH", "recommendation": "r"},
        {"tool": "pattern-matcher", "type": "security", "severity": "critical", "issue": "i", "description": "d",
         "filename": "日.py", "recommendation": "r"},
        {"tool": "pattern-matcher", "type": "security", "severity": "critical", "issue": "i", "description": "d",
         "filename": "a.py", "line": 7, "code": "c\\d", "matched": "\x7f", "recommendation": "r"},
    ]
    names = [part.split()[0] for part in schema.split(", ")]
    rows = [(1, at + 1, *(f.get(name) for name in names[2:])) for at, f in enumerate(found)]
    listed = render.json_lists(spark.createDataFrame(rows, schema), render.critical_object(), "found").first().found
    assert listed == json.dumps(found, indent=2)


def test_panels(findings):
    rows = {r.change_id: (r.title, r.panel) for r in render.security_panels(findings.where("type = 'security'")).collect()}
    assert rows[1] == ("Security Issues (14 total)", "Critical: 7\nHigh: 6\nMedium: 0\nLow: 0\n\nTools: t: 11, unknown: 3")
    assert rows[3][0] == "Security Issues (1 total)" and set(rows) == {1, 2, 3}
    rows = {r.change_id: (r.title, r.panel) for r in render.quality_panels(findings.where("type = 'quality'")).collect()}
    assert rows == {2: ("Quality Issues (5 total)", "High: 0\nMedium: 3\nLow: 0\nInfo: 0"),
                    4: ("Quality Issues (11 total)", "High: 0\nMedium: 0\nLow: 11\nInfo: 0")}


def test_contents_are_joined_once(spark, make_files, hits):
    files = make_files([("a.py", None), ("b.js", None), ("c.md", None)])
    listed = files.drop("content").withColumn("patch", F.lit(None).cast("string"))
    contents = spark.createDataFrame(
        [(1, "a.py", b'password = "x"\neval(a + b)'), (1, "b.js", b"var a = 1"), (1, "z.py", b"md5")],
        "change_id long, filename string, data binary")
    headers = spark.createDataFrame([(1, None, None, "ann")], "change_id long, title string, description string, author string")
    result = review.review_changes(headers, listed, contents=contents)
    assert hits(result.findings.written, "filename", "issue") == [
        ("a.py", "command_injection"), ("a.py", "hardcoded_password"), ("a.py", "unsafe_deserialization"), ("b.js", "var_usage")]
    assert result.verdicts.first().verdict and result.prompts.count() == 1
    plan = result.prompts._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" not in plan  # no step looks at the contents again


def test_named_checks_work_out_nothing_else(make_files, hits):
    files = make_files([("a.js", "var a = 42\n// TODO: x"), ("b.py", "x == 1")])
    whole = scan.scan(files)
    for name in ("var_usage", "todo_comment", "magic_number", "high_comment_ratio", "eval_usage"):
        found = scan.scan(files, (), checks=[name])
        assert hits(found, "filename", "issue", "line") == hits(whole.where(F.col("issue") == name), "filename", "issue", "line")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("comment_lines" in plan) == (name == "high_comment_ratio") and ("marked" in plan) == (name == "var_usage")


def test_short_escapes_need_no_step_per_character(spark):
    text = F.concat(F.repeat(F.lit('say "x" \\ or\n'), 30), F.col("id").cast("string"))
    rows = spark.range(0, 20_000, 1, 2).select(text.alias("t")).cache()
    rows.count()
    by_character = F.array_join(F.transform(F.split("t", ""), render._json_character), "")

    def seconds(written):
        start = time.perf_counter()
        rows.select(F.sum(F.length(written))).collect()
        return time.perf_counter() - start

    seconds(render.json_string(F.col("t")))
    assert seconds(render.json_string(F.col("t"))) < seconds(by_character) / 2
