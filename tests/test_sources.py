import json
import re
import time
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from reviewlake.catalog import Rule
from reviewlake.functions import text
from reviewlake.operators import python_structure, reports as report_operators
from reviewlake.operators.python_structure import python_trees
from reviewlake.plans import review
from reviewlake.sources import changes, files, reports, rules, snapshots
from reviewlake.sources.corpus import read_corpus, write_corpus


def test_folder_to_files_and_rejects(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"x\r\ny\rz")
    (tmp_path / "src/b.sql").write_bytes(b"\xc3\x28")
    (tmp_path / "c.txt").write_bytes(b"x")
    raw = files.read_folder(spark, str(tmp_path))
    found = files.source_files(raw).collect()
    assert [(r.filename, r.content, r.ext, r.status, r.patch) for r in found] == [
        ("src/a.py", "x\ny\nz", ".py", "review", "")]
    assert {(r.filename, r.reason) for r in files.skipped_files(raw).collect()} == {
        ("src/b.sql", "not UTF-8"), ("c.txt", "not a code file")}
    wanted = spark.createDataFrame([("gone.py", 0), ("src/a.py", 1)],
                                   "filename string, file_ord long")
    assert [r.filename for r in files.missing_files(wanted, raw).collect()] == ["gone.py"]
    assert [r.file_ord for r in files.source_files(files.listed_files(wanted, raw)).collect()] == [1]


def test_content_at_head(spark):
    changed = spark.createDataFrame(
        [(1, "a.py", "modified", None), (1, "b.py", "removed", "p"), (1, "c.py", "added", ""),
         (1, "d.md", "added", ""), (1, "e.py", "added", "")],
        "change_id long, filename string, status string, patch string")
    stored = spark.createDataFrame(
        [(1, "a.py", b"x\r\n"), (1, "b.py", b"y"), (2, "e.py", b"z"), (1, "c.py", b"\xff")],
        "change_id long, filename string, data binary")
    rows = changes.with_head_content(changes.changed_code_files(changed), stored)
    assert {(r.filename, r.content, r.decode_error, r.patch) for r in rows.collect()} == {
        ("a.py", "x\r\n", False, ""), ("b.py", None, False, "p"), ("c.py", None, True, ""),
        ("e.py", None, False, "")}


def test_exports(spark, tmp_path):
    path = str(tmp_path / "changes")
    spark.createDataFrame([(1, "t", "2024-01-02T03:04:05Z")], "change_id long, title string, created_at string"
                          ).write.json(path)
    row = changes.read_changes(spark, path, "json").first()
    assert (row.title, row.created_at.isoformat(), row.author) == ("t", "2024-01-02T03:04:05", None)


def test_local_changes(spark):
    def tree(**texts):
        return spark.createDataFrame([(f"{n}.py", t) for n, t in texts.items()] + [("n.txt", str(texts))],
                                     "filename string, content string")

    head = tree(same="1", staged="1", both="1", gone="1", unstaged="1", unindexed="1")
    index = tree(same="1", staged="2", both="2", gone="1", unstaged="1", new="1")
    work = tree(same="1", staged="2", both="3", unstaged="2", new="1", untracked="1", unindexed="1")
    rows = snapshots.local_changes(head, index, work).orderBy("file_ord").collect()
    assert [(r.filename, r.stage, r.content) for r in rows] == [
        ("both.py", 0, "3"), ("new.py", 0, "1"), ("staged.py", 0, "2"), ("unindexed.py", 0, "1"),
        ("both.py", 1, "3"), ("gone.py", 1, None), ("unstaged.py", 1, "2")]
    assert {(r.status, r.patch) for r in rows} == {("modified", "")}


def test_local_changes_of_files_without_text(spark):
    def tree(**texts):
        return spark.createDataFrame([(f"{n}.py", t) for n, t in texts.items()], "filename string, content string")

    rows = snapshots.local_changes(tree(a=None, b="1"), tree(a=None, b=None, c=None), tree(a=None, b=None, c="1")).collect()
    assert sorted((r.filename, r.stage, r.content) for r in rows if r.content is None) == [("b.py", 0, None)]
    assert sorted((r.filename, r.stage) for r in rows) == [("b.py", 0), ("c.py", 0), ("c.py", 1)]


def test_rules_of_a_table(spark):
    def table(*rows):
        return spark.createDataFrame([(*row, "text", "advice", None, None) for row in rows], rules.RULES)

    found = rules.rules_from_table(table(("b", r"^x{,2}", "high"), ("a", "y", "low")))
    assert [(r.name, r.severity, r.extensions, r.multiline) for r in found] == [
        ("a", "low", None, False), ("b", "high", None, False)]
    for wrong in (("a", "x", "odd"), ("a", None, "low"), ("a", r"(a)(?(1)b|c)", "low"), ("a", "(?<=a*)b", "low")):
        with pytest.raises((ValueError, re.error)):
            rules.rules_from_table(table(wrong))
    with pytest.raises(ValueError):
        rules.rules_from_table(table(("a", "x", "low"), ("a", "y", "low")))
    with pytest.raises(ValueError):
        Rule("a", "x", "low", "text", "advice", literals=("DEBUG",))


def test_corpus_by_suffix_is_pushed_down(spark, make_files, tmp_path):
    rows = make_files([("c.md", "x"), ("a.py", "def f(): pass"), ("b.js", "var a = 1"), ("d", "y")])
    path = str(tmp_path / "corpus")
    write_corpus(rows.coalesce(1), path)
    files = read_corpus(spark, path, rows.schema)
    assert [(r.filename, r.ext) for r in files.collect()] == [
        ("d", ""), ("b.js", ".js"), ("c.md", ".md"), ("a.py", ".py")]
    trees = python_trees(files)
    assert [r.filename for r in trees.collect()] == ["a.py"]
    with redirect_stdout(StringIO()) as plan:
        trees.explain("formatted")
    assert "EqualTo(ext,.py)" in plan.getvalue()


def test_report_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results":\n []}')
    row = reports.read_reports(spark, str(tmp_path), "bandit").first()
    assert (row.filename, row.tool, row.report) == ("a.json", "bandit", '{"results":\n []}')


def test_folder_review_and_reports_from_disk(spark, tmp_path):
    root = tmp_path / "out"  # a name that would reject a file below it
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("password = 'abcdefgh'\n")
    (root / "build").mkdir()
    (root / "build" / "b.py").write_text("password = 'abcdefgh'\n")
    sources = files.source_files(files.read_folder(spark, str(root)))
    assert [r.filename for r in sources.collect()] == ["src/a.py"]
    assert review.review_files(sources).security_summary.first().high == 1
    made = tmp_path / "reports"
    made.mkdir()
    (made / "1.json").write_text(json.dumps({"results": [{
        "filename": "src/a.py", "issue_severity": "HIGH", "test_id": "B105", "issue_text": "t", "line_number": 1}]}))
    (made / "2.json").write_text('{"results": []}')
    found = report_operators.tool_findings(reports.read_reports(spark, str(made), "bandit"), sources)
    assert [(r.filename, r.tool) for r in found.collect()] == [("src/a.py", "bandit")]


def test_strip_is_linear(spark):
    line = spark.createDataFrame([("x" + " " * 100_000 + "y",)], "s string")
    start = time.time()
    assert line.select(text.strip(F.col("s")).alias("s")).first().s == line.first().s
    assert time.time() - start < 10


def test_one_parse_per_file(make_files):
    counts = python_structure.python_counts(python_structure.python_trees(make_files([("a.py", "def f(): pass")])))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_nested_export(spark, tmp_path, hits):
    lines = [
        '{"change_id": 1, "title": "a", "created_at": "2024-01-02T03:04:05Z", "files": [{"filename": "b.py", "status": "added", '
        '"additions": 3}, {"filename": "a.py"}, {"status": "odd"}], "more": [1]}',
        '{"change_id": 2, "files": []}', "", "   ", '{"change_id": 3, "files": [', '{"title": "no id"}', "[1, 2]", "text",
        '{"change_id": "x", "files": []}', '{"change_id": 4}',
    ]
    (tmp_path / "a.json").write_text("\n".join(lines[:5]))
    (tmp_path / "b.json").write_text("\n".join(lines[5:]) + "\n")
    found = changes.read_export(spark, str(tmp_path))
    assert hits(found.changes, "change_id", "title") == [(1, "a"), (2, None), (4, None)]
    assert str(found.changes.where("change_id = 1").first().created_at) == "2024-01-02 03:04:05"
    assert hits(found.files, "change_id", "file_ord", "filename", "status", "additions") == [
        (1, 0, "b.py", "added", 3), (1, 1, "a.py", None, None)]
    assert sorted(r.text for r in found.rejects.collect()) == sorted([lines[4], lines[5], lines[6], lines[7], lines[8]])
    assert found.files.select("file_id").distinct().count() == 2


def test_snapshots_are_hashed_once(spark, tmp_path):
    for name in ("head", "index", "work"):
        spark.createDataFrame([("a.py", name)], "filename string, content string").write.parquet(str(tmp_path / name))
    trees = [spark.read.parquet(str(tmp_path / name)) for name in ("head", "index", "work")]
    plan = snapshots.changed_names(*trees)._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert initial.count("FileScan parquet") == 3 and initial.count("Exchange hashpartitioning") == 1
