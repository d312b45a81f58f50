import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake import catalog
from reviewlake.catalog import Rule
from reviewlake.operators import scan

LINES = [
    "import random", 'password = "a1"', "api_key = '" + "k" * 24 + "'", 'os.system("ls " + name)',
    'cursor.execute("q" + v)', "x = 42; y = 43", "  # TODO: a", "// fixme: b", "app.debug = True",
    "md5(sha1(x))", '  @app.route("/a", methods=["POST"])', '@app.route("/a", methods=["POST"]) # csrf',
    "pickle.loads(b)", "eval(a + b) and exec(c + d)", "console.log(a); console.info(b)", "var a = 1; var",
    "b = 2", "", "   ", "a ==", "== b", "a==b==c", "if (a === b) {}", "x" * 120, "y" * 121,
    "SELECT  * FROM t", "// 42", "# 42", "0x1F 1e5 v2", "1.foo", "unsafe", "Flask(a)", "ssl_context",
    "node.innerHTML == a", "é = 7", "paſſword = 'é'", "\tvar\t", "z",
]
EXTENSIONS = [".py", ".js", ".ts", ".sql", ".sh", ".rb", ".java", ".html"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(17)
    return [
        (f"src/f{at}{rng.choice(EXTENSIONS)}", "\n".join(rng.choices(LINES, k=rng.randint(1, 14))))
        for at in range(600)
    ]


def expected_security(name, content):
    ext = name[name.rindex("."):]
    out = []
    for rule in catalog.RULES:
        if rule.extensions and ext not in rule.extensions:
            continue
        for number, line in enumerate(content.split("\n"), 1):
            for match in re.finditer(rule.pattern, line, re.I):
                code = line if rule.multiline else line.strip()
                out.append((rule.name, rule.severity, number, code, match.group(0)))
    script = ext in catalog.SCRIPT_EXTENSIONS
    whole = [
        ("unsafe_pickle", "high", ext == ".py" and "pickle" in content and "safe" not in content.lower()),
        ("missing_https", "medium",
         ext == ".py" and "Flask" in content and "ssl_context" not in content),
        ("eval_usage", "high", script and re.search(r"\beval\s*\(", content)),
        ("innerHTML_xss", "medium", script and re.search(r"\.innerHTML\s*=", content)),
        ("select_star", "low", ext == ".sql" and re.search(r"SELECT\s+\*", content, re.I)),
    ]
    return out + [(issue, severity, None, None, None) for issue, severity, hit in whole if hit]


def expected_quality(name, content):
    ext, lines, out = name[name.rindex("."):], content.split("\n"), []

    def line_of(match):
        return content.count("\n", 0, match.start()) + 1

    if ext in catalog.SCRIPT_EXTENSIONS:
        for issue, pattern in (("console_log", catalog.CONSOLE_PATTERN), ("var_usage", catalog.VAR_PATTERN),
                               ("loose_equality", catalog.LOOSE_EQUALITY_PATTERN)):
            out += [(issue, line_of(match), None) for match in re.finditer(pattern, content)]
    for number, line in enumerate(lines, 1):
        if len(line) > 120:
            out.append(("long_line", number, None))
        if re.search(catalog.TODO_PATTERN, line, re.I):
            out.append(("todo_comment", number, line.strip()))
        numbers = [n for n in re.findall(r"\b(\d+\.?\d*)\b", line) if n not in catalog.ALLOWED_NUMBERS]
        if numbers and not line.strip().startswith("#"):
            out.append(("magic_number", number, None))
    stripped = [line.strip() for line in lines if line.strip()]
    mark = "#" if ext in (".py", ".sh") else "//"
    if stripped and sum(line.startswith(mark) for line in stripped) / len(stripped) > 0.3:
        out.append(("high_comment_ratio", None, None))
    return out


def test_security_like_a_plain_restatement(make_files, hits, corpus):
    found = hits(scan.security_findings(make_files(corpus)),
                 "filename", "issue", "severity", "line", "code", "matched")
    wanted = [(name, *hit) for name, content in corpus for hit in expected_security(name, content)]
    assert found == sorted(wanted, key=repr)


def test_quality_like_a_plain_restatement(make_files, hits, corpus):
    found = hits(scan.text_quality_findings(make_files(corpus)), "filename", "issue", "line", "code")
    wanted = [(name, *hit) for name, content in corpus for hit in expected_quality(name, content)]
    assert found == sorted(wanted, key=repr)


def test_both_in_one_pass_is_the_two_together(make_files, hits, corpus):
    files = make_files(corpus)
    columns = ("filename", "type", "issue", "line", "matched", "phase", "rule_ord", "pos", "match_ord")
    apart = scan.security_findings(files).unionByName(scan.text_quality_findings(files))
    assert hits(scan.scan(files), *columns) == hits(apart, *columns)


def test_rules_for_all_files_are_dead_as_coded(make_files, hits):
    files = make_files([("a.rb", 'pwd = "x"\nmd5\nexecute("a" + b)')])
    documented = hits(scan.security_findings(files), "issue")
    coded = hits(scan.security_findings(files, wildcard="as_coded"), "issue")
    assert documented == [("hardcoded_password",), ("sql_injection",), ("weak_crypto",)]
    assert coded == [("sql_injection",)]


def test_empty_missing_and_skipped_files_give_nothing(make_files):
    files = make_files([("a.py", None), ("a.py", ""), ("a.txt", "md5"), ("layout/a.py", "md5")])
    assert scan.scan(files).count() == 0


def test_trailing_newline_and_long_file(make_files, hits):
    files = make_files([("a.html", "a\n" * 499 + "b"), ("b.html", "a\n" * 500)])
    found = hits(scan.text_quality_findings(files), "filename", "issue", "description", "line")
    assert found == [("b.html", "long_file", "File is very long (501 lines)", None)]


def test_descriptions_with_values(make_files, hits):
    files = make_files([("a.py", "#\n" * 5 + "x\n" * 11 + "y = 3. + 1"), ("b.sh", "z" * 121)])
    assert hits(scan.text_quality_findings(files), "filename", "description") == [
        ("a.py", "Magic number 3 found"), ("b.sh", "Line 1 exceeds 120 characters (121)")]
    half = make_files([("a.py", "#\n" * 5 + "x\n" * 11)])
    assert hits(scan.text_quality_findings(half), "description") == [("High comment ratio (31.2%)",)]


def test_marks_in_the_text_itself(make_files, hits):
    content = "a\x01==\x02b\nvar\nx\x01 = 1\n\x02==c"
    found = hits(scan.text_quality_findings(make_files([("a.js", content)])), "issue", "line")
    wanted = expected_quality("a.js", content)
    assert found == sorted([(issue, line) for issue, line, _ in wanted], key=repr)


def test_user_rules_over_lines_and_over_the_text(make_files, hits):
    rules = [
        Rule("pair", r"a\s*\n\s*b", "odd", "d", "r", multiline=True),
        Rule("start", r"^\w+", "low", "d", "r", (".rb",), multiline=True),
        Rule("line", r"(?P<x>b+)", "low", "d", "r"),
    ]
    content = "a\n b\na \x01\nbb a\n\nb"
    found = hits(scan.scan(make_files([("x.rb", content)]), rules, quality=False, whole_file=False),
                 "issue", "line", "code", "matched", "match_ord")
    wanted = []
    for rule in rules:
        lines = content.split("\n")
        if rule.multiline:
            for at, match in enumerate(re.finditer(rule.pattern, content, re.M | re.I)):
                line = content.count("\n", 0, match.start()) + 1
                wanted.append((rule.name, line, lines[line - 1], match.group(0), at))
        else:
            for number, line in enumerate(lines, 1):
                for at, match in enumerate(re.finditer(rule.pattern, line, re.I)):
                    wanted.append((rule.name, number, line.strip(), match.group(0), at))
    assert found == sorted(wanted, key=repr)


def test_a_scan_reads_once_and_does_not_shuffle(make_files, spark, tmp_path):
    path = str(tmp_path / "files")
    make_files([("a.py", "md5")]).withColumn("raw_url", F.lit("u")).write.parquet(path)
    plan = scan.scan(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan and "raw_url" not in plan
    assert plan.count("Generate") == 2


def test_numbers_of_ascii_and_other_lines(make_files):
    """The ASCII way finds what Python's pattern finds, and so does the other one, next to a character beyond ASCII."""
    lines = [f"{a}{n}{b}" for a in ("", "x", "_", ".", " ", "-") for n in ("7", "7.", "7.5", "7.5.6", "100", "1e5", "0x1F", "1_0")
             for b in ("", "x", ".", "_", " 42", ".foo")]
    lines += [f"{line} é" for line in lines] + [f"é{line}" for line in lines] + ["٣", "x٣", "٣.7x"]
    files = make_files([(f"f{at}.js", line) for at, line in enumerate(lines)])
    found = {r.file_id: r.description for r in scan.text_quality_findings(files, [catalog.MAGIC_NUMBER.name]).collect()}
    for at, line in enumerate(lines):
        first = next((n for n in re.findall(catalog.NUMBER_PATTERN, line) if n not in catalog.ALLOWED_NUMBERS), None)
        assert found.get(at) == (None if first is None else catalog.MAGIC_NUMBER.description.format(first)), line
