import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake import catalog
from reviewlake.functions.regex import java_pattern

TOKENS = [
    "password", "PASSWD", "pwd", "=", " = ", '"', "'", "abc", "api_key", "API-KEY", "access_token",
    "k" * 20, "execute", "cursor.execute", "(", ")", "+", "%", "x1", " ", "os.system", "eval", "exec",
    "open", "os.path.join", "user", "import", "from", "random", "DEBUG", "True", "app.debug",
    "pickle.loads", "yaml.load(", "md5", "Sha1", "DES", "des", "RC4", "@app.route", "methods", "POST",
    "csrf", "var", "x==y", "==", "===", "!=", "<=", "console.log", "console.warn", "TODO:", "fixme:",
    "42", "1.", ".5", "0", "100", "1.0", "0x1F", "1e5", "v2", "é", "ſ", "İ", "K", " ",
    " ", "\r", "\t", "\x1c", "١", "_", "-", ".", "#", "function f", "const f = (a) =>",
    "async function", ".innerHTML", "SELECT", "*", "aab", "k{", "{x}", "xyy", "\x0b", "\x0c", "ß", "ẞ", "ẞx", "ßx",
]
CASES = [(rule.name, rule.pattern, True, 0) for rule in catalog.RULES] + [
    ("var", catalog.VAR_PATTERN, False, 0), ("equality", catalog.LOOSE_EQUALITY_PATTERN, False, 0),
    ("todo", catalog.TODO_PATTERN, True, 0), ("number", catalog.NUMBER_PATTERN, False, 1),
    ("console", catalog.CONSOLE_PATTERN, False, 0), ("eval", catalog.EVAL_PATTERN, False, 0),
    ("html", catalog.INNER_HTML_PATTERN, False, 0), ("star", catalog.SELECT_STAR_PATTERN, True, 0),
    ("class", r"[^]\w]+[[&\s]?", False, 0), ("edges", r"\B\w|\w\b|\d\Z", True, 0),
    ("named", r"(?P<q>[\"'])x(?P=q)", False, 0),
    ("upto", "a{,2}b|x{1}y{2,}", False, 0), ("brace", "k{|{x}|(?#note)%", False, 0), ("tab", r"\v|[\v_]", False, 0),
    ("sharp", "ß|[ẞ]x", True, 0),
    *[(f"function{at}", p, False, 0) for at, p in enumerate(catalog.SCRIPT_FUNCTION_PATTERNS)],
]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choices(TOKENS, k=rng.randint(1, 9))) for _ in range(6000)})
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).cache()


def test_same_matches_as_python(lines):
    found = lines.select("t", *[
        F.regexp_extract_all("t", F.lit(java_pattern(p, ignore_case=i)), F.lit(g)).alias(name)
        for name, p, i, g in CASES
    ]).collect()
    for name, pattern, ignore, group in CASES:
        compiled = re.compile(pattern, re.I if ignore else 0)
        for row in found:
            assert row[name] == [m.group(group) for m in compiled.finditer(row.t)], (name, row.t)


def test_line_starts_as_in_python(spark):
    texts = ["a\n\nb\n", "a\n", "\n", "", "a\r\n\x0bb", "\n\na"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"^$", r"^\s*$", r"^.", r"\w$", r"x|^"):
        java = F.lit(java_pattern(pattern, ignore_case=True, multiline=True))
        for row in rows.select("t", F.regexp_count("t", java).alias("n")).collect():
            assert row.n == len(re.findall(pattern, row.t, re.I | re.M)), (pattern, row.t)


@pytest.mark.parametrize("pattern", [r"[a\W]", r"(a)?(?(1)b|c)"])
def test_unsupported_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_literals_are_in_every_match(lines):
    for rule in catalog.RULES:
        compiled = re.compile(rule.pattern, re.I)
        for row in lines.where(F.length("t") == F.octet_length("t")).collect():
            for match in compiled.finditer(row.t):
                assert any(part in match.group(0).lower() for part in rule.literals), rule.name
