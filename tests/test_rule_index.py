import re

import pytest

from reviewlake.catalog import RULES, Rule
from reviewlake.functions.literals import FOLDED, FOLDED_TO, required_literals
from reviewlake.operators import rule_index, scan
from reviewlake.sources import rules as rule_source

COLUMNS = ("issue", "severity", "file_id", "line", "code", "matched", "description", "recommendation", "rule_ord", "pos",
           "match_ord", "type", "tool", "phase")


@pytest.mark.parametrize("pattern, literals", [
    ("password", ("password",)), (r"PassWord\s*=", ("password",)), (r"(os\.system|ev|exec)\(", ()),
    (r"(os\.system|eval|exec2)\(", ("eval", "exec2", "os.system")), (r"(?:later|note) 1234\b", (" 1234",)),
    (r"a+bcde", ("bcde",)), (r"(?:abcd)+x", ("abcd",)), (r"(?:abcd)*x", ()), (r"(?:abcd)?wxyzz", ("wxyzz",)), (r"ab[cd]ef", ()),
    (r"ab(?=zzzz)cd", ("abcd",)), (r"^im\bport$", ("import",)), (r"\w+", ()), ("Straße", ("stra",)), ("naïveté", ()), ("(ab)(cd)ef", ("abcdef",)),
    (r"abc{3}defg", ("defg",)), ("abcd|", ()), ("x(?:abcd|efgh)y|wxyz", ("abcd", "efgh", "wxyz")),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern, 4) == literals


def test_matches_hold_a_literal():
    """Python's own matches of all given rules hold one of the literals read off the pattern."""
    texts = ['passwd = "x"', "API-key = 'aaaaaaaaaaaaaaaaaaaaaaaa'", "cursor.execute(a + b)", "subprocess.call(x % y)",
             "os.path.join(user)", "open(a+b)", "from random import x", "DEBUG = True", "pickle.loads(x)", "hashlib.md5(x)",
             '@app.route("/a", methods=["POST"])', "ſhell_exec(a + b)", "yaml.load(x)", "new Random()", "sha1 (x)"]
    for rule in RULES:
        own = required_literals(rule.pattern, 3)
        for text in texts:
            for match in re.finditer(rule.pattern, text, re.IGNORECASE):
                folded = match[0].translate(str.maketrans(FOLDED, FOLDED_TO)).lower()
                assert not own or any(literal in folded for literal in own), (rule.name, match[0])


def test_folded_characters_are_all_there_are(spark):
    points = spark.range(128, 0x20000).where("id < 55296 or id >= 57344")
    found = points.selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c").where(r"c rlike '(?iUd)\\A[a-z0-9_]\\z'")
    assert {row.c for row in found.collect()} == set(FOLDED)


TEXTS = [
    ("a.py", 'password = "a"\nPASSWORD="b" # paſsword = "c"\nos.system("x" + y); eval(a + b)\n'),
    ("b.js", "eval(a + b)\nconsole.log(1)\nfirst\n\tsecond third\nfirst second"), ("c.sql", "select 1\n\nfirst\nsecond"),
    ("d.rb", "ﬁrst \U0001f600 open(a + b)"), ("e.py", None), ("f.py", ""), ("g.py", "x" * 5000 + " password = 'q' " + "y" * 5000),
    ("node_modules/h.js", "eval(a + b)"), ("i.py", 'KEY = 1\napi_Key = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"\nfirst\nsecond'),
]
OWN = (
    Rule("two_lines", r"first\s*\n\s*second", "low", "d", "r", None, multiline=True),
    Rule("last_word", r"\w+$", "info", "d", "r", (".sql",), multiline=True),
    Rule("any_word", r"\b\w{3}\b", "info", "d", "r", (".js", ".rb")),
    Rule("either", r"second|third|eval", "info", "d", "r", None),
    Rule("given", r"first\b", "info", "d", "r", None, literals=("first",)),
    Rule("kelvin", r"key\s*=", "low", "d", "r", (".py",)),
)


def test_equals_the_scan(spark, make_files, hits):
    files = make_files(TEXTS)
    rules = (*RULES, *OWN)
    index = rule_index.index_rules(spark, rules)
    assert {rule.name for _, rule in index.open_rules} >= {"last_word", "any_word"} and index.by_text
    wanted = hits(scan.scan(files, rules, quality=False, whole_file=False), *COLUMNS)
    found = rule_index.scan_index(files, index)
    assert hits(found, *COLUMNS) == wanted and len(wanted) > 15
    assert found.schema.simpleString().replace("not null", "") == scan.scan(files, rules, quality=False, whole_file=False).schema.simpleString()


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_plan_is_free_of_the_number_of_rules(spark, make_files, hits):
    files = make_files([("a.py", "call_77()\ncall_4999(); CALL_12(call_77())\ncall_x()"), ("b.js", "call_77()")])
    sizes = []
    for n in (10, 5000):
        rules = [Rule(f"r{i:05}", rf"call_{i}\(", "low", "d", "r", (".py",)) for i in range(n)]
        found = rule_index.scan_index(files, rule_index.index_rules(spark, rules))
        sizes.append(len(_plan(found).splitlines()))
    assert sizes[0] == sizes[1]
    assert hits(found, "issue", "line", "match_ord") == [("r00012", 2, 0), ("r00077", 1, 0), ("r00077", 2, 0), ("r04999", 2, 0)]


def test_large_index_is_joined_without_a_broadcast(spark, make_files, hits):
    files = make_files([("a.py", "call_7()\n" * 50 + "call_8()")])
    rules = [Rule(f"r{i:05}", rf"call_{i}\(", "low", "d", "r") for i in range(50)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = hits(rule_index.scan_index(files, rule_index.index_rules(spark, rules)), "issue", "line")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == sorted([("r00007", i + 1) for i in range(50)] + [("r00008", 51)], key=repr)


def test_no_rules(spark, make_files):
    with pytest.raises(ValueError, match="no rules"):
        rule_index.scan_index(make_files(TEXTS), rule_index.index_rules(spark, []))


def _table(spark, rules):
    rows = [(r.name, r.pattern, r.severity, r.description, r.recommendation, r.extensions and list(r.extensions), r.multiline) for r in rules]
    return spark.createDataFrame(rows, rule_source.RULES)


def test_table_is_filed_by_tasks(spark, make_files, hits, monkeypatch):
    files = make_files(TEXTS + [("j.py", "call_1234567() call_12345()\nx = 54321")])
    many = [Rule(f"r{i:05}", rf"call_{i}\(", "low", "d", "r", (".py",)) for i in range(12000, 13000)] + [
        Rule("n7", r"call_1234567\b", "low", "d", "r"), Rule("n5", r"x\s*=\s*54321\b", "low", "d", "r")]
    table = _table(spark, (*OWN, *many)).repartition(7)
    wanted = rule_index.scan_index(files, rule_index.index_rules(spark, rule_source.rules_from_table(table)))
    wanted = hits(wanted, *COLUMNS)
    # the driver works out no pattern of its own, but for the rules without a literal
    monkeypatch.setattr(rule_index, "check_rules", None)
    found = rule_index.scan_index(files, rule_index.index_table(table))
    assert hits(found, *COLUMNS) == wanted and {"n5", "n7", "r12345", "two_lines"} <= {row[0] for row in wanted}


@pytest.mark.parametrize("wrong, message", [
    (Rule("bad", "abcd(", "low", "d", "r"), "'bad'"), (Rule("bad", "abcd", "odd", "d", "r"), "severity"),
    (Rule("bad", "abcd", "low", None, "r"), "must be given"), (Rule("good", "abcd", "low", "d", "r"), "must differ"),
    (Rule("bad", "(?<=ab*)cdef", "low", "d", "r"), "'bad'"),
])
def test_table_refuses_what_cannot_run(spark, wrong, message):
    with pytest.raises(ValueError, match=message):
        rule_index.index_table(_table(spark, [Rule("good", "good", "low", "d", "r"), wrong]))


def test_lines_and_texts_are_looked_up_in_one_pass(spark, make_files):
    index = rule_index.index_rules(spark, OWN[:1] + OWN[3:5])
    assert index.by_line and index.by_text and not index.open_rules
    plan = _plan(rule_index.scan_index(make_files(TEXTS), index))
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("size", [1, 7, 64])
def test_grams_across_slices_are_found(spark, make_files, hits, monkeypatch, size):
    files = make_files(TEXTS)
    rules = (*RULES, *OWN)
    wanted = hits(scan.scan(files, rules, quality=False, whole_file=False), *COLUMNS)
    monkeypatch.setattr(rule_index, "SLICE", size)
    assert hits(rule_index.scan_index(files, rule_index.index_rules(spark, rules)), *COLUMNS) == wanted


def test_only_places_where_a_gram_begins_are_hashed(monkeypatch):
    """Of a text of 200,000 bytes, the longer hashes are taken of the few places whose first bytes begin a filed gram."""
    import numpy as np
    import pyarrow as pa

    hashed = []
    step = rule_index._step
    monkeypatch.setattr(rule_index, "_step", lambda value, byte: hashed.append(len(value)) or step(value, byte))
    gram = next(rule_index._gram_hashes([pa.RecordBatch.from_pydict({"gram": ["call_123"]})])).to_pylist()[0]
    hashed.clear()

    def table(places, bits):
        held = np.zeros(1 << bits, np.uint8)
        held[places] = 1
        return np.packbits(held, bitorder="little").tobytes()

    class Tables:
        value = [(table([gram["head"]], rule_index.HEAD_BITS),
                  table([(gram["hash"] << skip) % 2**64 >> 64 - 12 for skip in rule_index.PLACES], 12)), (table([], rule_index.HEAD_BITS), table([], 10))]

    content = "x = some_other_name\n" * 10_000 + "y\ncall_123() call_124()"
    batch = pa.RecordBatch.from_pydict({"file_id": [5], "content": [content], "folded": [content]})
    found = pa.Table.from_batches(rule_index._hits([8], [12, 10], Tables)([batch])).to_pylist()
    assert {"file_id": 5, "line_no": 10_002, "unit": "call_123() call_124()", "multiline": False, "hash": gram["hash"]} in found
    assert sum(hashed) < 1000
