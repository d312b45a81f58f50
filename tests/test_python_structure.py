import ast

import pyarrow as pa
import pytest

from reviewlake.operators import python_structure as structure, quality, summaries

SNIPPETS = [
    "def a():\n    pass",
    'def a():\n    ""\n    if x and y or z: pass\n    elif w: pass\n    else:\n        while 1: pass',
    "class A:\n    'doc'\n    def f(self):\n        for i in x:\n            def g():\n                if i: return 1\n"
    "        try: pass\n        except A: pass\n        except B: pass",
    "async def a():\n    if x: pass\n    async for i in y: pass\n    def inner():\n        '''doc'''\n        return a if b else c",
    "@deco(lambda: x or y)\ndef a(b=c and d):\n    return [i for i in x if i and j]",
    "match x:\n    case 1:\n        def a(): pass\nclass B:\n    class C:\n        def z(self): pass\n    def y(self): pass",
    "def a():\n    '''   '''\n    return 1",
    "x = 1",
    "def deep():\n    return " + " or ".join(f"a{i}" for i in range(11)),
    "def ten():\n" + "\n".join("    if a: pass" for _ in range(9)),
    "def eleven():\n" + "\n".join("    if a: pass" for _ in range(10)),
    "def fifty():\n" + "    x()\n" * 50,
    "def fiftyone():\n" + "    x()\n" * 51,
]


def expected(content):
    functions = [n for n in ast.walk(ast.parse(content)) if isinstance(n, ast.FunctionDef)]
    rows = []
    for node in functions:
        inside = list(ast.walk(node))
        weight = sum(isinstance(n, (ast.If, ast.While, ast.For, ast.ExceptHandler)) for n in inside)
        weight += sum(len(n.values) - 1 for n in inside if isinstance(n, ast.BoolOp))
        rows.append((node.name, node.lineno, 1 + weight, node.end_lineno - node.lineno,
                     bool(ast.get_docstring(node))))
    return rows


def test_functions_in_walk_order(make_files):
    files = make_files([(f"f{at}.py", s) for at, s in enumerate(SNIPPETS)])
    rows = structure.python_functions(structure.python_trees(files)).orderBy("file_id", "walk_ord").collect()
    found = [(r.file_id, r.function, r.line, r.complexity, r.length, r.documented) for r in rows]
    assert found == [(at, *row) for at, s in enumerate(SNIPPETS) for row in expected(s)]


def test_findings_and_thresholds(make_files, hits):
    files = make_files([(f"f{at}.py", s) for at, s in enumerate(SNIPPETS)])
    found = hits(structure.python_findings(structure.python_trees(files)), "filename", "issue", "description")
    assert [d for _, i, d in found if i == "high_complexity"] == [
        'Function "eleven" has high complexity (11)', 'Function "deep" has high complexity (11)']
    assert [d for _, i, d in found if i == "long_function"] == ['Function "fiftyone" is 51 lines long']
    assert ("f5.py", "missing_docstring", 'Class "C" missing docstring') in found
    assert ("f6.py", "missing_docstring", 'Function "a" missing docstring') in found


def test_syntax_errors_replace_counts(make_files, hits):
    files = make_files([("a.py", "x = 1\ndef b(:\n"), ("b.py", "x = '\0'"), ("c.py", "class C: pass"),
                        ("d.js", "def"), ("e.py", "x = " + "(" * 500)])
    trees = structure.python_trees(files)
    errors = hits(structure.python_findings(trees), "filename", "issue", "severity", "line")
    assert ("a.py", "syntax_error", "critical", 2) in errors
    assert {e[0] for e in errors if e[1] == "syntax_error"} == {"a.py", "b.py", "e.py"}
    assert hits(structure.python_counts(trees), "filename", "functions", "classes") == [("c.py", 0, 1)]


def test_file_metrics_and_quality_summary(make_files, hits):
    files = make_files([("a.py", SNIPPETS[2] + "\n# 42"), ("b.js", "async function f() {}\nconst g = (a) => 1"),
                        ("c.py", "def b(:"), ("d.sql", "a\n")])
    metrics = hits(quality.file_metrics(files), "filename", "lines_of_code", "functions", "classes")
    assert metrics == [("a.py", 10, 2, 1), ("b.js", 2, 3, None), ("c.py", 1, None, None),
                       ("d.sql", 2, None, None)]
    trees = structure.python_trees(files)
    summary = summaries.quality_summary(
        quality.text_metrics(files), structure.python_counts(trees), quality.quality_findings(files, trees))
    assert hits(summary, "file_id", "total_issues", "functions", "classes", "critical", "low") == [
        (0, 2, 2, 1, 0, 2), (1, 0, 3, 0, 0, 0), (2, 1, 0, 0, 1, 0), (3, 0, 0, 0, 0, 0)]


def test_no_shuffle_and_only_python_texts(make_files):
    trees = structure.python_trees(make_files([("a.py", "x")]))
    plan = structure.python_findings(trees)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def _nodes(trees):
    return [tree["nodes"] and [tuple(node.values()) for node in tree["nodes"]] for tree in trees]


def test_statements_that_come_again_are_parsed_once(monkeypatch):
    parse, given = ast.parse, []
    monkeypatch.setattr(ast, "parse", lambda text: given.append(text) or parse(text))
    text = "import os\n@a\n# c\ndef f_{0}(x):\n    return x and {0}\n\nclass C{0}:\n    def g(self):\n        '''{0}'''\n"
    numbers = range(1111, 1999)
    found = structure._parser().func(pa.array([text.format(n) for n in numbers])).to_pylist()
    assert len(given) < 40
    assert _nodes(found) == [
        [("function", f"f_{n}", 4, 5, 0, 0, 1, False), ("class", f"C{n}", 7, 9, 1, 1, 1, False),
         ("function", "g", 8, 9, 2, 1, 1, True)] for n in numbers
    ]


@pytest.mark.parametrize("text", [
    "", "\n", "x = 0b_12\n", "x = 0b1\n", "0o_8", "x = 0xab12\ny = 1.e5\n", "0777", "def f(:\n", "x = 1 + \\\n2\ndef f7(): pass",
    "x = '''\ndef f(): pass\n'''\ndef g(): pass", "a = f(\n1,\n)\ndef q1():\n  for x in y: pass\n", "def f():\n\tpass\r\ndef g():\n\tpass\r",
    "if x:\n  pass\nelse:\n  def f9(): pass\n", "try:\n  pass\nexcept A:\n  class B2: pass\nfinally:\n  class C3: pass\n", "@a\n1", "'\\x4'\ndef f1(): pass",
    "from __future__ import barry_as_FLUFL\n1 <> 2", "def f():\n  x\n y\n", "  x = 1", "x = 1\n  y = 2\ndef f(): pass", "def \u2115a2(): pass", "x = 1\0",
    "match x:\n  case 1:\n    def f8(): return 1 or 2\n", "x = f'{a1!r:>10}'\ndef f33(): '''{5}'''\n", "# c\n\n\nasync def f1(a1, a2):\n  def g5(): pass\n#d",
])
def test_parse_by_statements_equals_that_of_the_text(text):
    whole = text + "\n# __future__"  # such a text is never taken apart
    parts, of_whole = (structure._parser().func(pa.array([each])).to_pylist()[0] for each in (text, whole))
    assert parts == of_whole
