"""Corpora derived from the driver tables, as SQL text that Spark and DuckDB both run.

Every file, patch or report is built from the columns of one row: no grouping and no shuffle, so a
corpus grows with its table and no key can make one file unbounded.
"""

from __future__ import annotations

import re


def _quoted(text: str) -> str:
    """A SQL string; characters that the engines escape differently are spelled as codes."""
    parts = [
        f"chr({ord(part)})" if part in "\n\t\\'" else f"'{part}'"
        for part in re.split(r"([\n\t\\'])", text) if part
    ]
    return f"concat({', '.join(parts)})" if len(parts) > 1 else (parts[0] if parts else "''")


def pick(selector: str, texts: list[str]) -> str:
    """The text at ``selector`` modulo their number. A pilcrow stands for a line break."""
    listed = _quoted("|".join(text.replace("\n", "¶") for text in texts))
    return f"split_part({listed}, '|', 1 + CAST(({selector}) % {len(texts)} AS INTEGER))"


# Short blocks of lines: each detector, near misses, and plain code. {n} is filled in from the row.
BLOCKS = [
    "import random\nimport os",
    'password = "hunter2{n}"\nuser = "x"',
    'api_key = "kkkkkkkkkkkkkkkkkkkk{n}"',
    'api_key = "short{n}"',
    'os.system("ls " + name)\nos.system("ls")',
    'cursor.execute("select a from t where b = " + value)',
    "x = {n}\ny = 0 + 1 + 100",
    "# TODO: later {n}\n# note\n# another note",
    "app.debug = True\nDEBUG = False",
    "digest = md5(x) + sha1(x)",
    '@app.route("/save", methods=["POST"])\ndef save(): pass',
    '@app.route("/safe", methods=["POST"]) # csrf\nreturn 0',
    "import pickle\ndata = pickle.loads(blob)",
    'handle = open("a" + name)\npath = os.path.join(base, user)',
    "if (a == b) { c() }\nif (a === b) { c() }",
    "console.log(a); console.debug(b)\nconsole.warn(c)",
    "var z = 1;\nvar\n  late = 2;\nvariance = 3",
    "SELECT * FROM t\nselect a from t",
    "// note {n}\n// more\n// FIXME: {n}",
    "return 0\n\n   ",
    "long = first_name_of_a_value + second_name_of_a_value + third_name_of_a_value + "
    "fourth_name_of_a_value + fifth_name_of_a_value + {n}",
    "app = Flask(name)\nresult = eval(text + tail)",
    "node.innerHTML = a\nnode.innerText = b\neval (code)",
    "function go() { }\nconst f = (a, b) => a\nasync function run() { }",
    "a ==\nb\n== c\nx==y==z",
    "\tindented = 7.5\n\t# odd = 42\nv2 = 0x1F + 1e5 + 3.",
    "yaml.load(text)\nyaml.safe_load(text)",
    "pwd = 'single{n}'\nfrom random import choice",
    "def run(a):\n    exec(a)\n    subprocess.call(cmd % args)",
]


def _branches(count: int, name: str) -> str:
    body = "\n".join(f"    if x == {at}:\n        x = x + y" for at in range(count))
    return f"def {name}(x, y):\n{body}\n    return x"


def _long(lines: int, name: str) -> str:
    return f'def {name}(x):\n    """Doc."""\n' + "\n".join(["    x = f(x)"] * (lines - 1))


# Whole Python blocks and what is in them, known by construction:
# (kind, name, line within the block, end line, nesting, complexity, documented).
PY_BLOCKS = [
    ("import random\nimport os", []),
    ('password = "hunter2{n}"\nuser = "x"', []),
    ('api_key = "kkkkkkkkkkkkkkkkkkkk{n}"\nos.system("ls " + name)', []),
    ('cursor.execute("select a from t where b = " + value)\nx = {n}\ny = 0 + 1 + 100', []),
    ("# TODO: later {n}\n# note\n# another note", []),
    ("app.debug = True\napp = Flask(name)\ndigest = md5(x) + sha1(x)", []),
    ('@app.route("/save", methods=["POST"])\ndef save(): pass',
     [("function", "save", 2, 2, 1, 1, False)]),
    ('import pickle\ndata = pickle.loads(blob)\nhandle = open("a" + name)', []),
    ('def short_{n}(x):\n    """Doc {n}."""\n    return x',
     [("function", "short_{n}", 1, 3, 1, 1, True)]),
    (_branches(10, "branchy_{n}"), [("function", "branchy_{n}", 1, 22, 1, 11, False)]),
    (_branches(9, "below_{n}"), [("function", "below_{n}", 1, 20, 1, 10, False)]),
    ('class Box:\n    def get(self):\n        """Doc."""\n        return self.a\n'
     "    def put(self, a):\n        self.a = a or self.b or None",
     [("class", "Box", 1, 6, 1, None, False), ("function", "get", 2, 4, 2, 1, True),
      ("function", "put", 5, 6, 2, 3, False)]),
    ("def outer(x):\n    while x:\n        x = x - 1\n    def inner(y):\n"
     "        for z in y:\n            if z and y:\n                return z\n    return inner",
     [("function", "outer", 1, 8, 1, 5, False), ("function", "inner", 4, 7, 2, 4, False)]),
    (_long(51, "long_{n}"), [("function", "long_{n}", 1, 52, 1, 1, True)]),
    (_long(50, "fits_{n}"), [("function", "fits_{n}", 1, 51, 1, 1, True)]),
    ("async def waits(x):\n    if x:\n        return await x\n    async for y in x:\n        pass", []),
    ('def guarded(x):\n    """ """\n    try:\n        return x if x else eval("1 + " + x)\n'
     "    except ValueError:\n        return None\n    except (KeyError, TypeError):\n        return 0",
     [("function", "guarded", 1, 8, 1, 3, False)]),
    ('class Named:\n    """Doc."""\n    a = [b for b in c if b and c]',
     [("class", "Named", 1, 3, 1, None, True)]),
]
PY_PARTS = 5
BROKEN = "def broken(:"
EXTENSIONS = [
    ".py", ".js", ".ts", ".py", ".sql", ".java", ".php", ".py", ".sh", ".html", ".rb", ".jsx",
]
_STEPS = [7, 11, 13, 17, 19, 23]


def block_selector(key: str, other: str, at: int) -> str:
    return f"{key} * {_STEPS[at]} + {other} * {at + 1} + {at}"


def _join(key: str, parts: list[str], between: str) -> str:
    joined = f"concat({(', ' + between + ', ').join(parts)})"
    return f"replace(replace({joined}, '¶', chr(10)), '{{n}}', CAST({key} AS STRING))"


def _content(key: str, other: str, parts: int = 6) -> str:
    blocks = [pick(block_selector(key, other, at), BLOCKS) for at in range(parts)]
    return _join(key, blocks, "chr(10)")


def is_broken(key: str) -> str:
    return f"{key} % 13 = 5"


def _python_content(key: str, other: str) -> str:
    texts = [text for text, _ in PY_BLOCKS]
    blocks = [pick(block_selector(key, other, at), texts) for at in range(PY_PARTS)]
    joined = _join(key, blocks, "chr(10), chr(10)")
    return f"concat({joined}, CASE WHEN {is_broken(key)} THEN concat(chr(10), '{BROKEN}') ELSE '' END)"


def _extension(key: str) -> str:
    return f"CASE WHEN {key} % 41 = 6 THEN '.TXT' ELSE {pick(key, EXTENSIONS)} END"


def _filename(key: str) -> str:
    folder = (
        f"CASE WHEN {key} % 29 = 3 THEN 'node_modules/' WHEN {key} % 31 = 4 THEN 'layout/' "
        f"WHEN {key} % 37 = 5 THEN '.github/' ELSE 'src/' END"
    )
    return f"concat({folder}, 'f_', CAST({key} AS STRING), {_extension(key)})"


def _any_content(key: str, other: str) -> str:
    return (
        f"CASE WHEN {_extension(key)} = '.py' THEN {_python_content(key, other)} "
        f"ELSE {_content(key, other)} END"
    )


_PATCH_LINES = [
    "+added {n}", "-removed {n}", " kept {n}", "+++i;", "--- j", "+", "-", "",
    "\\ No newline at end of file", "@@ -{n},2 +{n},3 @@ def f():", "@@", "+@@ not a header",
]


def _patch(key: str, other: str) -> str:
    lines = [pick(block_selector(key, other, at), _PATCH_LINES) for at in range(6)]
    lead = f"CASE {key} % 3 WHEN 0 THEN 'index 1..2' WHEN 1 THEN '@@ -1 +1 @@' ELSE '+++ b/x' END"
    return f"concat({lead}, chr(10), {_join(key, lines, 'chr(10)')})"


# One changed file per order; a customer's orders are one change request.
FILES = f"""
SELECT o_custkey AS change_id, o_orderkey AS file_ord, o_orderkey AS file_id,
       {_filename("o_orderkey")} AS filename,
       CASE o_orderkey % 7 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status,
       CAST(CAST(floor(o_totalprice) AS INTEGER) % 90 AS INTEGER) AS additions,
       CAST(CAST(floor(o_totalprice) AS INTEGER) % 40 AS INTEGER) AS deletions,
       CASE WHEN o_orderkey % 43 = 1 THEN NULL WHEN o_orderkey % 47 = 1 THEN ''
            ELSE {_any_content("o_orderkey", "o_custkey")} END AS content
FROM orders
"""

# The patches of the same files.
PATCHES = f"""
SELECT o_orderkey AS file_id,
       CASE WHEN o_orderkey % 43 = 1 THEN NULL WHEN o_orderkey % 47 = 1 THEN ''
            ELSE {_patch("o_orderkey", "o_custkey")} END AS patch
FROM orders
"""

# One change request per customer.
CHANGES = """
SELECT c_custkey AS change_id, 'team/app' AS repo, CAST(c_custkey AS INTEGER) AS number,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('Change for ', c_mktsegment) END AS title,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('Balance "', c_name, '"') END AS description,
       c_name AS author, 'open' AS state, 'main' AS base_branch,
       concat('topic-', CAST(c_custkey AS STRING)) AS head_branch
FROM customer
"""

# One rule per part: an assignment, a function of Python files, a remark in either of two words, or two lines.
PART_RULES = """
SELECT concat('part_', CAST(p_partkey AS STRING)) AS name,
       CASE p_partkey % 4
            WHEN 0 THEN concat(chr(92), 'bx', chr(92), 's*=', chr(92), 's*', CAST(p_partkey + 1000 AS STRING), chr(92), 'b')
            WHEN 1 THEN concat('short_', CAST(p_partkey + 1000 AS STRING), chr(92), 'b')
            WHEN 2 THEN concat('(?:later|note) ', CAST(p_partkey + 1000 AS STRING), chr(92), 'b')
            ELSE concat('later ', CAST(p_partkey + 1000 AS STRING), chr(92), 'n# note') END AS pattern,
       CASE WHEN p_partkey % 4 = 3 THEN 'high' ELSE 'low' END AS severity, p_name AS description,
       p_brand AS recommendation,
       CASE WHEN p_partkey % 4 = 1 THEN array('.py', '.rb') END AS extensions, p_partkey % 4 = 3 AS multiline
FROM part
"""

# Long files: 440 to 560 lines per part.
LONG_FILES = f"""
SELECT p_partkey AS file_id, {_filename("p_partkey")} AS filename,
       concat(repeat(concat('a = b', chr(10)), CAST(440 + (p_partkey * 7) % 120 AS INTEGER)),
              'tail = ', CAST(p_size AS STRING)) AS content
FROM part
"""

# Texts that are written one after the other into a file per size.
PART_TEXTS = f"SELECT p_size, p_partkey, {_content('p_partkey', 'p_size')} AS content FROM part"


def size_name(size: str) -> str:
    return f"concat('src/size_', CAST({size} AS STRING), {pick(size, EXTENSIONS)})"


# What those files hold, for the check SQL.
SIZE_FILES = f"""
SELECT CAST(p_size AS BIGINT) AS file_id, {size_name("p_size")} AS filename,
       concat(string_agg(content, chr(10) ORDER BY p_partkey), chr(10)) AS content
FROM ({PART_TEXTS}) GROUP BY p_size
"""

# The prose, web, chat and benchmark tables as they are, under a source suffix.
RAW_FILES = """
SELECT doc_id AS file_id,
       concat('docs/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.php'
              WHEN 1 THEN '.js' WHEN 2 THEN '.sql' ELSE '.ts' END) AS filename,
       text AS content
FROM documents
UNION ALL
SELECT page_id + 1000000000000 AS file_id,
       concat('pages/', CAST(page_id AS STRING), CASE page_id % 2 WHEN 0 THEN '.js' ELSE '.html' END)
         AS filename,
       html AS content
FROM pages
UNION ALL
SELECT conv_id * 1000000 + turn + 2000000000000 AS file_id,
       concat('chats/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING), '.ts') AS filename, text AS content
FROM conversations
UNION ALL
SELECT item_id + 1000000000000000 AS file_id, concat('items/', CAST(item_id AS STRING), '.php') AS filename,
       text AS content
FROM benchmark
"""

# Files that arrive over time.
ARRIVALS = f"""
SELECT event_id AS file_id, ts, {_filename("event_id")} AS filename,
       {_any_content("event_id", "user_id")} AS content
FROM events
"""

# Bytes as a file source gives them; only Spark builds these. Line breaks of several kinds, and some
# files that are not UTF-8.
RAW_BYTES = """
SELECT doc_id AS file_id, concat('in/d_', CAST(doc_id AS STRING),
         CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.Sql' ELSE '.js' END)
         AS filename,
       CASE WHEN doc_id % 17 = 3 THEN concat(encode(text, 'UTF-8'), X'C328')
            WHEN doc_id % 3 = 1 THEN encode(replace(text, chr(10), concat(chr(13), chr(10))), 'UTF-8')
            WHEN doc_id % 3 = 2 THEN encode(replace(text, '. ', concat('.', chr(13))), 'UTF-8')
            ELSE encode(text, 'UTF-8') END AS data
FROM documents
"""

_BANDIT_ITEMS = [
    '{"issue_severity": "HIGH", "test_id": "B602", "issue_text": "shell {n}", "line_number": {n}, '
    '"code": "  call(x) \\n", "issue_confidence": "HIGH", "more_info": ""}',
    '{"issue_severity": "medium", "test_id": "B301", "line_number": 3, "code": "p", '
    '"more_info": "https://example.org/{n}"}',
    '{"issue_severity": "LOW", "test_id": "B999", "issue_text": "other"}',
    '{"issue_severity": "UNDEFINED", "issue_text": "no id", "line_number": 1}',
    '{"test_id": "B608"}',
]
_SEMGREP_ITEMS = [
    '{"check_id": "rules.a{n}", "start": {"line": {n}}, "extra": {"severity": "ERROR", '
    '"message": "m", "lines": "  a(b) ", "metadata": {"references": ["https://example.org/a", "b"], '
    '"cwe": ["79"]}}}',
    '{"check_id": "rules.b", "start": {"line": 2}, "extra": {"severity": "WARNING", "metadata": '
    '{"references": [], "cwe": ["89: SQL", "x"], "owasp": ["A1", "A2"]}}}',
    '{"check_id": "rules.c", "extra": {"severity": "INFO", "lines": "z", "metadata": '
    '{"owasp": "A03"}}}',
    '{"extra": {"severity": "Critical", "metadata": {"cwe": "20"}}}',
    '{"check_id": "rules.e", "start": {}}',
]


def _report(key: str, items: list[str]) -> str:
    first, second = (pick(f"{key} * {step} + {step}", items) for step in (3, 7))
    full = f"concat('{{\"results\": [', {first}, ', ', {second}, ']}}')"
    return (
        f"CASE {key} % 7 WHEN 0 THEN '{{\"results\": []}}' WHEN 1 THEN '{{\"errors\": []}}' "
        f"WHEN 2 THEN 'not json [' ELSE replace({full}, '{{n}}', CAST({key} % 1000 AS STRING)) END"
    )


# One report of each scanner per event, about the file of the same number.
REPORTS = f"""
SELECT event_id AS file_id, 'bandit' AS tool, {_report("event_id", _BANDIT_ITEMS)} AS report
FROM events
UNION ALL
SELECT event_id AS file_id, 'semgrep' AS tool, {_report("event_id", _SEMGREP_ITEMS)} AS report
FROM events
"""

# One report of each scanner per change request, over all of its files, which the items name in two spellings.
TREE_REPORTS = f"""
SELECT change_id, tool, concat('{{"results": [', array_join(collect_list(item), ', '), ']}}') AS report
FROM (SELECT change_id, 'bandit' AS tool, concat('{{"filename": "./', filename, '", "test_id": "B1", "issue_severity": "HIGH", '
               '"line_number": ', CAST(file_id % 90 AS STRING), '}}') AS item FROM ({FILES})
      UNION ALL
      SELECT change_id, 'semgrep' AS tool, concat('{{"path": "', filename, '", "check_id": "r", "start": {{"line": ',
               CAST(file_id % 70 AS STRING), '}}, "extra": {{"severity": "ERROR", "lines": "x"}}}}') AS item FROM ({FILES}))
GROUP BY change_id, tool
"""

# Exported changes with their files nested; some lines are cut off.
EXPORTED = f"""
SELECT CASE WHEN change_id % 17 = 3 THEN concat('{{"change_id": ', CAST(change_id AS STRING), ', "title": "cut')
            ELSE to_json(struct(change_id, max(author) AS author, max(title) AS title,
                 transform(array_sort(collect_list(file)), f -> struct(f.filename, f.status, f.additions, f.deletions)) AS files))
       END AS value
FROM (SELECT c.change_id, author, title, CASE WHEN f.file_ord IS NOT NULL THEN
             struct(f.file_ord, f.filename, f.status, f.additions, f.deletions) END AS file
      FROM ({CHANGES}) c LEFT JOIN ({FILES}) f ON f.change_id = c.change_id)
GROUP BY change_id
"""

# Three states of one tree: 0 is HEAD, 1 the index, 2 the work tree.
IN_SNAPSHOT = ["doc_id % 10 <> 0", "doc_id % 11 <> 3 AND doc_id % 17 <> 5", "doc_id % 13 <> 4"]
STAGED, EDITED = "doc_id % 7 = 1", "doc_id % 5 = 2"
SNAPSHOT_NAME = (
    "concat('src/d_', CAST(doc_id AS STRING), "
    "CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.sql' END)"
)
SNAPSHOT_CONTENT = [
    "text",
    f"concat(text, CASE WHEN {STAGED} THEN ' staged' ELSE '' END)",
    f"concat(text, CASE WHEN {STAGED} THEN ' staged' ELSE '' END, "
    f"CASE WHEN {EDITED} THEN ' edited' ELSE '' END)",
]


def snapshot(at: int) -> str:
    return (
        f"SELECT {SNAPSHOT_NAME} AS filename, {SNAPSHOT_CONTENT[at]} AS content\n"
        f"FROM documents WHERE {IN_SNAPSHOT[at]}"
    )
