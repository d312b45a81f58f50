import random

import pytest
from pyspark.sql import functions as F

from reviewlake.catalog import Rule
from reviewlake.operators import scan
from reviewlake.sources import files as file_source, long_files

COLUMNS = ("filename", "type", "severity", "issue", "description", "line", "code", "matched", "phase", "rule_ord", "pos", "match_ord")
PIECES = ["var", "var x", "a ==", "==", "== b", "=", "", " ", "\t", "eval", "(x)", "eval(y)", ".innerHTML", "= z", "SELECT", "ſelect", "*",
          "x = 42", "# note", "// note", "TODO: x", "var var", "a==b==c", "'pw'", 'password = "x"', "a" * 130, "console.log(1)",
          "pickle", "safe", "Flask", "é\U0001f600", "\r", "word", "}", ";"]


def _content(dice, lines):
    between = dice.choice(["\n", "\n", "\r\n"])
    return between.join(dice.choice(PIECES) for _ in range(lines)) + dice.choice(["", "\n", "\n\n"])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    dice, root = random.Random(11), tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    for at in range(18):
        name = f"src/f{at}{dice.choice(['.py', '.js', '.sql', '.sh', '.JS'])}"
        (root / name).write_bytes(("﻿" * (at % 6 == 0) + _content(dice, 10 + 8 * at)).encode())
    (root / "src/bad.py").write_bytes(b"x = 42\n" * 200 + b"\xc3\x28\n" + b"y = 42\n" * 200)
    (root / "src/readme.txt").write_bytes(b"x\n" * 500)
    (root / "src/small.py").write_bytes(b"x = 42")
    (root / "src/blank.js").write_bytes(b"\n" * 900 + b"var\n" + b"\n" * 900 + b"x")
    (root / "src/words.js").write_bytes(b"var\n" * 400)
    return str(root)


@pytest.mark.parametrize("block, part", [(700, 10), (1 << 20, 50), (1 << 20, 1 << 20)])
def test_parts_find_what_whole_texts_do(spark, folder, hits, block, part):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(block))
        parts = long_files.read_parts(spark, folder, least=50, part_bytes=part).cache()
        n = parts.count()
    finally:
        spark.conf.set(key, before)
    whole = file_source.source_files(file_source.read_folder(spark, folder)).where("filename <> 'src/small.py'").cache()
    texts = {r.filename: r.content for r in whole.collect()}
    own = parts.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("first_line", "content"))).alias("parts")).collect()
    assert {r.filename: "\n".join(p.content for p in r.parts) for r in own} == texts
    for r in own:
        for at, p in enumerate(r.parts):
            assert p.first_line == 1 + sum(q.content.count("\n") + 1 for q in r.parts[:at])
    assert n > len(texts) or part > 1000
    assert hits(scan.scan_parts(parts), *COLUMNS) == hits(scan.scan(whole), *COLUMNS)
    assert hits(scan.scan_parts(parts, security=False), *COLUMNS) == hits(scan.scan(whole, security=False), *COLUMNS)


def test_rejects_and_refusals(spark, folder):
    pieces = long_files.read_pieces(spark, folder, least=50, part_bytes=100)
    skipped = {tuple(r) for r in long_files.skipped_long_files(pieces, folder).collect()}
    assert skipped == {("src/bad.py", "not UTF-8"), ("src/readme.txt", "not a code file")}
    assert long_files.read_pieces(spark, folder).count() == 0
    across = Rule("r", r"a\nb", "low", "d", "r", None, multiline=True)
    with pytest.raises(ValueError, match="whole texts: r"):
        scan.scan_parts(long_files.parts_of(pieces, folder), [across])
