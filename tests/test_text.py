import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from reviewlake import catalog
from reviewlake.functions import text

NAMES = [
    "a.py", "src/a.PY", "a.tar.GZ", ".bashrc", "foo.", "dir.py/foo", "a/b.c/d.JS", "..py", "x/.env.yml",
    "noext", "a b.ts", "é.Py", "layout/a.py", ".github/a.yml", "myenv/a.py", "rebuild/a.py", "src/out/a.js",
    "node_modules/a.js", "a.vue", "a.txt", ".git/config.py", "vendor/x.go", "Vendor/x.go",
]


def test_suffix_is_that_of_a_path(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for row in rows.select("n", text.file_ext(F.col("n")).alias("ext")).collect():
        assert row.ext == PurePosixPath(row.n).suffix.lower(), row.n


def test_code_files(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    kept = {r.n for r in rows.where(text.is_code_file(F.col("n"))).collect()}
    assert kept == {
        "a.py", "src/a.PY", "a/b.c/d.JS", "..py", "x/.env.yml", "a b.ts", "é.Py", ".github/a.yml",
        "a.vue", "Vendor/x.go",
    }


def test_strip_like_python(spark):
    values = ["  a ", "\t\x1c a\x1f\x0b", " a　", "", " \n ", "a​", "\x85a\n\n", "a b"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for row in rows.select("v", text.strip(F.col("v")).alias("s")).collect():
        assert row.s == row.v.strip()


def test_percent_like_python(spark):
    rng = random.Random(3)
    pairs = {(5, 16), (3, 10), (729, 2000), (1, 1), (1, 3)}
    pairs |= {(rng.randint(n // 5 + 1, n), n) for n in (rng.randint(1, 5000) for _ in range(4000))}
    rows = spark.createDataFrame(sorted(pairs), "k int, n int").select(
        "k", "n", text.percent(F.col("k") / F.col("n")).alias("p"))
    for row in rows.collect():
        assert row.p == f"{row.k / row.n:.1%}", row


def test_comment_and_blank_lines(spark):
    rng = random.Random(5)
    parts = ["# a", "// b", "  # c", "\t// d", "", "   ", " ", "x = 1", "\x1c#", "x # y", "\r"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame(
        [(t, e) for t in texts for e in (".py", ".sh", ".js", ".rb")], "t string, e string")
    counted = rows.select("t", "e", text.comment_lines(F.col("t"), F.col("e")).alias("c"),
                          text.non_blank_lines(F.col("t")).alias("n"))
    for row in counted.collect():
        stripped = [line.strip() for line in row.t.split("\n")]
        mark = "#" if row.e in catalog.HASH_COMMENT_EXTENSIONS else "//"
        assert row.c == sum(line.startswith(mark) for line in stripped), repr(row.t)
        assert row.n == sum(bool(line) for line in stripped), repr(row.t)


def test_decoding(spark):
    rows = spark.createDataFrame([(b"a\r\nb\rc",), (b"\xc3\x28",), ("é".encode(),)], "d binary")
    decoded = [r[0] for r in rows.select(text.unify_newlines(text.decode_utf8(F.col("d")))).collect()]
    assert decoded == ["a\nb\nc", None, "é"]


def test_strip_of_ascii_and_other_texts(spark):
    blanks = [chr(i) for i in range(128)] + ["\x85", "\xa0", " ", "　", "​"]
    texts = [f"{a}x{a} y{a}" for a in blanks] + [f"{a}{b}" for a in blanks for b in (" ", "\x1f", "é")] + ["", " \t"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", text.strip(F.col("t")).alias("a"), F.expr(text.strip_sql("t")).alias("b")).collect()
    for r in found:
        assert r.a == r.b == texts[r.i].strip(), texts[r.i]
    assert rows.select(text.strip(F.lit(None).cast("string"))).first()[0] is None
