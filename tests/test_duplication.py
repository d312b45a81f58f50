import random
from collections import Counter

from pyspark.sql import functions as F

from reviewlake.operators import duplication


def _plain(files, k):
    """Each place is held against all others by its lines."""
    own = {i: [(at + 1, t.strip()) for at, t in enumerate(c.split("\n")) if t.strip()] for i, c in files}
    shingles = {(i, p): tuple(t for _, t in lines[p:p + k]) for i, lines in own.items() for p in range(len(lines) - k + 1)}
    copies = Counter(shingles.values())
    out = []
    for i, lines in own.items():
        open_ = None
        for p in range(len(lines)):
            n = copies.get(shingles.get((i, p)), 0)
            if n > 1:
                open_ = [lines[p][0], lines[p + k - 1][0], k, n] if open_ is None else [
                    open_[0], lines[p + k - 1][0], open_[2] + 1, max(open_[3], n)]
            elif open_:
                out.append((i, *open_))
                open_ = None
        if open_:
            out.append((i, *open_))
    return sorted(out)


def test_regions(spark, make_files):
    dice = random.Random(2)
    blocks = [[f"line {b} {i}" for i in range(dice.randint(1, 9))] for b in range(12)]
    texts = []
    for _ in range(40):
        lines = [x for b in dice.choices(blocks, k=3) for x in [*b, *([""] * dice.randint(0, 2))]]
        texts.append("\n".join(dice.choice(["", " ", "\t"]) + x + dice.choice(["", "  "]) for x in lines) + dice.choice(["", "\n"]))
    texts += ["", " \n\n", "a\nb\nc", "x\n" * 9, "same\nfour\nlines\nhere\n\n\nsame\nfour\nlines\nhere"]
    files = make_files([(f"f{i}.py", t) for i, t in enumerate(texts)] + [("n.py", None), ("f.md", "x\n" * 9)])
    for k in (2, 4):
        found = duplication.duplicated_regions(files, k).select("file_id", "first_line", "last_line", "lines", "copies")
        assert sorted(map(tuple, found.collect())) == _plain(list(enumerate(texts)), k)
    ratio = {r.file_id: (r.duplicated, r.lines, r.ratio) for r in duplication.duplication_ratio(files).collect()}
    assert ratio[43] == (9, 9, 1.0) and ratio[42] == (0, 3, 0.0) and ratio[41] == (0, 0, 0.0) and 40 not in ratio


def test_places_of_a_file_are_one_row(spark, make_files):
    """Places are written and read as arrays: rows grow with the files, not with their lines."""
    texts = ["\n".join(f"line {i}" for i in range(n)) for n in (0, 3, 4, 500, 2000)] + [" \n\t\n"]
    found = duplication.shingles(make_files([(f"f{i}.py", t) for i, t in enumerate(texts)]))
    assert sorted(r.file_id for r in found.collect()) == [1, 2, 3, 4, 5]  # one without content, two without a shingle


def test_region_over_several_rows_of_a_long_file(spark, make_files):
    n = duplication.CHUNK + 4000
    text = "\n".join(f"line {i}" for i in range(n))
    files = make_files([("a.py", text), ("b.py", "first\n\n" + text), ("c.py", "x")])
    found = duplication.duplicated_regions(files).select("file_id", "first_line", "last_line", "lines", "copies")
    assert sorted(map(tuple, found.collect())) == [(0, 1, n, n, 2), (1, 3, n + 2, n, 2)]
    ratio = duplication.duplication_ratio(files).select("file_id", "lines", "duplicated")
    assert sorted(map(tuple, ratio.collect())) == [(0, n, n), (1, n + 1, n), (2, 1, 0)]


def test_frequent_and_other_shingles(spark, make_files):
    """The same regions whether all, some or no hashes may be broadcast; blanks of all kinds are stripped."""
    dice = random.Random(7)
    blocks = [[f"zeile \u00e4 {b} {i}" for i in range(dice.randint(1, 7))] for b in range(9)]
    blanks = ["", " ", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000 \r"]
    texts = ["\n".join(dice.choice(blanks) + x + dice.choice(blanks) for b in dice.choices(blocks, k=5)
                       for x in [*b, *([dice.choice(blanks)] * dice.randint(0, 2))]) for _ in range(60)]
    files = make_files([(f"f{i}.py", t) for i, t in enumerate(texts)])
    named = files.withColumn("file_id", F.concat(F.lit("id "), "file_id"))
    expected, key = _plain(list(enumerate(texts)), 4), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for limit in ("-1", "320", before, "1g"):
            spark.conf.set(key, limit)
            found = duplication.duplicated_regions(files).select("file_id", "first_line", "last_line", "lines", "copies")
            assert sorted(map(tuple, found.collect())) == expected, limit
    finally:
        spark.conf.set(key, before)
    found = duplication.duplicated_regions(named).select("file_id", "first_line", "last_line", "lines", "copies")
    assert sorted((int(i[3:]), *rest) for i, *rest in map(tuple, found.collect())) == expected


def test_no_files(spark, make_files):
    files = make_files([("n.py", None), ("f.md", "x\n" * 9)])
    assert duplication.duplicated_regions(files).collect() == [] == duplication.duplication_ratio(files).collect()


def test_shingle_of_a_third_of_the_files_is_split(spark, make_files):
    """The join of a hot hash is dealt to several tasks, and no group of its places is ever gathered."""
    hot = "\n".join(f"licence {i}" for i in range(4))
    files = spark.range(12000).select(
        "id", F.lit(1).alias("change_id"), F.col("id").alias("file_ord"), F.col("id").alias("file_id"),
        F.concat(F.lit("f"), "id", F.lit(".py")).alias("filename"),
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(
            F.concat_ws("\n", *(F.concat(F.lit(f"own {i} "), "id") for i in range(4)))).alias("content"),
    ).repartition(8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        found = duplication.duplicated_regions(files)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(rows) == 4000 and {r.copies for r in rows} == {4000} and "skew=true" in plan


def test_ratio_reads_texts_once(spark, make_files, tmp_path):
    """Sizes of files come from the written table: the plan does not go back to the files."""
    folder = str(tmp_path / "files")
    make_files([("a.py", "a\nb\n\nc\nd"), ("b.py", "a\nb\nc\nd\n \ne"), ("c.py", "\n")]).write.parquet(folder)
    found = duplication.duplication_ratio(spark.read.parquet(folder))
    assert sorted(map(tuple, found.select("file_id", "lines", "duplicated").collect())) == [(0, 4, 4), (1, 5, 4), (2, 0, 0)]
    assert folder not in " ".join(found.inputFiles())
