import dataclasses
from collections import Counter

from pyspark.sql import functions as F

from reviewlake import catalog
from reviewlake.catalog import RULES, Rule
from reviewlake.operators import listings, scan
from reviewlake.streaming import scan as streaming

COLUMNS = ("file_id", "issue", "line", "matched")


def test_stream_finds_what_a_batch_finds(spark, make_files, hits, tmp_path):
    files = make_files([(f"f{at}.js", f"var a = {at}\nmd5 ==\nb") for at in range(20)])
    files.repartition(5).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path))
    found = scan.scan(stream)
    table = streaming.run_to_table(streaming.append_findings, found, "scan")
    assert hits(spark.read.parquet(table), *COLUMNS) == hits(scan.scan(files), *COLUMNS)


def test_windows_drop_repeated_deliveries(spark, tmp_path):
    rows = [(at, f"2024-01-0{1 + at % 3} 10:00:00", f"f{at}.py", "md5\neval(a)") for at in range(12)]
    files = spark.createDataFrame(rows, "file_id long, ts string, filename string, content string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    for _ in range(2):  # every file arrives twice
        files.repartition(3).write.mode("append").parquet(str(tmp_path))
    changed = files.where("file_id = 0").withColumn("content", F.lit("md5\n\nmd5"))
    changed.write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path))
    delivered = streaming.delivery_counts(stream, "10 days", quality=False)
    folder = streaming.new_folder(spark, "windows")
    query = streaming.add_windows(delivered, f"{folder}/table", f"{folder}/state")
    query.awaitTermination()
    latest = streaming.windows_table(f"{folder}/table").read(spark).collect()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) == 13  # twelve files and one changed content, not one row per finding
    counts = {(r.window_start.day, r.severity): r.findings for r in latest}
    assert counts == {(1, "medium"): 6, (1, "high"): 4, (2, "medium"): 4, (2, "high"): 4,
                      (3, "medium"): 4, (3, "high"): 4}


def test_vectors_of_deliveries(spark, make_files):
    """Rows of one delivery over several batches, deliveries in a row, and a rule that is tried on whole texts."""
    rules = (*RULES, Rule("two", r"md5\n\s*eval", "critical", "d", "r", None, multiline=True))
    texts = [(f"f{at}.py", "md5\neval(a + b)\n" * (1 + at * 40 % 90)) for at in range(9)]
    files = make_files(texts).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    twice = files.unionByName(files).coalesce(1).sortWithinPartitions("file_id")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(key, "37")
        rows = streaming.delivery_vectors(twice, rules).collect()
    finally:
        spark.conf.set(key, before)
    assert len(rows) == 18  # what comes twice in a row is one delivery; the rule on whole texts has rows of its own
    found = scan.scan(files, rules).groupBy("file_id", "severity").count().collect()
    wanted = {(r.file_id, r.severity): r["count"] for r in found}
    got = Counter()
    for r in rows:
        for severity in catalog.SEVERITIES:
            got[r.file_id, severity] += r[severity]
    assert {k: n for k, n in got.items() if n} == wanted


def _finding(change, at, issue="i", severity="high"):
    return (change, at, severity, issue, 0, 0, 0, 0)


FINDINGS = "change_id long, file_ord long, severity string, issue string, phase int, rule_ord int, pos long, match_ord int"


def test_first_of_each_change_is_merged_and_replayed(spark, tmp_path):
    table = dataclasses.replace(streaming.first_table(str(tmp_path / "t"), FINDINGS, n=3), compact_every=2)
    batches = [
        [_finding(1, at) for at in (9, 7, 5, 3)], [_finding(1, 4), _finding(2, 1)], [_finding(2, 1), _finding(2, 0), _finding(1, 1)],
        [_finding(3, at) for at in range(5)], [_finding(1, 2)],
    ]

    def state():
        return sorted((r.change_id, r.file_ord) for r in table.read(spark).collect())

    def wanted(upto):
        distinct = sorted({(f[0], f[1]) for b in batches[:upto + 1] for f in b})
        return [x for x in distinct if sum(y[0] == x[0] and y < x for y in distinct) < 3]

    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, FINDINGS)
        for _ in range(2):  # the second time is the batch run again after a failure
            table.add(frame, number)
        assert state() == wanted(number)
    assert (tmp_path / "t/kind=base/number=3").exists() and table.read(spark, 1).count() == len(wanted(1))


def test_stream_keeps_what_a_batch_lists(spark, make_files, hits, tmp_path):
    pairs = [(f"f{at}.py", 'password = "x"\neval(a + b)\n' * (1 + at % 7)) for at in range(12)]
    for change in (1, 2):
        make_files(pairs, change).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = scan.security_findings(stream)
    table = streaming.run_to_table(streaming.add_first_security, found, "first")
    columns = ("change_id", "rank", "file_id", "issue", "line", "severity")
    assert hits(streaming.read_first_security(spark, table, found), *columns) == hits(
        listings.first_security(scan.security_findings(batch), "change_id"), *columns)
