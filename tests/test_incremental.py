from reviewlake.catalog import Rule
from reviewlake.operators import scan
from reviewlake.plans import incremental, review

COLUMNS = ("change_id", "file_ord", "file_id", "filename", "ext", "type", "severity", "issue", "description", "line", "code",
           "matched", "phase", "rule_ord", "pos", "match_ord")
PAIRS = [("a.py", "md5\neval(a + b)"), ("b.py", "md5\neval(a + b)"), ("c.js", "md5\neval(a + b)"), ("d.py", "x = 1"), ("e.py", ""),
         ("f.py", None), ("g.py", "def broken(:"), ("node_modules/h.py", "md5"), ("i.md", "md5"), ("j.py", "x = 1")]


def _runs(spark, store):
    contents, found = store.open(spark)
    return contents.count(), contents.select("run").distinct().count(), found.count()


def test_equals_a_full_scan(spark, make_files, hits, tmp_path):
    store = incremental.open_store(str(tmp_path))
    files = make_files(PAIRS)
    wanted = hits(review.all_findings(files), *COLUMNS)
    assert hits(incremental.scan_incremental(files, store), *COLUMNS) == wanted and len(wanted) > 8
    first = _runs(spark, store)
    assert first[:2] == (4, 1)  # two contents under one suffix each, one under another, one broken

    # the same again, and renamed within the suffix: nothing is scanned
    def never(files):
        raise AssertionError("a text was scanned again")

    idle = incremental.FindingsStore(store.folder, never)
    assert hits(incremental.scan_incremental(files, idle), *COLUMNS) == wanted
    renamed = make_files([(f"other/{name}", text) for name, text in PAIRS])
    assert hits(incremental.scan_incremental(renamed, idle), *COLUMNS) == hits(review.all_findings(renamed), *COLUMNS)
    assert _runs(spark, store) == first

    # one text changed: it alone is scanned
    seen = []
    counting = incremental.FindingsStore(store.folder, lambda f: (seen.append(f.count()), store.find(f))[1])
    changed = make_files([*PAIRS[:3], ("d.py", "x = 1  # TODO: y"), *PAIRS[4:]])
    assert hits(incremental.scan_incremental(changed, counting), *COLUMNS) == hits(review.all_findings(changed), *COLUMNS)
    assert seen == [1] and _runs(spark, store)[:2] == (5, 2)


def test_findings_of_a_run_that_died_do_not_count(spark, make_files, hits, tmp_path):
    store, files = incremental.open_store(str(tmp_path)), make_files(PAIRS[:4])
    store.open(spark)

    source = scan.reviewable(files).withColumn("content_sha", incremental.F.sha2("content", 256))
    found = store.find(source).select("content_sha", "ext", incremental.F.lit("dead").alias("run"), *incremental._FOUND)
    found.write.mode("append").parquet(f"{store.folder}/findings")  # and no contents
    assert hits(incremental.scan_incremental(files, store), *COLUMNS) == hits(review.all_findings(files), *COLUMNS)


def test_stores_of_other_rules_are_apart(tmp_path):
    own = Rule("r", "abcd", "low", "d", "r")
    folders = {incremental.open_store(str(tmp_path), rules, w).folder for rules, w in (((own,), "documented"), ((), "documented"), ((own,), "as_coded"))}
    assert len(folders) == 3
