"""One query per operator, over whole tables. Columns have the names the check SQL gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import corpora
from reviewlake import catalog
from reviewlake.catalog import Rule
from reviewlake.functions import text
from reviewlake.operators import (
    duplication, listings, patches, python_structure, quality, render, reports, rule_index, scan, summaries,
    verdict,
)
from reviewlake.plans import incremental, review
from reviewlake.session import materialize, new_folder, spread
from reviewlake.sinks import reviews
from reviewlake.sources import (
    changes as change_source, files as file_source, long_files, rules as rule_source, snapshots,
)
from reviewlake.sources.corpus import read_corpus, write_corpus
from reviewlake.streaming import scan as streaming

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

USER_RULES = (
    Rule("import_statement", r"^\s*import\s+(\w+)", "low", "Import", "Check it", None),
    Rule("call_of_save", r"\bsave\(\)", "unusual", "Call", "Check it", (".py", ".rb")),
    Rule("split_statement", r"==\s*\n\s*\w+", "medium", "Split", "Join it", None, multiline=True),
    Rule("last_word", r"\w+$", "info", "Word", "Read it", (".sql",), multiline=True),
)

_LINE = ("file_id", "filename", "severity", "line", "code", "matched", "description",
         "recommendation")


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    for table in TABLES:
        if f" {table}" in query or f"\n{table}" in query:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            spread(rows).createOrReplaceTempView(table)
    return spark.sql(query)


_written: dict[tuple[str, str, str], str] = {}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived corpus as a table, written once per application by the first query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    rows = _sql(spark, sf_dir, getattr(corpora, name))
    by_suffix = name == "FILES"
    if key not in _written:
        folder = new_folder(spark, name.lower())
        write_corpus(rows, folder) if by_suffix else rows.write.parquet(folder)
        _written[key] = folder
    if by_suffix:
        return read_corpus(spark, _written[key], rows.schema)
    return spark.read.schema(rows.schema).parquet(_written[key])


def files(spark, sf_dir):
    """The changed files, as a corpus by suffix."""
    return corpus(spark, sf_dir, "FILES")


def changes(spark, sf_dir):
    return _sql(spark, sf_dir, corpora.CHANGES)


def raw_files(spark, sf_dir):
    return _sql(spark, sf_dir, corpora.RAW_FILES)


def _all_reports(spark, sf_dir):
    return corpus(spark, sf_dir, "REPORTS")


def _security(spark, sf_dir):
    """Pattern, whole-file and scanner findings."""
    source = files(spark, sf_dir)
    return scan.security_findings(source).unionByName(
        reports.tool_findings(_all_reports(spark, sf_dir), source)
    )


def _quality(spark, sf_dir):
    return quality.quality_findings(files(spark, sf_dir))


# --- files ---------------------------------------------------------------------------------------


def file_ext(spark, sf_dir):
    rows = files(spark, sf_dir).select("file_id", "filename")
    return rows.withColumn("ext", text.file_ext(F.col("filename")))


def code_files(spark, sf_dir):
    return scan.code_files(files(spark, sf_dir)).select("file_id", "filename", "ext")


def has_content(spark, sf_dir):
    """Content of files that are not removed, where there is any."""
    content = F.when(F.col("status") != "removed", F.col("content"))
    rows = files(spark, sf_dir).withColumn("content", content)
    return rows.where(text.has_content(F.col("content"))).select("file_id", "status", "content")


def binary_ingest(spark, sf_dir):
    raw = _sql(spark, sf_dir, corpora.RAW_BYTES)
    return file_source.source_files(raw).select("file_id", "filename", "ext", "status", "content")


def binary_rejects(spark, sf_dir):
    return file_source.skipped_files(_sql(spark, sf_dir, corpora.RAW_BYTES))


# --- pattern rules -------------------------------------------------------------------------------


def scan_rules_documented(spark, sf_dir):
    return scan.scan(files(spark, sf_dir), quality=False, whole_file=False).select("issue", *_LINE)


def scan_rules_as_coded(spark, sf_dir):
    found = scan.scan(files(spark, sf_dir), quality=False, whole_file=False, wildcard="as_coded")
    return found.select("issue", *_LINE)


def scan_user_rules(spark, sf_dir):
    found = scan.scan(files(spark, sf_dir), USER_RULES, quality=False, whole_file=False)
    return found.select("issue", "file_id", "severity", "line", "code", "matched")


def scan_rules_table(spark, sf_dir):
    listed = [
        (r.name, r.pattern, r.severity, r.description, r.recommendation, r.extensions, r.multiline)
        for r in USER_RULES if r.severity in catalog.SEVERITIES
    ]
    rules = rule_source.rules_from_table(spark.createDataFrame(listed, rule_source.RULES))
    found = scan.scan(files(spark, sf_dir), rules, quality=False, whole_file=False)
    return found.select("issue", "file_id", "severity", "line", "code", "matched")


def scan_rules_join(spark, sf_dir):
    """A rule for each part, as rows of an index."""
    index = rule_index.index_table(_sql(spark, sf_dir, corpora.PART_RULES))
    found = rule_index.scan_index(files(spark, sf_dir), index)
    return found.select("issue", "file_id", "severity", "description", "recommendation", "line", "code", "matched", "match_ord")


def rule_query(rule: Rule):
    def query(spark, sf_dir):
        found = scan.scan(files(spark, sf_dir), [rule], quality=False, whole_file=False)
        return found.select(*_LINE)

    return query


def raw_weak_crypto(spark, sf_dir):
    rule = next(rule for rule in catalog.RULES if rule.name == "weak_crypto")
    found = scan.scan(raw_files(spark, sf_dir), [rule], quality=False, whole_file=False)
    return found.select("file_id", "line", "code", "matched")


# --- quality checks ------------------------------------------------------------------------------


def quality_query(check, whole_file=False):
    columns = ("file_id", "filename", "severity", "description", "recommendation")

    def query(spark, sf_dir):
        rows = scan.text_quality_findings(files(spark, sf_dir), [check.name])
        return rows.select(*columns) if whole_file else rows.select(*columns, "line", "code")

    return query


def long_file(spark, sf_dir):
    found = scan.text_quality_findings(corpus(spark, sf_dir, "LONG_FILES"), [catalog.LONG_FILE.name])
    return found.select("file_id", "severity", "description")


def scan_incremental(spark, sf_dir):
    """A second review of the same files: the first one fills the store, this one scans no text."""
    source, store = files(spark, sf_dir), incremental.open_store(new_folder(spark, "store"))
    store.add(scan.reviewable(source).withColumn("content_sha", F.sha2("content", 256)))
    found = incremental.scan_incremental(source, store)
    known = F.when(F.col("issue") != "syntax_error", F.col("description")).alias("description")
    return found.select("change_id", "file_id", "type", "severity", "issue", known, "line", "code", "matched")


def long_file_parts(spark, sf_dir):
    """All line and whole-file checks on files that are read in parts, one file per size of parts."""
    folder = new_folder(spark, "long-files")
    rows = _sql(spark, sf_dir, corpora.PART_TEXTS).repartition("p_size").sortWithinPartitions("p_size", "p_partkey")
    rows.select("p_size", F.col("content").alias("value")).write.partitionBy("p_size").text(folder)
    pieces = long_files.read_pieces(spark, folder, least=1, part_bytes=2000)
    size = F.regexp_extract("path", r"p_size=(\d+)", 1).alias("file_size")
    named = F.concat(F.lit(f"{folder}/"), F.expr(corpora.size_name("file_size")))
    pieces = materialize(pieces.withColumn("file_size", size.cast("int")).withColumn("path", named).drop("file_size"), "pieces")
    found = scan.scan_parts(long_files.parts_of(pieces, folder))
    return found.select(
        F.regexp_extract("filename", r"size_(\d+)", 1).cast("long").alias("file_id"), "severity", "issue", "description",
        "line", "code", "matched",
    )


def raw_quality(spark, sf_dir):
    found = scan.text_quality_findings(raw_files(spark, sf_dir))
    return found.select("file_id", "severity", "issue", "description", "line", "code")


def file_check_query(check):
    def query(spark, sf_dir):
        rows = scan.scan(files(spark, sf_dir), (), quality=False, checks=[check.name])
        return rows.select("file_id", "filename", "severity", "description", "recommendation")

    return query


def comment_ratio(spark, sf_dir):
    rows = quality.text_metrics(files(spark, sf_dir))
    return rows.select("file_id", "comment_lines", "non_blank_lines", "comment_ratio")


def lines_of_code(spark, sf_dir):
    return quality.text_metrics(files(spark, sf_dir)).select("file_id", "lines_of_code")


def js_functions(spark, sf_dir):
    rows = quality.text_metrics(files(spark, sf_dir))
    rows = rows.where(F.col("ext").isin(*catalog.SCRIPT_EXTENSIONS))
    return rows.select("file_id", "functions")


def duplicated_regions(spark, sf_dir):
    return duplication.duplicated_regions(files(spark, sf_dir))


def duplication_ratio(spark, sf_dir):
    return duplication.duplication_ratio(files(spark, sf_dir))


# --- Python structure ----------------------------------------------------------------------------


def _trees(spark, sf_dir):
    return python_structure.python_trees(files(spark, sf_dir))


def py_counts(spark, sf_dir):
    counts = python_structure.python_counts(_trees(spark, sf_dir))
    return counts.select("file_id", "functions", "classes")


def py_complexity(spark, sf_dir):
    rows = python_structure.python_functions(_trees(spark, sf_dir))
    return rows.select("file_id", "function", "line", "complexity", "length", "documented")


def structure_query(issue, columns):
    def query(spark, sf_dir):
        found = python_structure.python_findings(_trees(spark, sf_dir))
        return found.where(F.col("issue") == issue).select(*columns)

    return query


# --- patches, reports ----------------------------------------------------------------------------


def _patches(spark, sf_dir):
    return corpus(spark, sf_dir, "PATCHES")


def hunks(spark, sf_dir):
    rows = patches.hunks(_patches(spark, sf_dir))
    joined = [F.array_join(name, "\n").alias(name) for name in ("added", "removed", "context")]
    sizes = [F.size(name).cast("long").alias(f"n_{name}") for name in ("added", "removed", "context")]
    return rows.select("file_id", "hunk", "header", *joined, *sizes)


def patch_lines(spark, sf_dir):
    return patches.patch_lines(_patches(spark, sf_dir)).select("file_id", "hunk", "pos", "kind", "text")


def report_query(tool):
    def query(spark, sf_dir):
        found = reports.tool_findings(_all_reports(spark, sf_dir), files(spark, sf_dir), [tool])
        return found.select(
            "file_id", "filename", "tool", "severity", "issue", "description", "line", "code",
            "confidence", "recommendation",
        )

    return query


def report_files(spark, sf_dir):
    """Reports over all files of a change, each item brought to its own file."""
    found = reports.tool_findings(_sql(spark, sf_dir, corpora.TREE_REPORTS), files(spark, sf_dir))
    return found.select("change_id", "file_id", "filename", "tool", "severity", "issue", "line")


# --- summaries -----------------------------------------------------------------------------------


def tool_summary(spark, sf_dir):
    found = reports.tool_findings(_all_reports(spark, sf_dir), files(spark, sf_dir))
    rows = summaries.tool_summary(found)
    tools = [F.element_at("by_tool", tool).alias(tool) for tool in catalog.REPORT_TOOLS]
    return rows.select("*", *tools).drop("by_tool")


def security_summary(spark, sf_dir):
    return summaries.security_summary(_security(spark, sf_dir))


def security_summary_rollup(spark, sf_dir):
    return summaries.security_summary_rollup(_security(spark, sf_dir))


def quality_summary(spark, sf_dir):
    source = files(spark, sf_dir)
    trees = materialize(_trees(spark, sf_dir), "trees")
    return summaries.quality_summary(
        quality.text_metrics(source), python_structure.python_counts(trees),
        quality.quality_findings(source, trees),
    )


def file_metrics(spark, sf_dir):
    rows = quality.file_metrics(files(spark, sf_dir))
    return rows.select("file_id", "lines_of_code", "functions", "classes", "comment_ratio")


def severity_histogram(spark, sf_dir):
    return summaries.severity_histogram(_quality(spark, sf_dir))


def findings_by_tool(spark, sf_dir):
    return summaries.findings_by_tool(_security(spark, sf_dir))


def change_severity_histogram(spark, sf_dir):
    return summaries.severity_histogram(_quality(spark, sf_dir), by=["change_id"])


def change_findings_by_tool(spark, sf_dir):
    counts = summaries.findings_by_tool(_security(spark, sf_dir), by=["change_id"])
    return counts.select("change_id", "tool", "findings")


def change_totals(spark, sf_dir):
    return summaries.change_totals(files(spark, sf_dir))


def _change_counts(spark, sf_dir):
    source = files(spark, sf_dir)
    found = review.all_findings(source, _all_reports(spark, sf_dir))
    return summaries.change_summary(source, found)


def change_quality(spark, sf_dir):
    rows = _change_counts(spark, sf_dir)
    return rows.select("change_id", "quality_issues", "functions", "lines_of_code")


def prompt_counts(spark, sf_dir):
    rows = _change_counts(spark, sf_dir)
    return rows.select("change_id", "critical", "high", "quality_medium_high")


def verdicts(spark, sf_dir):
    rows = verdict.with_verdict(_change_counts(spark, sf_dir))
    return rows.select("change_id", "mark", "verdict", "reason")


def ai_gate(spark, sf_dir):
    return verdict.needs_review(_change_counts(spark, sf_dir)).select("change_id")


# --- listings ------------------------------------------------------------------------------------

_LISTED = ("rank", "file_id", "severity", "issue", "line", "description")


def first10_security(spark, sf_dir):
    return listings.first_security(_security(spark, sf_dir)).select(*_LISTED)


def first10_quality(spark, sf_dir):
    return listings.first_quality(_quality(spark, sf_dir)).select(*_LISTED)


def change_first10_security(spark, sf_dir):
    return listings.first_security(_security(spark, sf_dir), "change_id").select("change_id", *_LISTED)


def change_first10_quality(spark, sf_dir):
    return listings.first_quality(_quality(spark, sf_dir), "change_id").select("change_id", *_LISTED)


def prompt_files(spark, sf_dir):
    rows = listings.prompt_files(files(spark, sf_dir))
    return rows.select("change_id", "rank", "filename", "status", "additions", "deletions")


def prompt_critical(spark, sf_dir):
    return listings.prompt_critical(_security(spark, sf_dir)).select("change_id", *_LISTED)


def prompt_quality(spark, sf_dir):
    return listings.prompt_quality(_quality(spark, sf_dir)).select("change_id", *_LISTED)


def clean_files(spark, sf_dir):
    source = scan.reviewable(files(spark, sf_dir)).select("file_id", "filename")
    return listings.clean_files(source, _security(spark, sf_dir))


def security_listing(spark, sf_dir):
    rows = render.finding_text(listings.first_security(_security(spark, sf_dir)))
    return rows.select("rank", "listing")


def quality_listing(spark, sf_dir):
    rows = render.finding_text(listings.first_quality(_quality(spark, sf_dir)))
    return rows.select("rank", "listing")


def security_panels(spark, sf_dir):
    return render.security_panels(materialize(_security(spark, sf_dir), "security"))


def quality_panels(spark, sf_dir):
    return render.quality_panels(_quality(spark, sf_dir))


# --- changes -------------------------------------------------------------------------------------


def change_content(spark, sf_dir):
    source = files(spark, sf_dir)
    listed = source.select(
        "change_id", "filename", "status", "additions", "deletions"
    ).withColumn("patch", F.lit(None).cast("string"))
    stored = source.where(F.col("content").isNotNull()).select(
        "change_id", "filename",
        F.when(F.col("file_id") % 23 == 2, F.unhex(F.lit("C328"))).otherwise(
            F.encode("content", "UTF-8")).alias("data"),
    )
    unlisted = stored.withColumn("filename", F.concat(F.lit("unlisted/"), "filename"))
    stored = stored.unionByName(unlisted)
    with_content = change_source.with_head_content(
        change_source.changed_code_files(listed), stored
    )
    return with_content.select("change_id", "filename", "status", "patch", "content", "decode_error")


def _export(spark, sf_dir):
    folder = new_folder(spark, "export")
    _sql(spark, sf_dir, corpora.EXPORTED).write.text(folder)
    return change_source.read_export(spark, folder)


def change_export(spark, sf_dir):
    """Headers with their files, from one nested export."""
    exported = _export(spark, sf_dir)
    rows = exported.changes.join(exported.files, "change_id", "left")
    return rows.select("change_id", "author", "title", "file_ord", "filename", "status", "additions", "deletions")


def change_rejects(spark, sf_dir):
    return _export(spark, sf_dir).rejects


def snapshot_diff(spark, sf_dir):
    head, index, work = [_sql(spark, sf_dir, corpora.snapshot(at)) for at in range(3)]
    return snapshots.local_changes(head, index, work).select(
        "filename", "stage", "status", "patch", "content"
    )


def change_header(spark, sf_dir):
    totals = summaries.change_totals(files(spark, sf_dir))
    return render.change_header(changes(spark, sf_dir), totals).select("change_id", "header")


# --- texts ---------------------------------------------------------------------------------------


def summary_markdown(spark, sf_dir):
    return render.summary_markdown(verdict.with_verdict(_change_counts(spark, sf_dir)))


def review_prompt(spark, sf_dir):
    return review.review_changes(
        changes(spark, sf_dir), files(spark, sf_dir), _all_reports(spark, sf_dir)
    ).prompts


def review_output(spark, sf_dir):
    """What is written per change, with a review text from outside for some; read back from the written table."""
    summaries_ = render.summary_markdown(verdict.with_verdict(_change_counts(spark, sf_dir)))
    given = changes(spark, sf_dir).where("change_id % 3 = 0").select(
        "change_id", F.concat(F.lit("Review of "), "author").alias("review"))
    folder = new_folder(spark, "reviews")
    reviews.write_reviews(reviews.review_texts(summaries_, given), folder)
    return spark.read.schema("change_id long, text string").parquet(folder)


def file_prompt(spark, sf_dir):
    rows = scan.reviewable(files(spark, sf_dir))
    context = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("change "), F.col("change_id")))
    return render.file_prompts(rows.withColumn("context", context))


def snippet_prompt(spark, sf_dir):
    return render.snippet_prompts(_security(spark, sf_dir))


# --- streams -------------------------------------------------------------------------------------


def _arrivals(spark, sf_dir):
    """The arriving files as a stream: every file of the folder is picked up once."""
    batch = corpus(spark, sf_dir, "ARRIVALS")
    folder = _written[spark.sparkContext.applicationId, sf_dir, "ARRIVALS"]
    return spark.readStream.schema(batch.schema).parquet(folder)


def stream_scan(spark, sf_dir):
    found = scan.scan(_arrivals(spark, sf_dir))
    table = streaming.run_to_table(streaming.append_findings, found, "stream-scan")
    rows = spark.read.schema(found.schema).parquet(table)
    return rows.select("file_id", "severity", "issue", "line", "code", "matched")


def stream_windows(spark, sf_dir):
    once = _arrivals(spark, sf_dir)
    twice = once.unionByName(once)
    counts = streaming.delivery_counts(twice, "40 days")
    table = streaming.run_to_table(streaming.add_windows, counts, "stream-windows")
    latest = streaming.windows_table(table).read(spark)
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return latest.select(day, "severity", "findings")


def stream_first10(spark, sf_dir):
    """The changed files as a stream of small batches; what batch ``change_first10_security`` lists, without reports."""
    batch = files(spark, sf_dir)
    folder = _written[spark.sparkContext.applicationId, sf_dir, "FILES"]
    arriving = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    found = scan.security_findings(arriving)
    table = streaming.run_to_table(streaming.add_first_security, found, "stream-first")
    return streaming.read_first_security(spark, table, found).select("change_id", *_LISTED)


def queries():
    found = {
        "file_ext": file_ext,
        "code_files": code_files,
        "has_content": has_content,
        "binary_ingest": binary_ingest,
        "binary_rejects": binary_rejects,
        "scan_rules_documented": scan_rules_documented,
        "scan_rules_as_coded": scan_rules_as_coded,
        "scan_user_rules": scan_user_rules,
        "scan_rules_table": scan_rules_table,
        "scan_rules_join": scan_rules_join,
    }
    for rule in catalog.RULES:
        found[f"rule_{rule.name}"] = rule_query(rule)
    found["raw_weak_crypto"] = raw_weak_crypto
    for check in (catalog.LONG_LINE, catalog.TODO_COMMENT, catalog.MAGIC_NUMBER,
                  catalog.CONSOLE_LOG, catalog.VAR_USAGE, catalog.LOOSE_EQUALITY):
        found[f"rule_{check.name}"] = quality_query(check)
    found["rule_high_comment_ratio"] = quality_query(catalog.COMMENT_RATIO, whole_file=True)
    found |= {
        "long_file": long_file,
        "long_file_parts": long_file_parts,
        "raw_quality": raw_quality,
        "unsafe_pickle": file_check_query(catalog.UNSAFE_PICKLE),
        "missing_https": file_check_query(catalog.MISSING_HTTPS),
        "eval_usage": file_check_query(catalog.EVAL_USAGE),
        "inner_html": file_check_query(catalog.INNER_HTML),
        "select_star": file_check_query(catalog.SELECT_STAR),
        "scan_incremental": scan_incremental,
        "duplication": duplicated_regions,
        "duplication_ratio": duplication_ratio,
        "comment_ratio": comment_ratio,
        "lines_of_code": lines_of_code,
        "js_functions": js_functions,
        "file_metrics": file_metrics,
        "py_counts": py_counts,
        "py_complexity": py_complexity,
        "py_high_complexity": structure_query(
            "high_complexity", ("file_id", "line", "severity", "description")),
        "py_long_function": structure_query(
            "long_function", ("file_id", "line", "severity", "description")),
        "py_docstrings": structure_query(
            "missing_docstring", ("file_id", "line", "severity", "description")),
        "py_syntax_errors": structure_query(
            "syntax_error", ("file_id", "line", "severity", "issue")),
        "hunks": hunks,
        "patch_lines": patch_lines,
        "bandit_findings": report_query("bandit"),
        "semgrep_findings": report_query("semgrep"),
        "report_files": report_files,
        "tool_summary": tool_summary,
        "security_summary": security_summary,
        "security_summary_rollup": security_summary_rollup,
        "quality_summary": quality_summary,
        "severity_histogram": severity_histogram,
        "findings_by_tool": findings_by_tool,
        "change_severity_histogram": change_severity_histogram,
        "change_findings_by_tool": change_findings_by_tool,
        "change_totals": change_totals,
        "change_quality": change_quality,
        "prompt_counts": prompt_counts,
        "verdict": verdicts,
        "ai_gate": ai_gate,
        "first10_security": first10_security,
        "first10_quality": first10_quality,
        "change_first10_security": change_first10_security,
        "change_first10_quality": change_first10_quality,
        "prompt_files": prompt_files,
        "prompt_critical": prompt_critical,
        "prompt_quality": prompt_quality,
        "clean_files": clean_files,
        "security_panels": security_panels,
        "quality_panels": quality_panels,
        "security_listing": security_listing,
        "quality_listing": quality_listing,
        "change_content": change_content,
        "change_export": change_export,
        "change_rejects": change_rejects,
        "snapshot_diff": snapshot_diff,
        "change_header": change_header,
        "summary_markdown": summary_markdown,
        "review_output": review_output,
        "review_prompt": review_prompt,
        "file_prompt": file_prompt,
        "snippet_prompt": snippet_prompt,
        "stream_scan": stream_scan,
        "stream_windows": stream_windows,
        "stream_first10": stream_first10,
    }
    return found
