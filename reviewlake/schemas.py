"""Table shapes shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

CHANGES = T.StructType([
    T.StructField("change_id", T.LongType()),
    T.StructField("repo", T.StringType()),
    T.StructField("number", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("base_branch", T.StringType()),
    T.StructField("head_branch", T.StringType()),
])

CHANGED_FILES = T.StructType([
    T.StructField("change_id", T.LongType()),
    T.StructField("file_ord", T.LongType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("additions", T.IntegerType()),
    T.StructField("deletions", T.IntegerType()),
    T.StructField("changes", T.IntegerType()),
    T.StructField("patch", T.StringType()),
    T.StructField("raw_url", T.StringType()),
])

# An exported change: its header and its files, in order, as one JSON object.
EXPORT = T.StructType([
    *CHANGES.fields,
    T.StructField("files", T.ArrayType(T.StructType([
        field for field in CHANGED_FILES.fields if field.name not in ("change_id", "file_ord", "file_id")
    ]))),
])

# Columns a file may carry; whichever are present go through every operator unchanged.
FILE_KEYS = ("change_id", "file_ord", "file_id", "filename", "ext", "ts", "content_sha")

# The part of a finding that the detectors build. Order key: file_ord, phase, rule_ord, pos, match_ord.
FINDING = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("issue", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("matched", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("pos", T.LongType()),
    T.StructField("match_ord", T.IntegerType()),
])
FINDINGS = T.ArrayType(FINDING)
ORDER_KEY = ("file_ord", "phase", "rule_ord", "pos", "match_ord")

# Scanner reports. Keys that come as a string or a list are kept as their JSON text.
BANDIT_REPORT = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("issue_severity", T.StringType()),
    T.StructField("test_id", T.StringType()),
    T.StructField("issue_text", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("issue_confidence", T.StringType()),
    T.StructField("more_info", T.StringType()),
    T.StructField("filename", T.StringType()),
])))])

SEMGREP_REPORT = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("check_id", T.StringType()),
    T.StructField("start", T.StructType([T.StructField("line", T.IntegerType())])),
    T.StructField("extra", T.StructType([
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("lines", T.StringType()),
        T.StructField("metadata", T.StructType([
            T.StructField("references", T.ArrayType(T.StringType())),
            T.StructField("cwe", T.StringType()),
            T.StructField("owasp", T.StringType()),
        ])),
    ])),
    T.StructField("path", T.StringType()),
])))])
