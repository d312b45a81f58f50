"""Findings by content: a text that was scanned once, under whatever name, is not scanned again.

A store keeps two tables. ``contents`` has the hash, suffix and run of every text scanned so far, also of those without
findings; ``findings`` has what was found, without the keys of any file. A review hashes its texts, looks up which
hashes are new, scans one file of each of those, adds them, and joins the stored findings to all files by hash and
suffix. Findings depend on text, suffix and rules alone, so the result is that of a full scan; a store belongs to one set of
rules, whose fingerprint is part of its folder.

Findings are written before the contents that vouch for them, under a run of their own: if a job dies between, its findings
belong to no known content, and the next review scans those texts again. Both tables are appended to, never rewritten.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.catalog import RULES, Rule
from reviewlake.operators.findings import file_keys
from reviewlake.operators.scan import reviewable
from reviewlake.plans.review import all_findings
from reviewlake.schemas import FINDING
from reviewlake.session import materialize

_CONTENTS = "content_sha string, ext string, run string"
_FOUND = [field.name for field in FINDING.fields]


def fingerprint(*settings) -> str:
    """Tells sets of rules apart by all that is in them."""
    return hashlib.sha256(repr(settings).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class FindingsStore:
    """What was found so far, below ``folder``; ``find`` gives the findings of files and is the same for the store's life."""

    folder: str
    find: Callable[[DataFrame], DataFrame]

    def open(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The contents and the findings; both are there from the first time on."""
        tables = {"contents": _CONTENTS, "findings": f"{_CONTENTS}, {FINDING.simpleString()[7:-1].replace(':', ' ')}"}
        for name, schema in tables.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")
        return tuple(spark.read.schema(schema).parquet(f"{self.folder}/{name}") for name, schema in tables.items())

    def add(self, source: DataFrame) -> int:
        """Scans what is new among files with ``content_sha``; the number of texts that were."""
        contents, _ = self.open(source.sparkSession)
        each = source.groupBy("content_sha", "ext").agg(F.min("file_id").alias("file_id"))
        new = materialize(each.join(contents, ["content_sha", "ext"], "left_anti"), "new-contents")
        n = new.count()
        if n:
            run = F.lit(uuid.uuid4().hex).alias("run")
            texts = source.join(new, ["content_sha", "ext", "file_id"], "left_semi")
            self.find(texts).select("content_sha", "ext", run, *_FOUND).write.mode("append").parquet(f"{self.folder}/findings")
            new.select("content_sha", "ext", run).write.mode("append").parquet(f"{self.folder}/contents")
        return n


def open_store(folder: str, rules: Sequence[Rule] = RULES, wildcard: str = "documented") -> FindingsStore:
    """The store of ``all_findings`` (texts and Python structure, without scanner reports) under these rules."""
    own = f"{folder.rstrip('/')}/{fingerprint(tuple(rules), wildcard)}"
    return FindingsStore(own, lambda files: all_findings(files, rules=rules, wildcard=wildcard))


def scan_incremental(files: DataFrame, store: FindingsStore) -> DataFrame:
    """All findings of the files, as of a full scan; ``file_id`` must tell files apart."""
    source = reviewable(files)
    source = source.withColumn("content_sha", F.sha2("content", 256))
    store.add(source)
    contents, found = store.open(files.sparkSession)
    keys = [name for name in file_keys(source) if name not in ("content_sha", "ext")]
    # findings first meet the contents that vouch for them; the files come last, so a text that many have can be split
    known = found.join(contents, ["content_sha", "ext", "run"]).drop("run")
    return source.select(*keys, "content_sha", "ext").join(known, ["content_sha", "ext"]).select(*keys, "ext", *_FOUND)
