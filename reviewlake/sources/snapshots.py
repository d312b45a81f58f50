"""Uncommitted changes as a comparison of three snapshots: HEAD, index and work tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlake.functions import text
from reviewlake.session import materialize


def _hashes(snapshot: DataFrame, name: str) -> DataFrame:
    code = snapshot.where(text.is_code_file(F.col("filename")))
    return code.select("filename", F.coalesce(F.sha2("content", 256), F.lit("no text")).alias(name))


def changed_names(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """``filename`` and ``stage``: 0 where HEAD and index differ, 1 where index and work tree do.

    The hashes of all three are stacked and grouped by name once. A file without content (undecodable) is there
    all the same, and equals another such. Files the index does not know have no stage 1.
    """
    stacked = _hashes(head, "head").unionByName(_hashes(index, "index"), allowMissingColumns=True)
    stacked = stacked.unionByName(_hashes(work, "work"), allowMissingColumns=True)
    by_name = stacked.groupBy("filename").agg(*(F.max(name).alias(name) for name in ("head", "index", "work")))
    staged = F.when(~F.equal_null("head", "index"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    unstaged = F.when(
        F.col("index").isNotNull() & ~F.equal_null("index", "work"), F.array(F.lit(1))
    ).otherwise(F.array().cast("array<int>"))
    return by_name.select("filename", F.explode(F.concat(staged, unstaged)).alias("stage"))


def local_changes(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """Staged changes, then unstaged ones, with the work tree's content.

    A file that is both staged and unstaged is there twice. Files the index does not know are left
    out. Deleted files have no content. HEAD and index are read once, for their hashes; the work tree again for the texts
    of changed files, so that all others stay out of every shuffle.
    """
    changed = materialize(changed_names(head, index, work), "changed-names")
    contents = work.select("filename", "content").join(changed.select("filename").distinct(), "filename", "left_semi")
    return changed.join(contents, "filename", "left").select(
        "filename", "stage", F.concat_ws(" ", "stage", "filename").alias("file_ord"),
        F.lit("modified").alias("status"), F.lit("").alias("patch"), "content",
    )
