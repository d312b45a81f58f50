"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches, by falling doc_id. A batch is reduced to one entry per line key. Keys that no run holds yet
(anti join) go into the batch's own run with the document that keeps the line, the largest of the batch and so of all; keys that
some run holds go into it with their counts alone. Runs are bucketed and sorted by key, so that these joins read runs
without shuffling them, and ``fan_in`` runs of a level are compacted into one of the next. Entries of a key add up over the
runs: documents that hold it, and the one that keeps it. Callers that add batches as they arrive get the first
batch's document as the keeper.

A key is a line without blanks at its ends, A-Z lower-cased, of at least ``min_chars`` code points, as two 64-bit
hashes. Nulls: a null text is one empty line; a null doc_id counts as one document, smaller than all others. Rows that
repeat an id are one document of that id and are all treated alike. An empty table gives no rows. Columns beyond doc_id
and text are neither read nor in the way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.llm.common import NULL_ID, ascii_lower, kept_positions, lines, real_id, row_key, strip
from reviewlake.session import materialize, new_folder

MIN_CHARS, MIN_DOCS, BATCHES, FAN_IN = 40, 5, 4, 2
KEY = ["k1", "k2"]


class LineRuns:
    """The levels of runs: tables in the shared folder, bucketed and sorted by key."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in, self.levels = spark, fan_in, [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, entries: DataFrame) -> DataFrame:
        """Adds the entries of one batch (k1, k2, n_docs, max_doc) as a run, and returns that run."""
        runs = self.all()
        if runs is not None:
            held = runs.select(*KEY).distinct()
            again = entries.join(held, KEY, "left_semi").withColumn("max_doc", F.lit(None).cast("long"))
            entries = entries.join(held, KEY, "left_anti").unionByName(again)
        run = self._write(entries, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._write(_merged(_union([self.spark.table(name) for name in full])), level + 1)
            self._drop(full)
            level += 1
        return run

    def all(self) -> DataFrame | None:
        """The entries of all runs, one for each key and run."""
        names = [name for level in self.levels for name in level]
        return _union([self.spark.table(name) for name in names]) if names else None

    def totals(self) -> DataFrame:
        return _merged(self.all())

    def drop(self) -> None:
        """Takes the runs out of the catalog; tables that were read from them before must be written."""
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, entries: DataFrame, level: int) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = entries.repartition(self.buckets, *KEY)
        rows.write.format("parquet").option("path", new_folder(self.spark, f"run{level}")).bucketBy(
            self.buckets, *KEY
        ).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)


def _union(tables: list[DataFrame]) -> DataFrame:
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    return rows


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, pos, k1, k2 of every line that is long enough."""
    rows = row_key(docs).select("doc_id", "text_key", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", strip(F.col("line"))).where(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return rows.select("doc_id", "text_key", "pos", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


def entries(keys: DataFrame) -> DataFrame:
    """One entry per key: documents that hold it, and the largest doc_id."""
    return keys.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN
) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every document without the lines that ``min_docs`` documents hold, but for those
    in the largest doc_id that holds them. All documents with one id are in one batch, batches are ranges of ids."""
    spark = docs.sparkSession
    folder = new_folder(spark, "line-keys")
    shares = [1 - (at + 1) / batches for at in range(batches - 1)]
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"))
    cuts = (ids.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None) or []
    batch = sum((F.when(F.col("doc_id") <= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    line_keys(docs, min_chars).withColumn("batch", batch).write.partitionBy(
        "batch"
    ).parquet(folder)
    keys = spark.read.schema("doc_id long, text_key long, pos int, k1 long, k2 long, batch int").parquet(folder)
    runs = LineRuns(spark, fan_in)
    for batch in range(batches):
        runs.add(entries(keys.where(F.col("batch") == batch)))
    # written: then the runs can go, and Spark can split a hot line between two sides that it deals for the join itself
    repeated = materialize(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "max_doc"), "repeated-lines")
    runs.drop()
    gone = keys.join(repeated, KEY).where("doc_id <> max_doc").groupBy("doc_id", "text_key").agg(
        F.collect_set("pos").alias("gone")
    )
    rows = row_key(docs).join(gone, ["doc_id", "text_key"], "left").withColumn("own", lines(F.col("text")))
    rows = rows.withColumn("stay", kept_positions(F.size("own"), F.col("gone")))
    return rows.select(
        real_id(F.col("doc_id")).alias("doc_id"),
        F.array_join(F.transform("stay", lambda i: F.get("own", i)), "\n").alias("text"),
        F.size("own").cast("long").alias("n_lines"), (F.size("own") - F.size("stay")).cast("long").alias("n_dropped"),
    )
