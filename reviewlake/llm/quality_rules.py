"""Quality rules: words and repeats of each text, and how often its lines occur across its host.

Normalised lines are hashed; a line found in more than ``max_docs`` documents of a host is removed from all of
them but the one of the smallest doc_id. A document of which too little is left is rejected.

Nulls: a null text is empty and fails the base rules; a null source is a host of its own; a null doc_id counts as one
document, smaller than all others. Rows that repeat an id count as one document of that id. An empty table gives no
rows. Columns beyond doc_id, text and source are neither read nor in the way, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewlake.llm.common import (
    NULL_ID, ascii_lower, lines, n_words, real_id, row_key, strip, whole, without_lines, words,
)

WINDOW = 5
MAX_DOCS = 20
MIN_WORDS = 10
MIN_LEFT_PERCENT = 50
KEY = ("doc_id", "text_key", "host")


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit("")).alias("host")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, host and the base counts of every text, computed inside the row."""
    rows = row_key(docs, _host()).select(
        *KEY, words(F.col("text")).alias("w"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(lines(F.col("text")), lambda line: strip(line) != "").alias("own"),
    )
    rows = rows.select(
        *KEY, "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("own") - F.size(F.array_distinct("own"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda word: F.xxhash64(word)).alias("h"),
    )
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    rows = rows.withColumn("windows", F.transform(at, lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW)))))
    rows = rows.drop("h").withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(F.col("repeats"), by_hash)).drop("windows")

    def found_twice(x: Column, i: Column) -> Column:
        same = lambda other: F.coalesce(F.get("sorted", other)["h"] == x["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("sorted", found_twice), lambda x: x["i"])))
    reach = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    return rows.select(
        *KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: host, two hashes of the normalised line, number of words, position."""
    rows = row_key(docs, _host()).select(*KEY, F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", ascii_lower(strip(F.col("line")))).where("line <> ''")
    return rows.select(
        *KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        n_words(F.col("line")).alias("line_words"),
    )


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The lines above the limit, but for those of the first document of the host that holds them."""
    rows = host_lines(docs)
    frequent = rows.groupBy("host", "h1", "h2").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")
    ).where(F.col("n_docs") > max_docs)
    found = rows.join(frequent, ["host", "h1", "h2"]).where("doc_id <> first_doc")
    return found.select(*KEY, "pos", "line_words").dropDuplicates([*KEY, "pos"])


def _judged(docs: DataFrame, max_docs: int) -> DataFrame:
    gone = removed_lines(docs, max_docs).groupBy(*KEY).agg(
        F.sum("line_words").alias("n_removed_words"), F.collect_list("pos").alias("gone")
    )
    counts = base_counts(docs).join(gone, [*KEY], "left")
    counts = counts.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    enough = (left >= MIN_WORDS) & (100 * left >= MIN_LEFT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Counts and verdict of every document; texts cross no shuffle."""
    return _judged(docs, max_docs).select(
        real_id(F.col("doc_id")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_removed_words",
    )


def apply_rules(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents that are kept, without the lines above the limit; columns as before.

    ``n_chars``, where there is such a column, follows the text of documents that lost lines.
    """
    kept = _judged(docs, max_docs).groupBy(*(F.col(c).alias(f"_{c}") for c in KEY)).agg(
        F.bool_and("kept").alias("_kept"), F.any_value("gone").alias("_gone")
    ).where("_kept")
    keyed = docs.select(
        "*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_doc_id"),
        F.xxhash64(whole(F.col("text"))).alias("_text_key"), _host().alias("_host"),
    )
    rows = keyed.join(kept, [f"_{c}" for c in KEY])
    intact = F.col("_gone").isNull()
    text = F.when(intact, F.col("text")).otherwise(without_lines(F.col("text"), F.col("_gone")))
    rows, changed = rows.withColumn("_left", text), {"text": F.col("_left")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(intact, F.col("n_chars")).otherwise(F.char_length("_left").cast(kind))
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))
