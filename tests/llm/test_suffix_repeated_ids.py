"""Different texts under one id, or without an id, are told apart whatever a 32-bit hash says of them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import suffix_dedup

PASSAGE = "this passage is held by all of the texts below and is longer than fifty bytes"


@pytest.fixture(scope="module")
def clashing(spark):
    """Two texts of different lengths with one 32-bit hash."""
    text = F.concat(F.md5(F.col("id").cast("string")), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")), F.lit(PASSAGE))
    texts = spark.range(400_000).select("id", F.hash(text).alias("h"), text.alias("text"))
    pair = texts.groupBy("h").agg(F.min_by("text", F.length("text")).alias("short"), F.max_by("text", F.length("text")).alias("long"))
    return pair.where(F.length("short") < F.length("long")).select("short", "long").first()


@pytest.mark.parametrize("doc_id", [7, None])
def test_clashing_texts_of_one_id(spark, clashing, doc_id):
    assert len(clashing.short) < len(clashing.long)
    first = [(-5, f"{PASSAGE} and the first document")] if doc_id else []
    rows = [*first, (doc_id, clashing.short), (doc_id, clashing.long), (9, clashing.long), (10, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    ids = [(-(10**9) if i is None else i, t) for i, t in rows]
    want = []
    for (i, text), (shown, _) in zip(ids, rows):
        data = text.encode()
        earlier = {t.encode()[k : k + 50] for j, t in ids if j < i for k in range(max(0, len(t) - 49))}
        gone = [any(data[k : k + 50] in earlier for k in range(max(0, at - 49), at + 1) if len(data) - k >= 50) for at in range(len(data))]
        spans = sum(g and (at == 0 or not gone[at - 1]) for at, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want.append((shown, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_only_repeated_ids_have_tags(spark):
    docs = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.lit(5)).alias("doc_id"), F.lit("t").alias("text"))
    tags = docs.select("doc_id", suffix_dedup._tag(docs.select("doc_id"), F.col("doc_id"), F.col("text")).alias("tag"))
    assert {r.doc_id for r in tags.where("tag <> 0").collect()} - {5} == set() and tags.where("tag <> 0").count() == 11
