import collections
import glob
import os

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import sharding


@pytest.fixture(scope="module")
def docs(spark):
    """A row that three in four rows repeat, one without an id that comes a hundred times, and others."""
    n = 4000
    doc_id = F.when(F.col("id") < 3000, F.lit(7)).when(F.col("id") < 3100, F.lit(None)).otherwise(F.col("id"))
    text = F.when(F.col("id") < 3000, F.repeat(F.lit("hot "), 50)).when(F.col("id") < 3100, F.lit(None)).otherwise(
        F.concat(F.lit("own "), "id"))
    return spark.range(n).select(doc_id.alias("doc_id"), text.alias("text"), F.lit("b").alias("_bucket"), F.lit(1).alias("more"))


def test_copies_use_all_buckets(spark, docs):
    rows = docs.drop("_bucket")
    made = sharding.numbered(rows, chunk=100)
    assert made.count() == 4000 and made.select("doc_id", "text", "_copy").distinct().count() == 4000
    assert made.where("doc_id = 7").agg(F.max("_copy"), F.count_distinct("_copy")).first() == (2999, 3000)
    sizes = collections.Counter(r._bucket for r in sharding.scatter(made, 10, 3).select("_bucket").collect())
    assert len(sizes) == 10 and max(sizes.values()) < 1.3 * 400
    parts = {(r._bucket, r._part) for r in sharding.scatter(made, 10, 3).select("_bucket", "_part").distinct().collect()}
    assert sorted(p for _, p in sorted(parts)) == [p for _, p in sorted(parts)] and {p for _, p in parts} == {0, 1, 2}


@pytest.mark.parametrize("bucket_bytes", [20_000, 10**9])
def test_law_and_same_result_for_any_partitions(docs, bucket_bytes):
    columns = ["doc_id", "text", "more", "shard", "slot"]
    out = sharding.shuffle_into_shards(docs, 16, bucket_bytes=bucket_bytes)
    assert out.columns == columns
    rows = out.collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [250] * 16
    assert all(sorted(s) == list(range(250)) for s in slots.values())
    hot = collections.Counter(r.shard for r in rows if r.doc_id == 7)
    assert sum(hot.values()) == 3000 and min(hot.values()) > 130
    again = sharding.shuffle_into_shards(docs.repartition(7), 16, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_shards_are_written_by_the_tasks_of_the_buckets(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PARTITION_BYTES", 100_000)
    shards = sharding.shuffle_into_shards(docs, 4, bucket_bytes=20_000)
    folder = str(tmp_path / "shards")
    sharding.write_shards(shards, folder)
    read = spark.read.parquet(folder)
    assert sorted(map(repr, read.select(*shards.columns).collect())) == sorted(map(repr, shards.collect()))
    for shard in range(4):
        files = sorted(glob.glob(f"{folder}/shard={shard}/part-*.parquet"))
        assert len(files) > 1
        slots = [r.slot for f in files for r in spark.read.parquet(f).select("slot").collect()]
        assert slots == list(range(1000))
    assert not os.path.exists(f"{folder}/shard=4")
