"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by seeded hashes; pass two puts each bucket through a
Fisher-Yates shuffle and deals the result to the shards in turn, beginning where the bucket before it ended, so that
shards differ by one row at most (law ``rows``). Buckets follow from the bytes of the table, so a bucket stays at about
``BUCKET_BYTES`` however large the table is. Neighbouring buckets share a partition of about ``PARTITION_BYTES``; what is known of
partitions everywhere is where each begins, eight bytes for each of them (25 MB for 100 TB).

Each bucket's random numbers start from the seed, and its rows are sorted before, so that a repeated task gives the same
order. Nulls: a null text takes no bytes; null ids are records like others. Repeated rows are kept, each with a slot of
its own: equal rows are counted and numbered, and a record's bucket is a hash of its number too, so copies of one row go to
all buckets, ``CHUNK`` of them made by a task at a time. An empty table gives no rows. An input column named
shard, slot, or one of the helper names ``_bucket``, ``_part``, ``_copy`` and ``_at`` is replaced or left out; columns must be of types that
can be sorted (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.llm.common import may_be_in, repeated_keys, whole

BUCKET_BYTES, PARTITION_BYTES, CHUNK = 8 * 2**20, 32 * 2**20, 10_000
SHARDS, SEED = 16, 20240229


def _hash(seed: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), whole(F.col("text")), *more)


def numbered(rows: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The rows with ``_copy``: 0, 1, ... for rows that are equal in all columns. Rows of one id and text are looked at
    for that; all others are passed through."""
    again = may_be_in(_hash(seed), repeated_keys(rows.select(_hash(seed).alias("key"))))
    alone = rows.where(~again).withColumn("_copy", F.lit(0).cast("long"))
    counted = rows.where(again).groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    dealt = chunks.repartition(_hash(seed, F.col("_chunk")))
    first = F.col("_chunk") * chunk
    last = F.least(F.col("_n"), first + chunk) - 1
    return alone.unionByName(dealt.withColumn("_copy", F.explode(F.sequence(first, last))).select(*rows.columns, "_copy"))


def scatter(rows: DataFrame, n_buckets: int, n_partitions: int, seed: int = SEED) -> DataFrame:
    """The rows with their bucket, a seeded hash of id, text and number, and its partition."""
    bucket = F.pmod(_hash(seed, F.col("_copy")), F.lit(n_buckets))
    rows = rows.withColumn("_bucket", bucket.cast("long"))
    return rows.withColumn("_part", F.expr(f"_bucket * {n_partitions} div {n_buckets}").cast("int"))


def table_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length(whole(F.col("text"))) + 64)).first()[0] or 0


def _starts(scattered: DataFrame, n_partitions: int) -> Column:
    """The number of rows before each partition, in order, as one value for the whole plan."""
    sizes = scattered.groupBy("_part").agg(F.count("*").alias("n"))
    every = sizes.sparkSession.range(n_partitions).select(F.col("id").cast("int").alias("_part")).join(sizes, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    return placed.agg(F.array_sort(F.collect_list(F.struct("_part", "start")))["start"].alias("starts")).scalar()


def shuffle_into_shards(
    rows: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All columns of the rows, with ``shard`` and ``slot`` (0, 1, ... in each shard). Partitions are in order of their buckets."""
    rows = rows.drop("shard", "slot", "_bucket", "_part", "_copy", "_at", "_n", "_chunk")
    total = table_bytes(rows)
    n_buckets = 1 + total // bucket_bytes
    n_partitions = min(n_buckets, 1 + total // PARTITION_BYTES)
    scattered = scatter(numbered(rows, seed), n_buckets, n_partitions, seed)
    record = F.struct(_hash(seed + 1, F.col("_copy")).alias("_at"), *rows.columns)
    buckets = scattered.repartitionById(n_partitions, F.col("_part")).groupBy("_part", "_bucket").agg(
        F.sort_array(F.collect_list(record)).alias("records")
    )
    before = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = buckets.withColumn("start", F.coalesce(F.sum(F.size("records")).over(before), F.lit(0)))
    placed = own.select(
        (F.get(_starts(scattered, n_partitions), F.col("_part")) + F.col("start")).alias("start"),
        F.shuffle("records", F.lit(seed + 2)).alias("records"),
    )
    dealt = placed.select("start", F.posexplode("records").alias("_at", "record"))
    at = F.col("start") + F.col("_at")
    return dealt.select(
        *(F.col("record").getField(c).alias(c) for c in rows.columns),
        F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), F.floor(at / n_shards).cast("long").alias("slot"),
    )


def write_shards(shards: DataFrame, folder: str) -> None:
    """One folder per shard, written by the tasks that hold the buckets, as they are: nothing is dealt again.

    A file holds a task's rows of one shard in order of their slots, and files are in order of their names.
    """
    shards.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
