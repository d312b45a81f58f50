"""Mixing sources to target weights by Poisson replication.

A source of ``n`` documents and target weight ``w`` has the repetition rate ``total * w / sum(w) / n``. Each document's
count is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from seed and doc_id. It is
exploded by its count, and the copies are shuffled globally: dealt by a hash and ordered by it.

Without given weights, a source weighs its size to the power ``POWER``; ``total`` is the number of documents unless given.
Nulls: a null source is a source of its own; null ids draw by their text; a null text stays null. Rows that repeat an id
draw the same count. A source of weight 0 goes; an empty table gives no rows. All input columns are kept; an input
column named like an added one (copy, copies, rate, shuffle_key) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlake.llm.common import whole
from reviewlake.session import materialize

SEED, POWER = 20240301, 0.7


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col("source").cast("string")), F.lit(""))


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, power: float = POWER) -> DataFrame:
    """``_source`` and ``rate``. ``weights`` has source and weight; sources that it doesn't name weigh nothing."""
    sizes = docs.groupBy(_host().alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow("n", F.lit(power)))
    else:
        given = weights.groupBy(_host().alias("_source")).agg(F.sum("weight").alias("w"))
        weighed = sizes.join(given, "_source")
    weighed = weighed.withColumn("w", F.col("w").cast("decimal(28,6)"))
    sums = weighed.agg(F.sum("n"), F.sum("w").cast("double")).first()
    if not sums[1]:
        return weighed.select("_source", F.lit(0.0).alias("rate")).where("false")
    scale = (sums[0] if total is None else total) / sums[1]
    return weighed.select("_source", (F.lit(scale) * F.col("w").cast("double") / F.col("n")).alias("rate")).where("rate > 0")


def distribution(rated: DataFrame) -> DataFrame:
    """``_source``, ``rate`` and ``cdf``: P(count <= k) for k from 0 to where the rest is below rounding."""
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 20).cast("int")
    steps = rated.select("_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    w = Window.partitionBy("_source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(w)
    steps = steps.withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - log_factorial))
    steps = steps.withColumn("c", F.sum("p").over(w))
    return steps.groupBy("_source", "rate").agg(F.sort_array(F.collect_list("c")).alias("cdf"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = SEED, power: float = POWER
) -> DataFrame:
    """The copies: all columns, ``copy`` (0, 1, ...), ``copies``, ``rate``, and ``shuffle_key``, by which they are ordered."""
    docs = docs.drop("copy", "copies", "rate", "shuffle_key")
    # a row for each source, written so that Spark knows its size: it broadcasts a small one, and splits hot sources otherwise
    table = materialize(distribution(rates(docs, weights, total, power)), "mix-rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(whole(F.col("text")))))
    rows = docs.select("*", _host().alias("_source"), name.alias("_name")).join(table, "_source")
    u = uniform(F.lit(str(seed)), F.col("_name"))
    rows = rows.withColumn("copies", F.size(F.filter("cdf", lambda c: c <= u)))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed} order"), F.col("_name"), F.col("copy").cast("string")))
    rows = rows.withColumn("shuffle_key", F.substring(key, 1, 16))
    rows = rows.select(*docs.columns, "copy", "copies", "rate", "shuffle_key")
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
