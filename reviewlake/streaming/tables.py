"""A table that a stream adds to batch by batch, and that readers see merged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class MergedTable:
    """Rows kept below ``folder``; ``merge`` makes one state out of the rows of several, and of its own results again.

    A batch is merged and written under its number, so a batch that is run again replaces itself. Every
    ``compact_every`` batches, all rows so far are merged into a base, and readers take the last base with the batches after it:
    a read merges a bounded number of batches however long the stream runs. Neither looks at what it has not to.
    """

    folder: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    compact_every: int = 16

    def add(self, batch: DataFrame, number: int) -> None:
        """As the function of ``foreachBatch``."""
        self._write(self.merge(batch), "batch", number)
        if (number + 1) % self.compact_every == 0:
            self._write(self.read(batch.sparkSession, number), "base", number)

    def read(self, spark: SparkSession, last: int | None = None) -> DataFrame:
        """The state after batch ``last``, or after all there are."""
        # the names of folders, a column that is not stored, tell kind and number; files of others are not opened
        rows = spark.read.schema(f"{self.schema}, kind string, number long").parquet(self.folder)
        upto = rows if last is None else rows.where(F.col("number") <= last)
        bases = upto.where("kind = 'base'")
        if last is not None and (last + 1) % self.compact_every == 0:
            bases = bases.where(F.col("number") < last)  # it is the one to be written
        base = bases.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
        own = upto.where(
            ((F.col("kind") == "base") & (F.col("number") == base)) | ((F.col("kind") == "batch") & (F.col("number") > base))
        )
        return self.merge(own.drop("kind", "number"))

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/kind={kind}/number={number}")
