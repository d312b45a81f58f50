"""Where to keep data that outlives a job: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="reviewlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting to remove the shuffle files of a query when the query ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    A written table survives the loss of executors and keeps column pruning for its readers. With ``drop_shuffles`` the files of
    the shuffles behind it go as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    try:
        if drop_shuffles:
            spark.conf.set(_DROP_SHUFFLES, "true")
        df.write.parquet(folder)
    finally:
        if drop_shuffles:
            spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Gives a small table as many partitions as there are cores; a larger one is left alone.

    Scanning is bound by CPU, and a small file is otherwise one task however much text it holds.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
