"""Cutting lineage and spreading small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when a count showed that it has no more rows than this.
BROADCAST_ROWS = 200_000


def use_checkpoints(spark: SparkSession) -> str:
    """The cluster's shared spark.checkpoint.dir, as checkpoint folder; where it is unset, local mode takes a temporary one and a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables beside the checkpoints."""
    return f"{use_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the same shared folder: compressed, and only the columns that are asked for are read again."""
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a table for broadcast if its counted rows allow it."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out before work that is heavy per row, where the input has fewer partitions than the cluster has cores; larger inputs are left as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out by key before work that is heavy per row, where one partition holds half as much again as a core's share of them: a Parquet file's row group is read by one task, however many parts the file has. What is spread already is left as it was read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key) if (held[0] or 0) * cores > 1.5 * (held[1] or 0) else df
