"""Cutting lineage and sizing, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when a count showed that it has no more rows than this (of a few dozen bytes each).
BROADCAST_ROWS = 200_000


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's shared spark.checkpoint.dir; where that is unset, local mode takes a temporary folder and a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors, ends the lineage."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as a Parquet table in the same shared folder: compressed, and only the columns that are asked for are read again."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table of written() through Spark's file system, once nothing reads it any more."""
    jvm = table.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a table for broadcast if its counted rows allow it; else Spark joins it as it sees fit (AQE splits hot keys)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def apart(grouped: DataFrame, by: str) -> DataFrame:
    """A grouped table dealt by another of its columns, before it is joined back by its key.

    The join then shuffles both sides itself, which is what lets AQE split a hot key; straight after the grouping it
    would stay in the grouping's partitions.
    """
    return grouped.repartition(by)


def beside(grouped: DataFrame, by: str, rows: int) -> DataFrame:
    """A grouped table of at most so many rows (counted), to be joined back by its key: broadcast if that is few, else apart()."""
    return F.broadcast(grouped) if rows <= BROADCAST_ROWS else apart(grouped, by)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
