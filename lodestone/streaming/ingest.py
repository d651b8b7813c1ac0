"""Streaming ingest (an extension): changed files of a landing folder become chunks of the index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import language_of
from lodestone.operators.chunking import chunk

SCHEMA = "file_path string, text string, version long"


def stream_chunks(spark: SparkSession, landing: str, index: str, checkpoint: str):
    """Starts a query over Parquet files (file_path, text, version); each micro-batch is chunked and written under its batch number, so a replayed batch overwrites itself.

    Of a file that comes twice in a batch the text of the highest version counts (without versions, or of one version, the greatest). A batch also lists its files, those without any
    chunks included: current() shows each file as of its last batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("file_path").agg(F.max_by("text", F.struct("version", "text")).alias("text"))
        files = once.withColumn("language", language_of(F.col("file_path"))).filter("language IS NOT NULL")
        files.select("file_path").write.mode("overwrite").parquet(f"{index}/files/batch={number}")
        chunk(files).write.mode("overwrite").parquet(f"{index}/chunks/batch={number}")

    return spark.readStream.schema(SCHEMA).parquet(landing).writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()


def current(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of the streamed index, each file's of its last batch alone."""
    last = spark.read.parquet(f"{index}/files").groupBy("file_path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{index}/chunks").join(last, ["file_path", "batch"], "left_semi").drop("batch")
