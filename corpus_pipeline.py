"""A corpus pipeline in five stages: toxic documents go, one of each near-duplicate group stays, repeated passages go,
sources are mixed to weights, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, packing, substrings, toxicity
from lodestone.llm.cluster import cut, small

THRESHOLD = 80
#: Of a training sequence: tokens are at most packing.CAPACITY; besides, so many documents, and attention cost (the sum of squared lengths).
MAX_DOCUMENTS, MAX_ATTENTION = 64, 0.75 * packing.CAPACITY**2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels over all documents; documents that score 0.5 or more go.

    Null and empty texts get the score of no terms; equal texts fare alike; without both labels the verdict is the same for all.
    """
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of similarity 0.8 or more stays.

    Of several rows of that doc_id the least by text, then by the other columns, stays; rows without doc_id all stay,
    as do texts without words. An empty table gives an empty one.
    """
    found = neardup.link(docs.select("doc_id", "text"), THRESHOLD).filter("doc_id IS NOT NULL")
    found = cut(found.groupBy("doc_id").agg(F.every("kept").alias("kept"), (F.count("*") > 1).alias("several")))
    apart = found.filter("NOT kept OR several").select("doc_id")
    several = found.filter("kept AND several").select("doc_id")
    once = docs.join(small(apart), "doc_id", "left_anti").select(*docs.columns)
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    first = docs.join(small(several), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("__row"))
    return once.union(first.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller doc_id has go; documents with no words left go.

    Null and empty texts have no passages and stay; rows that share a doc_id don't repeat each other; null doc_ids come last.
    """
    return substrings.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for.

    Null and empty texts have size 0, and in a source of nothing else are never taken; a null source is one of its own; equal rows with one doc_id are drawn alike.
    """
    return mixing.emit(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequences of at most 2048 tokens, MAX_DOCUMENTS pieces and MAX_ATTENTION cost; a piece over that cost is alone.

    Null and empty texts are the end token alone; repeated rows are documents of their own.
    """
    return packing.pack(packing.pieces(docs), max_documents=MAX_DOCUMENTS, max_attention=MAX_ATTENTION).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack),
]
#: SQL can't express the scores of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
