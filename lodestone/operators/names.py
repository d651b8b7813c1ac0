"""Substring search of names by an index of trigrams: candidates have all trigrams of the pattern, and are then verified."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.lineage import folder, small

BUCKETS = 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams(symbols: DataFrame, id_col: str) -> DataFrame:
    """(bucket, gram, id) of symbols (id, name): the distinct runs of three characters of each lower-cased name."""
    low = F.lower("name")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(low, i, F.lit(3))))
    each = symbols.filter(F.length("name") >= 3).select(F.col(id_col).alias("id"), F.explode(runs).alias("gram"))
    return each.select(_bucket(F.col("gram")).alias("bucket"), "gram", "id")


def write(symbols: DataFrame, id_col: str, path: str | None = None) -> str:
    """Writes the index, by buckets of grams, sorted by gram and id; gives the path. A very common gram is dealt over several files."""
    spark = symbols.sparkSession
    path = path or folder(spark, "grams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = grams(symbols, id_col).repartition(parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "gram", "id")
    dealt.write.partitionBy("bucket").parquet(path)
    return path


def needed(part: str) -> list[str]:
    """The trigrams that every name with the part has: those between its wildcards."""
    return sorted({p[i : i + 3] for p in re.split("[%_]", part.lower()) for i in range(len(p) - 2)})


def grep(spark: SparkSession, path: str, symbols: DataFrame, part: str, id_col: str, limit: int = 50) -> DataFrame:
    """graph.grep_symbol() by the index at path: only symbols with all trigrams of the part are looked at; a part without any is looked for in all of them."""
    wanted = needed(part)
    if wanted:
        kind = symbols.schema[id_col].dataType.simpleString()
        index = spark.read.schema(f"gram string, id {kind}, bucket int").parquet(path)
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
        rows = index.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        held = rows.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select(F.col("id").alias(id_col))
        symbols = symbols.join(small(held), id_col, "left_semi")
    return symbols.filter(F.col("name").ilike("%" + part.replace("\\", "\\\\") + "%")).orderBy(id_col).limit(limit)
