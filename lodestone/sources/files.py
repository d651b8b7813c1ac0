"""Source trees as DataFrames and the incremental index on Parquet snapshots."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import EXTENSIONS, is_ignored, language_of
from lodestone.operators import graph
from lodestone.operators.chunking import chunk
from lodestone.plans.lineage import cut

TABLES = ("chunks", "symbols", "imports", "calls")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, text, sha1) of a tree's source files, by path relative to root; ignored folders and unknown extensions drop out before any file is opened.

    A first scan takes paths alone, of files with a known extension; the folders that hold wanted ones are then read
    without those below them. The driver sees folder names, which it lists for any file source.
    """
    known = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for all_ in EXTENSIONS.values() for x in all_) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", known)
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")

    def relative(path: Column) -> Column:
        return F.substring(path, F.instr(path, f"{top}/") + F.lit(len(top) + 1), F.lit(1 << 30))

    paths = reader.option("recursiveFileLookup", True).load(_escaped(root)).select("path")
    kept = paths.filter(language_of(relative(F.col("path"))).isNotNull() & ~is_ignored(relative(F.col("path"))))
    folders = [r.folder for r in kept.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct().toLocalIterator()]
    if not folders:
        return spark.createDataFrame([], "file_path string, language string, text string, sha1 string")
    files = reader.option("recursiveFileLookup", False).load([_escaped(f) for f in folders])
    files = files.withColumn("file_path", relative(F.col("path"))).withColumn("language", language_of(F.col("file_path"))).filter("language IS NOT NULL")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return files.select("file_path", "language", text.alias("text")).withColumn("sha1", F.sha1("text"))


def _escaped(path: str) -> str:
    """A path whose characters that mean something in a glob stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def delta(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(file_path, action) of stored and seen (file_path, sha1; seen.sha1 is null for unreadable files): rebuilt, unchanged, removed or skipped."""
    both = stored.select("file_path", F.col("sha1").alias("old"), F.lit(True).alias("had")).join(seen.select("file_path", F.col("sha1").alias("new"), F.lit(True).alias("has")), "file_path", "full_outer")
    action = F.when(F.col("has").isNull(), "removed").when(F.col("new").isNull(), "skipped").when(F.col("old") == F.col("new"), "unchanged").otherwise("rebuilt")
    return both.select("file_path", action.alias("action"))


def apply(table: DataFrame, actions: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot of any table with file_path: rows of rebuilt and removed files go, fresh ones come."""
    gone = actions.filter(F.col("action").isin("rebuilt", "removed")).select("file_path")
    return table.join(gone, "file_path", "left_anti").unionByName(fresh)


def tables(chunks: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index of chunks (as chunking.chunk() gives them, with file_sha1 and others): chunks, symbols, imports and calls."""
    symbols = graph.symbols(chunks).select("file_path", F.col("symbol_name").alias("name"), F.col("symbol_kind").alias("kind"), "language", "start_line", "end_line")
    return {"chunks": chunks, "symbols": symbols, "imports": graph.imports(chunks), "calls": graph.calls(chunks)}


def build(files: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The index of files (file_path, language, text, sha1): its tables, chunks with file_sha1 and, given embed (chunks to chunks with embedding), vectors. Files are chunked once, all tables come of the chunks kept. Blank files and unknown languages give nothing."""
    chunks = chunk(files).join(files.select("file_path", F.col("sha1").alias("file_sha1")), "file_path")
    return tables(cut(chunks if embed is None else embed(chunks)))


def update(index: dict[str, DataFrame], files: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The index after files (all of them, as they are now): only rebuilt files are chunked, and all of their rows are replaced in every table; removed files go."""
    stored = index["chunks"].select("file_path", F.col("file_sha1").alias("sha1")).distinct()
    actions = cut(delta(stored, files.select("file_path", "sha1")))
    fresh = build(files.join(actions.filter("action = 'rebuilt'"), "file_path", "left_semi"), embed)
    return {name: apply(table, actions, fresh[name]) for name, table in index.items()}


def write_index(index: dict[str, DataFrame], path: str) -> int:
    """Writes a new snapshot of all tables beside the old ones; its number enters the list of snapshots last, so that readers see whole ones only."""
    spark = index["chunks"].sparkSession
    number = time.time_ns()
    for name, table in index.items():
        table.write.parquet(f"{path}/{name}/snapshot={number}")
    spark.createDataFrame([(number,)], "snapshot long").write.mode("append").parquet(f"{path}/snapshots")
    return number


def read_index(spark: SparkSession, path: str, snapshot: int | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the newest complete one by default."""
    number = snapshot or spark.read.parquet(f"{path}/snapshots").agg(F.max("snapshot")).first()[0]
    return {name: spark.read.parquet(f"{path}/{name}/snapshot={number}") for name in TABLES}


#: Files of a bucketed index go by a hash of their path into so many buckets.
BUCKETS = 64


def bucket_of(file_path: Column) -> Column:
    return F.pmod(F.xxhash64(file_path), F.lit(BUCKETS)).cast("int")


def _put(index: dict[str, DataFrame], path: str, version: int) -> None:
    for name, table in index.items():
        placed = table.withColumn("version", F.lit(version)).withColumn("bucket", bucket_of(F.col("file_path")))
        placed.repartition("bucket", F.pmod(F.xxhash64("file_path", F.lit(1)), F.lit(4))).write.mode("append").partitionBy("version", "bucket").parquet(f"{path}/{name}")


def _manifest(spark: SparkSession, path: str, snapshot: int | None = None) -> dict[int, int]:
    """The version of each bucket in a snapshot, the newest by default: BUCKETS rows."""
    all_ = spark.read.parquet(f"{path}/manifest")
    number = snapshot or all_.agg(F.max("snapshot")).first()[0]
    return {r.bucket: r.version for r in all_.filter(F.col("snapshot") == number).collect()}


def write_buckets(index: dict[str, DataFrame], path: str) -> int:
    """Writes a new index by buckets of files. The manifest, which names the version of every bucket, is written last: it is what makes a snapshot visible. Gives the snapshot."""
    version = time.time_ns()
    for name, table in index.items():
        table.limit(0).write.mode("overwrite").parquet(f"{path}/schemas/{name}")  # a table of no rows has no other files
    _put(index, path, version)
    return _commit(index["chunks"].sparkSession, path, dict.fromkeys(range(BUCKETS), version), version)


def _commit(spark: SparkSession, path: str, manifest: dict[int, int], snapshot: int) -> int:
    rows = [(snapshot, bucket, version) for bucket, version in manifest.items()]
    spark.createDataFrame(rows, "snapshot long, bucket int, version long").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return snapshot


def read_buckets(spark: SparkSession, path: str, snapshot: int | None = None, buckets: list[int] | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the newest by default; given buckets, of these alone. Filters are on partitions, so nothing else is opened."""
    versions: dict[int, list[int]] = {}
    for bucket, version in _manifest(spark, path, snapshot).items():
        if buckets is None or bucket in buckets:
            versions.setdefault(version, []).append(bucket)
    wanted = F.lit(False)
    for version, own in versions.items():
        wanted = wanted | ((F.col("version") == version) & F.col("bucket").isin(own))
    schemas = {name: spark.read.parquet(f"{path}/schemas/{name}").schema.add("version", "long").add("bucket", "integer") for name in TABLES}
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}").filter(wanted).drop("version", "bucket") for name, schema in schemas.items()}


def update_buckets(spark: SparkSession, path: str, files: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Brings the index at path to files (all of them, as they are now) and gives the new snapshot.

    Only buckets with a rebuilt or removed file are written, as new versions beside the old ones; the others stay as
    they are. Readers see the snapshot before or after, never between; older snapshots stay readable.
    """
    index = read_buckets(spark, path)
    stored = index["chunks"].select("file_path", F.col("file_sha1").alias("sha1")).distinct()
    actions = cut(delta(stored, files.select("file_path", "sha1")).filter(F.col("action").isin("rebuilt", "removed")))
    touched = [r[0] for r in actions.select(bucket_of(F.col("file_path"))).distinct().collect()]
    if not touched:
        return spark.read.parquet(f"{path}/manifest").agg(F.max("snapshot")).first()[0]
    fresh = build(files.join(actions.filter("action = 'rebuilt'"), "file_path", "left_semi"), embed)
    old, version = read_buckets(spark, path, buckets=touched), time.time_ns()
    _put({name: apply(table, actions, fresh[name]) for name, table in old.items()}, path, version)
    return _commit(spark, path, _manifest(spark, path) | dict.fromkeys(touched, version), version)
