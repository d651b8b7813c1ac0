"""An inverted file of vectors: lists around k-means centroids, of which a search reads the nearest, or exactly those that can matter.

Centroids come from a bounded sample; every vector is in the list of its nearest centroid. The lists are partitions of
a Parquet table, so a search opens no others. Each list's radius (the largest distance from its centroid) bounds what
its vectors can score: exact mode reads, after the nearest lists, those whose bound reaches a query's k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import SLICE, best_of, pieces
from lodestone.plans.lineage import cut, folder

#: Centroids are learnt from about so many vectors, by a hash of the id; there are at most so many (they are broadcast, and a row for each comes to the driver).
SAMPLE, MOST_LISTS = 100_000, 16_384
PROBES = 8
SLACK = 1e-6


@dataclass
class Lists:
    """An index on disk: where, the type of ids, the centroids, and of each list the radius and how many vectors it has."""

    path: str
    kind: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(id, embedding, list, apart)"""
        return spark.read.schema(f"id {self.kind}, embedding array<float>, apart double, list int").parquet(f"{self.path}/vectors")


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != (dim or sizes[0])).any():
        raise ValueError(f"vectors have {sorted({*sizes.tolist()})} dimensions; they must have the same number")
    return values.reshape(len(sizes), -1).astype(np.float64)


def train(vectors: DataFrame, id_col: str, lists: int | None = None, seed: int = 1) -> np.ndarray:
    """Centroids of vectors (id, embedding), by default about the square root of their number. Null vectors don't count."""
    usable = vectors.filter(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), "embedding")
    n = usable.count()
    if not n:
        return np.empty((0, 0))
    k = min(lists or math.isqrt(n), MOST_LISTS)
    share = min(1.0, SAMPLE / n)
    taken = usable.filter(F.xxhash64("id", F.lit("sample")) <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63)))
    features = taken.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    model = KMeans(k=max(2, k), seed=seed, maxIter=15, initSteps=1).fit(features)
    features.unpersist()
    return np.array(model.clusterCenters())


def build(vectors: DataFrame, id_col: str, centroids: np.ndarray, path: str | None = None) -> Lists:
    """Writes every vector of (id, embedding) into its nearest list. Null vectors are left out."""
    spark = vectors.sparkSession
    path = path or folder(spark, "lists")
    kind = vectors.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half = (c * c).sum(1) / 2
        for batch in batches:
            for rows in pieces(batch.num_rows, len(c)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                x = _matrix(part.column(1), c.shape[1])
                nearest = np.argmax(x @ c.T - half, axis=1)
                apart = np.sqrt(((x - c[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nearest, pa.int32()), pa.array(apart)], ["id", "embedding", "list", "apart"])

    chosen = vectors.filter(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    placed = chosen.mapInArrow(run, f"id {kind}, embedding array<float>, list int, apart double")
    # A list of very many vectors is several files.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(parts, "list", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("list").parquet(f"{path}/vectors")
    found = Lists(path, kind, centroids, np.empty(0), np.empty(0)).vectors(spark).groupBy("list").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect() if len(centroids) else []
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in found:
        radii[r.list], sizes[r.list] = r.radius, r.n
    return Lists(path, kind, centroids, radii, sizes)


def _asked(queries: DataFrame, index: Lists, probes: int, reached: bool) -> DataFrame:
    """(query, embedding, list) of queries (query, embedding): their nearest lists, by the bound of what these can score; given least (reached), those after them whose bound reaches it."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.sizes > 0))
    kind = queries.schema["query"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radii, filled = shared.value
        for batch in batches:
            # A vector goes out once for each of its lists, so few are taken at a time where there are many lists.
            for rows in pieces(batch.num_rows, len(centroids) * centroids.shape[1]):
                part = batch.slice(rows.start, rows.stop - rows.start)
                q = _matrix(part.column(1), centroids.shape[1])
                score = q @ centroids.T
                score[:, ~filled] = -np.inf
                order = np.argsort(-score, axis=1, kind="stable")
                if reached:
                    bound = score + np.sqrt((q * q).sum(1))[:, None] * radii
                    wanted = bound >= part.column(2).to_numpy(zero_copy_only=False)[:, None] - SLACK
                    np.put_along_axis(wanted, order[:, :probes], False, axis=1)
                else:
                    wanted = np.zeros(score.shape, bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                wanted &= filled
                row, list_ = np.nonzero(wanted)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(list_, pa.int32())], ["query", "embedding", "list"])

    return queries.mapInArrow(run, f"query {kind}, embedding array<float>, list int")


def _scored(spark: SparkSession, index: Lists, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k best of each asked (query, list), in blocks of about SLICE vectors and queries that meet in one task each."""
    asked = cut(asked)
    counts = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
    parts = [(x, max(1, -(-int(index.sizes[x]) // SLICE)), max(1, -(-n // SLICE))) for x, n in counts.items()]
    blocks = F.broadcast(spark.createDataFrame(parts, "list int, m int, n int"))
    query_kind = asked.schema["query"].dataType.simpleString()
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = index.vectors(spark).filter(F.col("list").isin(list(counts))).join(blocks, "list").select("list", own("id", "m").alias("i"), spread("n").alias("j"), "id", "embedding")
    right = asked.join(blocks, "list").select("list", spread("m").alias("i"), own("query", "n").alias("j"), "query", "embedding")

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        v, q = v.combine_chunks(), q.combine_chunks()
        if not len(v) or not len(q):
            return pa.table({"query": q.column("query").slice(0, 0), "id": v.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        v = v.take(pa.compute.sort_indices(v.column("id")))
        x = _matrix(v.column("embedding").combine_chunks())
        row, found, score = best_of(_matrix(q.column("embedding").combine_chunks(), x.shape[1]), x, k)
        return pa.table({"query": q.column("query").take(pa.array(row)), "id": v.column("id").take(pa.array(found)), "score": score})

    keys = ("list", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query {query_kind}, id {index.kind}, score double")


def search(index: Lists, queries: DataFrame, query_col: str, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query, id, score, rank): the k best vectors of the index for each of queries (query, embedding) by dot product, ties by id.

    The probes nearest lists are read; exact reads besides every list that can hold a better vector than the k-th found,
    which gives what a search of all vectors gives. Null queries are left out; all vectors must have one number of dimensions.
    """
    spark = queries.sparkSession
    queries = queries.filter(F.col("embedding").isNotNull()).select(F.col(query_col).alias("query"), F.col("embedding").cast("array<float>").alias("embedding"))
    best = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "id")
    cut_to_k = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = cut_to_k(_scored(spark, index, _asked(queries, index, probes, False), k))
    if exact:
        found = cut(found)
        least = found.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        open_ = queries.join(least, "query", "left").select("query", "embedding", F.coalesce("least", F.lit(-1e300)).alias("least"))
        found = cut_to_k(found.drop("rank").union(_scored(spark, index, _asked(open_, index, probes, True), k)))
    return found.select(F.col("query").alias(query_col), "id", "score", "rank")


def calibrate(index: Lists, vectors: DataFrame, id_col: str, k: int, recall: float = 0.95, asked: int = 200) -> int:
    """The least number of probes with which about so many of the vectors themselves, by a hash, find this share of their exact k best.

    Exact mode tells the lists of the best ones; where a list stands in a query's order is how many probes it takes.
    """
    spark = vectors.sparkSession
    share = min(1.0, asked / max(1, int(index.sizes.sum())))
    queries = cut(vectors.filter(F.col("embedding").isNotNull() & (F.xxhash64(id_col, F.lit("asked")) <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63)))).select(F.col(id_col).alias("query"), "embedding"))
    best = F.broadcast(search(index, queries, "query", k, exact=True).select("query", "id"))  # k rows for each of the asked
    where = best.join(index.vectors(spark).select("id", "list"), "id").join(queries, "query").select("embedding", "list").toArrow().combine_chunks()
    if not len(where):
        return PROBES
    score = _matrix(where.column("embedding").combine_chunks()) @ index.centroids.T
    score[:, index.sizes == 0] = -np.inf
    own = score[np.arange(len(where)), where.column("list").to_numpy()]
    needed = np.sort((score > own[:, None]).sum(1) + 1)
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
