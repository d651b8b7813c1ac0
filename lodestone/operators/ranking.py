"""Ranking: BM25, cosine, reciprocal rank fusion, retrieval, grouping of hits. Ties go by id everywhere."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import CACHED, query_tokens, token_counts, word_counts
from lodestone.plans.lineage import cut, spread

K1, B = 1.5, 0.75
RRF_K = 60
OVER_FETCH = 4
#: Vectors of a block in a search of many queries.
SLICE = 4_096
#: Texts whose terms are counted into one batch.
TEXTS = 256
#: Numbers of a matrix of products that a task holds at a time.
PAIRS = 1 << 20
MODES = ("hybrid", "cosine", "bm25")


def term_counts(docs: DataFrame, terms: list[str], id_col: str, text_col: str = "text") -> DataFrame:
    """(id, dl, tf array) in one pass: only the query's terms are counted, and no postings are shuffled. A text's words are counted first, and each word's tokens found once."""
    place = {term: i for i, term in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        for batch in batches:
            lengths, counts = [], []
            for text in batch.column(1):
                length, found = 0, [0] * len(terms)
                for word, n in word_counts(text.as_py()).items():
                    if (known := told.get(word)) is None:
                        tokens_ = token_counts(word)
                        known = sum(c for _, c in tokens_), [(place[t], c) for t, c in tokens_ if t in place]
                        if len(told) < CACHED:
                            told[word] = known
                    length += n * known[0]
                    for i, c in known[1]:
                        found[i] += n * c
                lengths.append(length)
                counts.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(counts, pa.list_(pa.int64()))], ["id", "dl", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"id {kind}, dl long, tf array<long>").withColumnRenamed("id", id_col)


def all_term_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, dl, term, tf) of every row and term of docs (id, text), row by row: nothing is shuffled, so rows of one id are counted apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, sizes, lengths, terms, counts = batch.slice(at, TEXTS), [], [], [], []
                for text in part.column(1):
                    tf: dict[str, int] = {}
                    for word, n in word_counts(text.as_py()).items():
                        for token, c in token_counts(word):
                            tf[token] = tf.get(token, 0) + n * c
                    sizes.append(len(tf))
                    lengths.append(sum(tf.values()))
                    terms += tf
                    counts += tf.values()
                row = np.repeat(np.arange(part.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.array(lengths, np.int64)[row]), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["id", "dl", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"id {kind}, dl long, term string, tf long").withColumnRenamed("id", id_col)


def terms_of(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, tf) with one row per id and term; counts are added by id only where an id has several rows, which one look at the ids tells."""
    counts = all_term_counts(docs, id_col, text_col).drop("dl")
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("__n")).filter("__n > 1").limit(1).count()
    return counts.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")) if repeated else counts


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, score) of every document, 0 without a term; repeated query terms add again."""
    weight = Counter(query_tokens(query))
    terms = sorted(weight)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    counts = cut(term_counts(docs, terms, id_col, text_col))  # both the statistics and the scores need it
    stats = counts.agg(F.count("*").alias("__n"), F.avg("dl").alias("__avg"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]).alias("__df"))
    joined = counts.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        n, f = F.col("__df")[i], F.col("tf")[i]
        idf = F.log((F.col("__n") - n + 0.5) / (n + 0.5) + 1.0)
        long = 1 - B + B * F.col("dl") / F.greatest(F.col("__avg"), F.lit(1.0))
        return F.when(f > 0, weight[terms[i]] * idf * (f * (K1 + 1)) / (f + K1 * long)).otherwise(0.0)

    return joined.select(id_col, sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """(id, score) of every unit vector against the one row of query (the same column); null vectors drop out."""
    one = F.broadcast(query.select(F.col(vector_col).alias("__q")).limit(1))
    return vectors.filter(F.col(vector_col).isNotNull()).crossJoin(one).select(id_col, dot(F.col(vector_col), F.col("__q")).alias("score"))


def top(scores: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best with their rank from 1: cut first, so that the ranks are counted over k rows only."""
    best = scores.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows, so that a matrix of a slice by width has no more than PAIRS numbers (or is one row)."""
    step = max(1, PAIRS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def best_of(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, row of vectors, score) of the k best for each query, ties by row; all products of a few queries are held at a time."""
    vectors, rows, found, score = vectors.astype(np.float64), [], [], []
    for part in pieces(len(queries), len(vectors)):
        scores = queries[part].astype(np.float64) @ vectors.T
        order = np.argsort(-np.round(scores, 6), axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(scores)), order.shape[1])
        rows.append(row + part.start)
        found.append(order.ravel())
        score.append(scores[row, order.ravel()])
    return (np.concatenate(rows), np.concatenate(found), np.concatenate(score)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def cosine_batch(chunks: DataFrame, queries: DataFrame, id_col: str, query_col: str, k: int) -> DataFrame:
    """(query, id, score, rank): the k best chunks (id, embedding) for each of queries (query, embedding), all against all in blocks, exact.

    Both sides are dealt by hash into blocks of about SLICE vectors; each two blocks meet in one task as one matrix
    product, which passes on its own k best per query only. Null vectors are left out, ties go by id.
    """
    sides = []
    for df, id_ in ((chunks, id_col), (queries, query_col)):
        df = df.filter(F.col("embedding").isNotNull()).select(F.col(id_).alias("id"), "embedding")
        n = max(1, -(-df.count() // SLICE))
        sides.append((df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n))
    (vectors, n), (asked, m) = sides
    left = vectors.select(F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(0).alias("side"), "id", "embedding")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "embedding")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids = table.column("side").to_numpy(), np.array(table.column("id").to_pylist())
        v, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        v = v[np.argsort(ids[v], kind="stable")]
        if not len(v) or not len(q):
            return pa.table({"q": table.column("id").slice(0, 0), "id": table.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        vectors = table.column("embedding").chunk(0)
        sizes = np.unique(np.diff(vectors.offsets.to_numpy()))
        if len(sizes) > 1:
            raise ValueError(f"vectors have {sizes.tolist()} dimensions; they must have the same number")
        matrix = vectors.flatten().to_numpy().reshape(len(ids), -1)
        row, found, score = best_of(matrix[q], matrix[v], k)
        return pa.table({"q": ids[q][row], "id": ids[v][found], "score": score})

    both = left.union(right)
    kind = both.schema["id"].dataType.simpleString()
    found = both.groupBy("i", "j").applyInArrow(run, f"q {kind}, id {kind}, score double")
    best = Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def rrf(first: DataFrame, second: DataFrame, id_col: str, k: int = RRF_K) -> DataFrame:
    """(id, score, first_rank, second_rank) of two rankings: the sum of 1 / (k + rank)."""
    both = first.select(id_col, F.col("rank").alias("first_rank")).join(second.select(id_col, F.col("rank").alias("second_rank")), id_col, "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("first_rank") + part("second_rank"))


def retrieve(chunks: DataFrame, query: str, query_vector: DataFrame | None, id_col: str, top_k: int = 20, mode: str = "hybrid", rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, rank, score = 1 / rank, raw_score) of the best chunks (id, text, embedding). rerank maps (id, raw_score) to new raw scores."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    pool = top_k * OVER_FETCH
    by_vector = top(cosine(chunks, query_vector, id_col), pool, id_col) if mode != "bm25" else None
    by_words = top(bm25(chunks, query, id_col), pool, id_col) if mode != "cosine" else None
    if mode == "hybrid":
        order = [F.desc("score"), F.asc_nulls_last("first_rank"), F.asc_nulls_last("second_rank")]
        found = rrf(by_vector, by_words, id_col).orderBy(*order).limit(pool)
    else:
        found = by_vector if by_words is None else by_words
        order = [F.asc("rank")]
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(id_col, "rank", F.col("score").alias("raw_score"))
    if rerank is not None:
        found = top(rerank(found).withColumnRenamed("raw_score", "score"), pool, id_col).withColumnRenamed("score", "raw_score")
    return found.filter(F.col("rank") <= top_k).select(id_col, "rank", (1.0 / F.col("rank")).alias("score"), "raw_score")


def group_by_file(hits: DataFrame) -> DataFrame:
    """(file_path, first_rank, top_score, n_hits, symbols) of hits (file_path, symbol_name, start_line, rank, score): files by their best rank, symbols by line."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "symbol_name")))
    grouped = hits.groupBy("file_path").agg(F.min("rank").alias("first_rank"), F.max("score").alias("top_score"), F.count("*").alias("n_hits"), ordered.alias("__s"))
    return grouped.select("file_path", "first_rank", "top_score", "n_hits", F.array_join("__s.symbol_name", ", ").alias("symbols"))


def numbered(rows: DataFrame, block: Column, *order: Column) -> DataFrame:
    """Adds rank from 1 over all rows, without a window over them: rows are counted in blocks whose values rise with the order, and one row per block is summed up."""
    rows = rows.withColumn("__b", block)
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return rows.join(before, "__b").withColumn("rank", F.col("__before") + within).drop("__b", "__before")
