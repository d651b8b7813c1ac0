"""Vectors learnt from a corpus: randomised truncated SVD of its tf-idf matrix, kept as a projection for texts to come.

Terms count in SLOTS hashed columns, so the model has one size for any corpus. Each round of the SVD is one pass over
the counted texts: tasks multiply blocks of rows and send the sums of the columns they touched, which are added by
ranges of columns. All texts take part; what comes to the driver is the model itself (SLOTS rows of DIM + OVER numbers).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import IDENTIFIER, query_tokens
from lodestone.operators.embedding import DIM
from lodestone.plans.lineage import spread, written

SLOTS, OVER, ROUNDS = 32_768, 10, 3
#: Rows of a dense block (at most this times SLOTS numbers), and columns whose sums are added in one task.
ROWS, RANGE = 256, 1_024
#: Directions this much weaker than the strongest are noise of the arithmetic.
LEAST = 1e-6
#: Words whose tokens a task remembers, and from how many characters a text's words are not listed at once.
CACHED, LONG = 200_000, 1_000_000
WORD = re.compile(IDENTIFIER)


@dataclass
class Latent:
    """A learnt projection: of each slot the idf (of all texts) and the vector; and the singular values, falling."""

    idf: np.ndarray
    vectors: np.ndarray
    strengths: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"slot": pa.array(range(len(self.idf)), pa.int32()), "idf": self.idf, "vector": self.vectors.tolist()})
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/slots")
        spark.createDataFrame([(self.strengths.tolist(),)], "strengths array<double>").coalesce(1).write.parquet(f"{path}/strengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Latent:
        rows = spark.read.parquet(f"{path}/slots").orderBy("slot").toArrow()
        return cls(rows.column("idf").to_numpy(), np.array(rows.column("vector").to_pylist()), np.array(spark.read.parquet(f"{path}/strengths").first().strengths))


@lru_cache(maxsize=CACHED)
def _slots_of(word: str, slots: int) -> list[tuple[int, int]]:
    """(slot, times) of a word's tokens; a plain word has three equal ones, which are one pair."""
    if "_" not in word and word[1:].islower():
        return [(crc32(word.lower().encode()) % slots, 3)]
    return list(Counter(crc32(token.encode()) % slots for token in query_tokens(word)).items())


def _counted(texts: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, times) of the tokens of texts, by row and slot: words are counted first, and each word's tokens are found once."""
    slot, times, ends = array("q"), array("q"), [0]
    for text in texts:
        text = text.as_py() or ""
        words = Counter(WORD.findall(text) if len(text) < LONG else (m[0] for m in WORD.finditer(text)))
        for word, n in words.items():
            for at, each in _slots_of(word, slots):
                slot.append(at)
                times.append(n * each)
        ends.append(len(slot))
    row = np.repeat(np.arange(len(ends) - 1, dtype=np.int64), np.diff(ends))
    pair, place = np.unique(row * slots + np.frombuffer(slot, np.int64), return_inverse=True)
    return pair // slots, pair % slots, np.bincount(place, np.frombuffer(times, np.int64), len(pair)).astype(np.int64)


def _blocks(row: np.ndarray, slot: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, slots that occur, their tf-idf as a dense matrix of unit rows) of each ROWS rows."""
    for first in range(0, n, ROWS):
        a, b = np.searchsorted(row, (first, first + ROWS))
        if a < b:
            used, column = np.unique(slot[a:b], return_inverse=True)
            block = np.zeros((min(ROWS, n - first), len(used)), np.float32)
            block[row[a:b] - first, column] = (1 + np.log(times[a:b])) * idf[slot[a:b]]
            block /= np.maximum(np.sqrt((block.astype(np.float64) ** 2).sum(1)), 1e-30)[:, None]
            yield first, used, block


def _gram(counts: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(A'A) right, for A the tf-idf matrix of counts (slot, times)."""
    slots, width = right.shape
    shared = counts.sparkSession.sparkContext.broadcast((idf, right.astype(np.float32)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = shared.value
        sums, touched = np.zeros((slots, width)), np.zeros(slots, bool)
        for batch in batches:
            slot = batch.column("slot")
            row = np.repeat(np.arange(len(slot), dtype=np.int64), np.diff(slot.offsets.to_numpy()))
            for _, used, block in _blocks(row, slot.flatten().to_numpy(), batch.column("times").flatten().to_numpy(), idf, len(slot)):
                sums[used] += block.T @ (block @ right[used])
                touched[used] = True
        for part in range(0, slots, RANGE):
            own = np.flatnonzero(touched[part : part + RANGE]) + part
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([sums[own].astype(np.float32).ravel()], pa.list_(pa.float32()))], ["part", "slot", "sums"])

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros((RANGE, width)), 0
        for batch in parts:
            part = batch.column("part")[0].as_py()
            for slot, sums in zip(batch.column("slot"), batch.column("sums")):
                total[slot.values.to_numpy() - part] += sums.values.to_numpy().reshape(-1, width)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "sums"])

    sent = counts.mapInArrow(partial, "part int, slot array<int>, sums array<float>")
    out = np.zeros((slots, width))
    for r in sent.groupBy("part").applyInArrow(added, "part int, sums array<double>").toArrow().to_batches():
        for part, sums in zip(r.column("part").to_pylist(), r.column("sums")):
            out[part : part + RANGE] = sums.values.to_numpy().reshape(-1, width)[: slots - part]
    return out


def counted(docs: DataFrame, id_col: str | None, text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, slot, times) of docs (id, text), a row for each of theirs, written: counted once, to learn from and to apply to. Without an id it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, slot, times = _counted(batch.column(1), slots)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (slot, times)]], ["id", "slot", "times"])

    chosen = docs.select((F.lit(None).cast("int") if id_col is None else F.col(id_col)).alias("id"), text_col)
    return written(spread(chosen).mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, slot array<int>, times array<int>"))


def train(docs: DataFrame, dim: int = DIM, text_col: str = "text", slots: int = SLOTS, rounds: int = ROUNDS, seed: int = 1) -> Latent:
    """The dim strongest directions of the tf-idf of all texts, (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) by rows of unit length.

    Subspace iteration from a seeded Gaussian start; the last round also gives the Nystrom form of A'A, whose
    eigenvectors are the directions. Texts that are null or without tokens count in n alone. Where the corpus has fewer
    directions than dim, the rest are zero. Signs are set so that each direction's largest entry is positive.
    """

    counts = counted(docs, None, text_col, slots)
    return train_counted(counts, dim, slots, rounds, seed)


def train_counted(counts: DataFrame, dim: int = DIM, slots: int = SLOTS, rounds: int = ROUNDS, seed: int = 1) -> Latent:
    """train() of texts that counted() has counted in as many slots."""
    counts = counts.select("slot", "times")  # read once a round
    n, held = counts.count(), counts.select(F.explode("slot").alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).toArrow()  # a row per slot
    df = np.zeros(slots)
    df[held.column("slot").to_numpy()] = held.column("df").to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((slots, min(dim + OVER, slots))))[0]
    for again in range(rounds):
        z = _gram(counts, idf, q)
        if again < rounds - 1:
            q = np.linalg.qr(z)[0]
    inner = q.T @ z
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    sure = values > LEAST * max(values.max(), 1e-30)
    vectors, strengths, _ = np.linalg.svd(z @ turn[:, sure] / np.sqrt(values[sure]), full_matrices=False)
    keep = min(dim, int((strengths > LEAST * strengths.max(initial=1e-30)).sum()))
    signs = np.sign(vectors[np.abs(vectors[:, :keep]).argmax(0), np.arange(keep)]) if keep else np.empty(0)
    out, strong = np.zeros((slots, dim)), np.zeros(dim)
    out[:, :keep], strong[:keep] = vectors[:, :keep] * signs, strengths[:keep]
    return Latent(idf, out, strong)


def _directed(blocks: Iterator[tuple[int, np.ndarray, np.ndarray]], vectors: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """(id, embedding) of _blocks() in the directions of vectors; sums are of doubles, so that equal texts have equal vectors wherever they stand."""
    dim = vectors.shape[1]
    out = np.zeros((len(ids), dim))
    for first, used, block in blocks:
        out[first : first + ROWS] = block.astype(np.float64) @ vectors[used].astype(np.float64)
    length = np.sqrt((out * out).sum(1))
    out /= np.where(length > LEAST, length, np.inf)[:, None]
    ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(out.astype(np.float32).ravel()))], ["id", "embedding"])


def embed(docs: DataFrame, id_col: str, model: Latent, text_col: str = "text") -> DataFrame:
    """(id, embedding) with the texts' unit vectors in the model's directions; the zero vector for a text without tokens or with none that the model tells."""
    slots = len(model.vectors)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.vectors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, vectors = shared.value
        for batch in batches:
            yield _directed(_blocks(*_counted(batch.column(1), slots), idf, batch.num_rows), vectors, batch.column(0))

    found = spread(docs.select(F.col(id_col).alias("id"), text_col)).mapInArrow(run, f"id {kind}, embedding array<float>")
    return found.withColumnRenamed("id", id_col)


def embed_counted(counts: DataFrame, id_col: str, model: Latent) -> DataFrame:
    """embed() of texts that counted() has counted in the model's slots."""
    kind = counts.schema["id"].dataType.simpleString()
    shared = counts.sparkSession.sparkContext.broadcast((model.idf, model.vectors.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, vectors = shared.value
        for batch in batches:
            slot = batch.column(1)
            row = np.repeat(np.arange(len(slot), dtype=np.int64), np.diff(slot.offsets.to_numpy()))
            yield _directed(_blocks(row, slot.flatten().to_numpy(), batch.column(2).flatten().to_numpy(), idf, len(slot)), vectors, batch.column(0))

    return counts.select("id", "slot", "times").mapInArrow(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)
