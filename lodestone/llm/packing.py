"""Best-fit packing of tokenised documents into sequences.

Tokenising runs in the tasks. Pieces have only as many kinds as there are lengths (2048 at most), so vector best-fit
runs over the histogram of lengths: it plans classes of equal bins, and the plan's size depends on the capacity, not
on the corpus. Each piece then takes the slot of its rank among the pieces of its length. Ranks are counted by
hashed block, so no length's pieces meet in one task.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cluster import cut, partitions

CAPACITY = 2048
#: Ends each document.
END_ID = 0
MIN_BLOCKS = 64


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    """The byte-level BPE of byte_bpe_50k.json, from the same vocabulary's rank file: equal ids in a fifth of the time.

    Special tokens' strings in a text become their id, as they do in the tokenizers library unless it is told otherwise.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then END_ID.

    Null text is empty (one piece of the single END_ID). Only documents over the capacity are cut; their first piece
    takes the remainder, so that all others fill a sequence. Rows that share a doc_id are documents of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), [END_ID]).astype("<u4")
                n = len(ids)
                first = n if n <= capacity else n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    part = ids[start : first if k == 0 else start + capacity]
                    row = (doc_id, k, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if keep_ids else []))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=False)], names[: len(out)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass
class Bins:
    """Bins that hold the same lengths and so have the same capacities left."""

    count: int
    left: np.ndarray
    holds: list[tuple[int, int]] = field(default_factory=list)  # length, how many in each bin


def plan(lengths: dict[int, int], capacity: int = CAPACITY, max_documents: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "residual") -> list[Bins]:
    """Vector best-fit, longest first, of so many pieces of each length.

    A piece takes (length, 1, length squared) of a bin's tokens, documents and attention cost; it may only go where
    all three fit. Among those, score "residual" picks the bin whose weighted capacities left have the smallest
    norm afterwards, "dot" the one whose capacities left align best with the piece (weighted dot product over their
    norm). If none fits, new bins open. A piece over a capacity of its own gets a bin of its own.
    """
    whole = np.array([capacity, max_documents or capacity, max_attention or float(capacity) ** 2], float)
    w = np.asarray(weights)
    classes: list[Bins] = []
    done: list[Bins] = []
    order = sorted(lengths, reverse=True)
    for at, length in enumerate(order):
        item, n = np.array([length, 1.0, float(length) ** 2]), lengths[length]
        while n:
            left = np.array([c.left for c in classes]).reshape(-1, 3)
            fits = (left >= item).all(axis=1) if len(left) else np.zeros(0, bool)
            if fits.any():
                l, i = left / whole, item / whole
                value = -(w * (l - i) ** 2).sum(1) if score == "residual" else (w * l * i).sum(1) / np.sqrt((w * l * l).sum(1) + 1e-12)
                bins = classes[int(np.argmax(np.where(fits, value, -np.inf)))]
                each = int(min(np.floor(bins.left / item).min(), n))  # a best fit stays the best for the next of its length
                take = min(bins.count, n // each)
            else:
                each = max(1, int(min(np.floor(whole / item).min(), n)))
                take = n // each
                bins = Bins(take, whole.copy())
                classes.append(bins)
            if take < bins.count:
                classes.append(Bins(bins.count - take, bins.left.copy(), list(bins.holds)))
                bins.count = take
            bins.left = bins.left - each * item
            bins.holds.append((length, each))
            n -= take * each
        least = np.array([order[-1], 1.0, float(order[-1]) ** 2])
        done += [c for c in classes if (c.left < least).any()]
        classes = [c for c in classes if not (c.left < least).any()]
    return done + classes


def pack(pieces: DataFrame, capacity: int = CAPACITY, **rules) -> DataFrame:
    """Adds sequence_id and offset to every row of pieces (doc_id, piece, length, ids_crc32, any others).

    Sequences are gapless from offset 0. Which of several pieces of one length takes which slot follows a hash of
    doc_id and piece; equal rows are interchangeable. rules: see plan(). An empty table gives an empty one.
    """
    pieces = cut(pieces)
    spark = pieces.sparkSession
    blocks = max(MIN_BLOCKS, 4 * partitions(spark))
    pieces = pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    counts = cut(pieces.groupBy("length", "__block").agg(F.count("*").alias("__n")))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # a row per length, at most capacity
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    base, filled = 0, dict.fromkeys(lengths, 0)
    for bins in plan(lengths, capacity, **rules):
        offset = 0
        for length, each in bins.holds:
            slots.setdefault(length, []).append((filled[length], base, each, offset))
            filled[length] += bins.count * each
            offset += each * length
        base += bins.count
    table = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).drop("__n")
    within = F.row_number().over(Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.join(starts, ["length", "__block"]).withColumn("__rank", (within - 1 + F.col("__before")).cast("long")).drop("__block", "__before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                rows, t = np.flatnonzero(length == value), table.value[int(value)]
                s = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - s[:, 0]
                sequence[rows] = s[:, 1] + nth // s[:, 2]
                offset[rows] = s[:, 3] + nth % s[:, 2] * value
            kept = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "__rank"]
    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")
