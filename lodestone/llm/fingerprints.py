"""Context-triggered piecewise hashing.

A rolling hash of the last 7 bytes sets the boundaries, so they move with the text; each piece between boundaries
gives one character of the signature. Fingerprints of close block sizes are compared by edit distance, which Spark's
levenshtein does in the JVM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cluster import partitions
from lodestone.llm.words import CHUNK_BYTES, mix, texts_of

CONTEXT = 7
#: A block size is the least power of two that makes at most so many expected pieces.
PIECES = 64
#: Stands for a null doc_id among the keys of ranges: after all others.
NO_ID = 1e300
#: Up to here a double tells whole numbers apart.
EXACT = 2.0**53
_U = np.uint64
_TABLE = np.random.default_rng(404).integers(0, 2**64, 256, dtype=_U)
_CONTEXT_BASE = [_U(pow(0x9E3779B97F4A7C15, i, 2**64)) for i in range(CONTEXT)]
_PIECE_BASE = 0xD1342543DE82EF95
#: The characters of signatures, in the order of base 64.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


@lru_cache(maxsize=1)
def _all_powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_PIECE_BASE, pow(_PIECE_BASE, -1, 2**64)):
        p = np.full(CHUNK_BYTES + 1, base, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return out[0], out[1]


def _piece_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the piece hash's base and of its inverse, n of each; a slice needs no more."""
    p, inv = _all_powers()
    return p[:n], inv[:n]


def block_size(n: int) -> int:
    """For a text of n bytes."""
    size = 1
    while n > size * PIECES:
        size *= 2
    return size


def _spaced(places: list[int], least: int, last: int) -> list[int]:
    """Of these places, one after another, those at least so far from the one kept before."""
    kept = []
    for p in places:
        if p - last >= least:
            kept.append(p)
            last = p
    return kept


class _Signature:
    """Pieces of one text at one block size, from slices of it: an open piece's hash is carried from slice to slice."""

    def __init__(self, size: int, n: int):
        self.size, self.n, self.last, self.open, self.length, self.pieces = size, n, 0, 0, 0, []

    def add(self, at: int, rolling: np.ndarray, sums: np.ndarray) -> None:
        """A slice that begins at this place: rolling hash of each byte, sums of hashed bytes before each."""
        places = np.flatnonzero((rolling & _U(self.size - 1)) == _U(self.size - 1)) + at + 1
        least = self.size // 4  # keeps signatures of monotonous texts short
        close = len(places) and least > 1 and np.diff(places, prepend=self.last).min() < least
        ends = np.array(_spaced(places.tolist(), least, self.last) if close else places, np.int64)
        end = at + len(rolling)
        if end == self.n and (not len(ends) or ends[-1] != end):
            ends = np.append(ends, end)
        if len(ends):
            self.last = int(ends[-1])
        edges = np.unique(np.concatenate([[0], ends - at, [len(rolling)]])).astype(np.int64)
        _, inv = _piece_powers(len(rolling) + 1)
        parts = (sums[edges[1:]] - sums[edges[:-1]]) * inv[edges[:-1]]
        if not len(parts):
            return
        parts[0] = _U((self.open + pow(_PIECE_BASE, self.length, 2**64) * int(parts[0])) % 2**64)
        closed = len(ends)
        self.pieces.append(ALPHABET[(mix(parts[:closed]) >> _U(58)).astype(np.int64)])
        if closed < len(parts):
            self.length = int(edges[-1] - edges[-2]) + (self.length if len(parts) == 1 else 0)
            self.open = int(parts[-1])
        else:
            self.length = self.open = 0

    def __str__(self) -> str:
        return np.concatenate([*self.pieces, np.empty(0, np.uint8)]).tobytes().decode()


def fingerprint_all(column: pa.Array) -> list[str]:
    """block size:signature:signature at twice the size, of every whole text; an empty text gives "1::".

    A long text is hashed in slices of CHUNK_BYTES, so it takes no more memory than they do beside itself.
    """
    raw, at = texts_of(column)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        size = block_size(b - a)
        signs = _Signature(size, b - a), _Signature(2 * size, b - a)
        for start in range(a, b, CHUNK_BYTES):
            end = min(b, start + CHUNK_BYTES)
            ahead = min(CONTEXT - 1, start - a)  # bytes of the slice before that the rolling hash still sees
            value = _TABLE[raw[start - ahead : end]]
            rolling = np.zeros(len(value), _U)
            for i, base in enumerate(_CONTEXT_BASE):
                rolling[i:] += value[: max(0, len(value) - i)] * base
            rolling = mix(rolling)[ahead:]
            rolling[: max(0, CONTEXT - 1 - (start - a))] = 0  # a text's first bytes have no full context
            p, _ = _piece_powers(end - start + 1)
            sums = np.concatenate([[_U(0)], np.cumsum(value[ahead:] * p[: end - start], dtype=_U)])
            for s in signs:
                s.add(start - a, rolling, sums)
        out.append(f"{size}:{signs[0]}:{signs[1]}")
    return out


def fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the fingerprint of each of these text columns (column: name of the fingerprint) added; null text counts as empty."""
    names = [f.name for f in df.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` string" for c in columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = sum(np.diff(texts_of(batch.column(names.index(c)))[1]) for c in columns)
            part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(fingerprint_all(rows.column(names.index(c))), pa.string()) for c in columns)], [*names, *columns.values()])

    return df.mapInArrow(run, schema)


def likeness(x: Column, y: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else 1 - edit distance / length of the longer signature, at the block sizes that both have; 0 without one."""
    a, b = F.split(x, ":"), F.split(y, ":")
    size_a, size_b = a[0].cast("long"), b[0].cast("long")

    def near(p: Column, q: Column) -> Column:
        longer = F.greatest(F.length(p), F.length(q))
        return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(p, q) / longer)

    same = F.greatest(near(a[1], b[1]), near(a[2], b[2]))
    other = F.when(size_a == size_b, same).when(size_a == 2 * size_b, near(a[1], b[2])).when(size_b == 2 * size_a, near(a[2], b[1])).otherwise(0.0)
    return F.when(x == y, 1.0).otherwise(other)


def with_next(docs: DataFrame, carry: tuple[str, ...] = ("text",), ids: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, others) with next_<column> of the next row by descending doc_id (after the last row: the first).

    Null ids come last; rows with one doc_id go by a hash of the text, then by the text. doc_id is cut into ranges by
    its quantiles, each range is one window, and the first row of each range is also put at the end of the range
    before, so texts are shuffled once and no window spans the table. A doc_id (or null) that fills several ranges is
    cut by that hash instead. ids: a cheaper DataFrame with the same doc_id and text, to find the ranges from.
    Columns next_<column> of docs are replaced; none may begin with __.
    """
    spark = docs.sparkSession
    source = docs if ids is None else ids
    key = F.coalesce(-F.col("doc_id").cast("double"), F.lit(NO_ID))  # doubles keep the order; equal ones share a range
    tie = F.pmod(F.xxhash64("text"), F.lit(2**20)) / F.lit(2.0**20)
    keys = source.select(key.alias("__key"))
    buckets = max(1, min(keys.count() // 200, 8 * partitions(spark)))
    cuts = keys.agg(F.percentile_approx("__key", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] if buckets > 1 else []
    often = {c: k for c, k in Counter(cuts or []).items() if k > 1 and (abs(c) < EXACT or c == NO_ID)}
    edges = sorted({*(cuts or [0.0]), *(float(np.nextafter(c, np.inf)) for c in often)})
    ranges = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="__key", outputCol="__range")
    parts = F.broadcast(spark.createDataFrame([(float(edges.index(c) + 1), k) for c, k in often.items()], "__range double, __parts int"))  # at most a row per range

    def placed(df: DataFrame) -> DataFrame:
        df = ranges.transform(df)
        if not often:
            return df.withColumn("__tie", F.lit(0.0)).withColumn("__part", F.lit(0))
        out = df.join(parts, "__range", "left").withColumn("__tie", F.when(F.col("__parts").isNull(), 0.0).otherwise(tie))
        return out.withColumn("__part", F.coalesce(F.floor(F.col("__tie") * F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")

    spots = ["__range", "__part"]
    first = placed(source.select("doc_id", "text").withColumn("__key", key)).groupBy(*spots).agg(F.min(F.struct("__key", "__tie")).alias("f")).select(*spots, "f.*")
    first = sorted(tuple(r) for r in first.collect())  # a row per range and part
    heads = [(*r, *first[i - 1][:2]) for i, r in enumerate(first)]
    heads = F.broadcast(spark.createDataFrame(heads, "__range double, __part int, __key double, __tie double, __before double, __before_part int"))
    marked = placed(docs.withColumn("__key", key)).join(heads, [*spots, "__key", "__tie"], "left")
    own = F.struct(F.col("__range").alias("range"), F.col("__part").alias("part"), F.lit(0).alias("copy"))
    again = F.struct(F.col("__before").alias("range"), F.col("__before_part").alias("part"), F.lit(1).alias("copy"))
    marked = marked.withColumn("__at", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, again))))
    order = Window.partitionBy("__at.range", "__at.part").orderBy("__at.copy", F.col("doc_id").desc_nulls_last(), tie, "text")
    out = marked.select("*", *[F.lead(c).over(order).alias(f"__next_{c}") for c in carry])
    out = out.filter("__at.copy = 0").drop("__at", "__key", "__tie", "__before", "__before_part", *spots, *[f"next_{c}" for c in carry])
    return out.withColumnsRenamed({f"__next_{c}": f"next_{c}" for c in carry})


def edited(docs: DataFrame, carry: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """with_next() with n_chars and edited: the last n_chars div 2 code points of text replaced by the first as many (or all) of the next row's.

    text must not be null. An empty table gives an empty one; a single row is its own next. Columns n_chars and edited
    of docs are replaced.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = with_next(docs, ("text", *carry), ids).withColumn("n_chars", n.cast("long"))
    return out.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
