"""Mixing sources to target weights.

Sizes are summed per source, each source gets a target and so a repetition rate, and each document is emitted
floor(rate) times plus once more with the rate's fraction as probability. That draw comes from a hash of the seed
and doc_id, so reruns and retried tasks agree. Only sums travel: one row per task and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cluster import cut, small
from lodestone.llm.words import word_count

SEED = "mix-1"
#: A target stops at so many times its source's size.
MAX_RATE = 3
#: Weights of the sources in the order of their names, over and over.
CYCLE = (5, 2, 1)


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds weight to one row per source, by the rank of the name (code points; null last).

    The window sees a row per source, never a row per document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, weight) gets target: all sizes shared by weight, at most max_rate times the own size.

    What a capped source can't take is shared anew among the others by weight, until none is above its cap. Each
    round is one sum over the sources; the driver sees three numbers. Null or negative weights count as 0; if every
    source with a weight is capped, the rest of the total stays unassigned.
    """
    sources = cut(sources.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0))))
    cap = F.col("source_size") * max_rate
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, n_capped, rest, weights = F.lit(False), -1, total, 0
    while True:
        n, held, weights = sources.agg(
            F.coalesce(F.sum(F.when(capped, 1)), F.lit(0)),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        rest = total - held
        shared = F.lit(rest).cast("long") if isinstance(rest, int) else F.lit(rest)  # as an int, weight times it could overflow
        if n == n_capped or not weights:
            break
        n_capped = n
        capped = F.col("weight") * shared > cap * F.lit(weights)
    share = F.col("weight") * shared / F.lit(weights or 1)
    return sources.withColumn("target", F.when(capped, cap).otherwise(share).cast("double"))


def _draw(doc_id: Column, seed: str) -> Column:
    """Uniform in [0, 1): the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2**52)


def mix(docs: DataFrame, weights: DataFrame | None = None, max_rate: float = MAX_RATE, seed: str = SEED, size: Column | None = None) -> DataFrame:
    """Every row of docs with __size (words), __source_size, __target and __copies (how often the mix takes it).

    weights has (source, weight); without it the cycle 5, 2, 1 holds. size: what to count instead of words. Null and empty texts have size 0; a null source
    is a source of its own; rows that share a doc_id share a draw; a source of size 0 has rate 0. An empty table
    gives an empty one. Other columns stay as they are.
    """
    sized = docs.withColumn("__size", word_count(F.col("text")) if size is None else size)
    per = sized.groupBy("source").agg(F.sum("__size").alias("source_size"))
    if weights is None:
        per = cycled_weights(per)
    else:
        per = per.alias("p").join(weights.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")), "left").select("p.*", "w.weight")
    per = cut(targets(per, max_rate)).select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    out = sized.join(small(per), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    copies = F.floor(rate) + F.when(_draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("__copies", copies.cast("long"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix() as often as it is taken, with the columns that the documents had."""
    return mixed.filter(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__copy", "__size", "__source_size", "__target", "__copies")
