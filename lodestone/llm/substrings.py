"""Substring dedup by seed and extend.

Seeds: each window of 50 words has one anchor, the 25-word gram of least hash in it (winnowing), so windows with equal
words have equal anchors at equal places. Documents meet on shared anchors only, about 7 per 100 words.

Extend: every occurrence of an anchor is compared with one occurrence in the smallest document that has it, window by
window to the left and right of the anchor, which gives the repeat around it in one run of windows. Runs of one pair of
documents that touch are chained into maximal repeats. What does not repeat there (the text differs nearby, but may
equal a third document's) meets further leads, and what is open after that is compared exactly among itself by window
hash. All steps grow with the number of occurrences: no pairs within a group are made, and a passage that very many
documents share is a minimum per task and a join that AQE may split.

A row goes by its doc_id and a hash of its text, so rows that share a doc_id, or have none, don't meet in one group.
Texts travel twice, to their anchors and to their repeats, both times compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cluster import apart, cut, dropped, written
from lodestone.llm.words import CHUNK_BYTES, chunks, mix, signed, words_of

WINDOW = 50
_U = np.uint64
#: Stands for a null doc_id: after all others.
NO_ID = 2**63 - 1


def _gram(window: int) -> int:
    return max(1, window // 2)


def _anchors(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window (start, its text, its anchor's place): the least gram hash, the rightmost of equal ones."""
    k = _gram(window)
    span = window - k + 1
    grams = words.grams(k)
    counts = np.diff(words.first)
    n = np.maximum(counts - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + words.first[:-1][text]
    if not len(starts):
        return starts, text, starts
    # The least of span consecutive grams by doubling; reversed, so that argmin's first is the rightmost.
    best, at, width = grams.copy(), np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        other, other_at = best[step:], at[step:]
        keep = best[: len(other)] < other
        best, at = np.where(keep, best[: len(other)], other), np.where(keep, at[: len(other)], other_at)
        width += step
    return starts, text, at[starts]


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) with __id (never null), __key (64 bits of the text) and __text, the compressed bytes (null for null) in place of text."""
    text = F.col("text").cast("string")
    named = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__key", F.xxhash64(text)).withColumn("__text", text.cast("binary")).drop("text")
    at = named.columns.index("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [None if x is None else pack(x) for x in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, "__text", pa.array(packed, pa.binary()))

    return named.mapInArrow(run, named.schema)


def _parts(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with the texts that this column holds compressed."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = batch.schema.get_field_index(name)
        taken, size, texts = 0, 0, []
        for i in range(len(batch)):
            x = batch.column(at)[i].as_py()
            texts.append(None if x is None else unpack(x).decode())
            size += len(texts[-1] or "")
            if size >= CHUNK_BYTES or i == len(batch) - 1:
                yield batch.slice(taken, i + 1 - taken), pa.array(texts, pa.string())
                taken, size, texts = i + 1, 0, []


def seeds(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__id, __key, n_words, anchors) of each row of (__id, __key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column(2))
                grams = words.grams(_gram(window))
                starts, text, at = _anchors(words, window)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
                rows = text[new]
                hashes = signed(grams[at[new]]) if len(at) else np.empty(0, np.int64)
                per = np.bincount(rows, minlength=len(part))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(words.first)), lists], ["__id", "__key", "n_words", "anchors"])

    return docs.select("__id", "__key", "text").mapInArrow(run, "__id long, __key long, n_words long, anchors array<long>")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(__id, __key, anchor, least, at, start, hashes) of the wanted (anchor, least) of (__id, __key, __text, wanted): the windows that each occurrence anchors, as hashes of the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, "__text"):
            words = words_of(texts)
            grams = words.grams(_gram(window))
            starts, text, at = _anchors(words, window)
            if not len(at):
                continue
            ids, key = part.column(0).to_numpy(), part.column(1).to_numpy()
            wanted = part.column(3)
            lists, (values, leasts) = np.diff(wanted.offsets.to_numpy()), (x.to_numpy() for x in wanted.flatten().flatten())
            # Is the anchor wanted in its row? Both as (row, hash) in one sorted list.
            have = np.stack([text.astype(np.int64), signed(grams[at])], 1)
            asked = np.stack([np.repeat(np.arange(len(lists)), lists), values], 1)
            both = np.concatenate([asked, have])
            order = np.lexsort((both[:, 1], both[:, 0]))
            runs = both[order]
            change = np.ones(len(runs), bool)
            change[1:] = (runs[1:] != runs[:-1]).any(axis=1)
            group = np.empty(len(runs), np.int64)
            group[order] = np.cumsum(change) - 1
            hit, least = np.zeros(change.sum() + 1, bool), np.zeros(change.sum() + 1, np.int64)
            hit[group[: len(asked)]], least[group[: len(asked)]] = True, leasts
            ok = hit[group[len(asked) :]]
            starts, text, at, least = starts[ok], text[ok], at[ok], least[group[len(asked) :]][ok]
            if not len(at):
                continue
            hashes = signed(mix(words.grams(window, base=0)[starts] ^ _U(0x2545F4914F6CDD1D)))
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            edges = np.concatenate([np.flatnonzero(new), [len(at)]]).astype(np.int32)
            row = text[new]
            begin = words.first[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[row]), pa.array(key[row]), pa.array(signed(grams[at[new]])), pa.array(least[new]), pa.array((at[new] - begin[row]).astype(np.int32)),
                    pa.array((starts[new] - begin[row]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes)),
                ],
                ["__id", "__key", "anchor", "least", "at", "start", "hashes"],
            )

    return docs.select("__id", "__key", "__text", "wanted").mapInArrow(run, "__id long, __key long, anchor long, least long, at int, start int, hashes array<long>")


def maximal(runs: DataFrame) -> DataFrame:
    """(__id, __key, l_id, lo, hi) of runs of windows (the same columns, l_key and shift): those of one pair of rows at one distance that overlap or touch become one maximal repeat, from word lo to word hi + window - 1."""
    pair = ["__id", "__key", "l_id", "l_key", "shift"]
    order = Window.partitionBy(*pair).orderBy("lo", "hi")
    far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", (F.col("lo") > far + 1).cast("int"))
    marked = marked.withColumn("repeat", F.sum(F.coalesce("new", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*pair, "repeat").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("__id", "__key", "l_id", "lo", "hi")


def repeats(docs: DataFrame, packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__id, __key, lo, hi, starts): windows of a row (a run of starts, or a list) whose words also start in a row with a smaller __id.

    docs has __id, __key and text, packed the same rows as keyed() gives them.
    """
    # Kept while it is read twice; a lost part is computed anew.
    seeded = seeds(docs, window).filter("n_words >= %d" % window).persist(StorageLevel.MEMORY_AND_DISK)
    anchors = seeded.select("__id", "__key", F.explode(F.array_distinct("anchors")).alias("anchor"))
    # Only anchors of different documents matter; a grouped minimum and maximum, summed in the tasks first.
    shared = apart(anchors.groupBy("anchor").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).filter("least < most").select("anchor", "least"), "least")
    wanted = anchors.join(shared, "anchor").groupBy("__id", "__key").agg(F.collect_set(F.struct("anchor", "least")).alias("wanted"))
    wanted = wanted.repartition("wanted")  # the join shuffles both sides itself, so AQE can split rows that are all equal
    occurrences = written(_windows(packed.select("__id", "__key", "__text").join(wanted, ["__id", "__key"]), window))
    seeded.unpersist()
    # The first occurrence in the smallest document leads; it has each window that it anchors, in order of their starts.
    leads = occurrences.filter("__id = least").groupBy("anchor").agg(F.min_by(F.struct("__id", "__key", "at", F.col("hashes").alias("theirs")), F.struct("at", "__key")).alias("lead")).select("anchor", "lead.*")
    leads = apart(leads.withColumnsRenamed({"__id": "l_id", "__key": "l_key", "at": "l_at"}), "l_id")
    lead = (F.col("__id") == F.col("l_id")) & (F.col("__key") == F.col("l_key")) & (F.col("at") == F.col("l_at"))
    met = occurrences.join(leads, "anchor").filter(~lead)
    met = met.withColumn("w", F.expr("transform(hashes, (h, i) -> struct(start + i AS s, h AS h, array_contains(theirs, h) AS same))"))
    # Windows around one anchor that repeat in one place follow one another, so their first and last start tell them all.
    same, others = F.expr("filter(w, x -> x.same).s"), F.expr("transform(filter(w, x -> NOT x.same), x -> struct(x.s AS s, x.h AS h))")
    met = cut(met.select("__id", "__key", "anchor", "at", "l_id", F.array_min(same).alias("lo"), F.array_max(same).alias("hi"), others.alias("others"), "l_key", (F.col("at") - F.col("l_at")).alias("shift")))
    dropped(occurrences)  # the largest table of all
    none = F.lit(None).cast("array<int>").alias("starts")
    found = maximal(met.filter("__id > l_id AND lo IS NOT NULL").select("__id", "__key", "l_id", "l_key", "shift", "lo", "hi")).select("__id", "__key", "lo", "hi", none)
    rest = met.select("__id", "__key", "anchor", "at", "others")
    # Twice more with further leads, those of occurrences whose first (then last) open window is the same, ...
    for place in (1, -1):
        rest = _met_again(rest.filter("size(others) > 0"), place)
        nothing = F.lit(None).cast("int")
        found = found.union(rest.filter("size(gone) > 0").select("__id", "__key", nothing.alias("lo"), nothing.alias("hi"), F.col("gone").alias("starts")))
    # ... and what is open then, the leads among it, window by window.
    rest = cut(rest.select("__id", "__key", "anchor", F.explode("others").alias("x")).select("__id", "__key", "anchor", F.col("x.s").alias("s"), F.col("x.h").alias("h")))
    least = cut(rest.groupBy("anchor", "h").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).filter("least < most").select("anchor", "h", "least"))
    last = rest.join(least, ["anchor", "h"]).filter("__id > least").select("__id", "__key", F.col("s").alias("lo"), F.col("s").alias("hi"), none)
    return found.union(last)


def _met_again(rest: DataFrame, place: int) -> DataFrame:
    """rest (__id, __key, anchor, at, others) with gone: starts of the windows that a lead with a smaller __id has too; others keeps what is still open.

    The lead of an anchor and an edge window keeps all its own windows, so dropping those of later rows loses no
    provider: whoever has the same window still finds the lead's.
    """
    keyed = rest.withColumn("edge", F.element_at("others", place)["h"])
    mine = F.struct("__id", "at", "__key")
    leads = keyed.groupBy("anchor", "edge").agg(F.min_by(F.struct(F.col("__id").alias("l_id"), F.expr("transform(others, x -> x.h)").alias("theirs")), mine).alias("lead"), F.max("__id").alias("most"))
    leads = apart(leads.filter("lead.l_id < most").select("anchor", "edge", "lead.l_id", "lead.theirs"), "l_id")
    joined = keyed.join(leads, ["anchor", "edge"], "left")
    later = "l_id IS NOT NULL AND __id > l_id"
    gone = F.expr(f"IF({later}, transform(filter(others, x -> array_contains(theirs, x.h)), x -> x.s), CAST(array() AS array<int>))")
    open_ = F.expr(f"IF({later}, filter(others, x -> NOT array_contains(theirs, x.h)), others)")
    return cut(joined.select("__id", "__key", "anchor", "at", gone.alias("gone"), open_.alias("others")))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of docs (doc_id, text, others) with __n_words, __n_removed and __kept (the words left, joined by one space).

    A word goes if a window of so many consecutive words of its row covers it whose words also start in a row with a
    smaller doc_id; windows are judged on the input. Null and empty texts have no words; rows that share a doc_id don't
    count as repeats of each other; a null doc_id comes after all others. An empty table gives an empty one. Other
    columns stay, whatever their names, if they don't begin with __.
    """
    named = keyed(docs)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = repeats(plain, named, window).groupBy("__id", "__key").agg(F.collect_set(F.struct("lo", "hi", "starts")).alias("__runs"))
    joined = named.join(runs.repartition("__runs"), ["__id", "__key"], "left").drop("__id", "__key")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, "__text"):
            words = words_of(texts)
            n, removed, kept = [], [], []
            for i, found in enumerate(part.column(part.schema.get_field_index("__runs"))):
                a, b = words.first[i], words.first[i + 1]
                gone = np.zeros(b - a + 1, np.int64)
                for r in found.as_py() or []:
                    np.add.at(gone, r["starts"] or [r["lo"]], 1)
                    np.add.at(gone, np.add(r["starts"] or [r["hi"]], window), -1)
                stays = np.cumsum(gone[:-1]) == 0
                at = np.flatnonzero(stays) + a
                n.append(b - a)
                removed.append(b - a - len(at))
                kept.append(_joined(words, at))
            own = [texts if c == "text" else part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "__n_words", "__n_removed", "__kept"])

    fields = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(run, ", ".join(fields) + ", __n_words long, __n_removed long, __kept string")


def _joined(words, at: np.ndarray) -> bytes:
    """The words at these places, joined by one space."""
    if not len(at):
        return b""
    starts, ends = words.starts[at], words.ends[at]
    size = ends - starts + 1
    total = int(size.sum())
    index = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    index = np.minimum(index, len(words.data) - 1)
    out = words.data[index].copy()
    out[np.cumsum(size) - 1] = 32
    return out[:-1].tobytes()


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs in its own columns; where words went, text is the words left, joined by one space, else unchanged; rows of which nothing is left go."""
    out = remove(docs, window).filter("__n_removed = 0 OR __n_removed < __n_words")
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    size = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[({"text": text} | size)[c].alias(c) if c in {"text", *size} else F.col(f"`{c}`") for c in docs.columns])
