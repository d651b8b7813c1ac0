"""Toxicity by a factorization machine over hashed terms.

Each term has a weight and a short vector; the score adds the weights of a text's terms and the dot products of all
pairs of their vectors (in time linear in the number of terms), so pairs can tell what single terms can't. It learns
from a bounded sample of labelled documents, in one task: the driver sees the model alone, never a text or its terms.
Scoring reads every whole text in the tasks, with the model broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import small
from lodestone.llm.words import NO_LETTERS, chunks, words_of

#: Terms share so many hashed slots; the model's size is fixed by it.
BITS = 18
#: About so many labelled documents are learnt from (all, if there are fewer), taken by a hash of doc_id. One task holds their slots (4 bytes per distinct term).
TRAIN_ROWS = 20_000
#: A term counts whole and by its first so many bytes if it is longer, so that rare forms of a learnt stem count too, but the bare stem doesn't.
STEMS = (4, 5, 6, 7, 8)
#: Slots are learnt that so many labelled documents have, and that are common (in such a share of them) or go with one label beyond chance (by so many standard errors).
MIN_DOCS = 4
COMMON = 0.05
MIN_FAR = 4.0
#: So are, however rare they are and whatever they tell alone, both terms of a pair that so many labelled documents have, if its labels lie so far (in nats) from what the two terms tell each by itself.
PAIR_DOCS = 8
PAIR_EVIDENCE = 20.0
#: The vectors of such terms start so many times as long as others, since what they tell is in their product alone.
HEAD_START = 10
#: Pairs are counted in so many cells at a time.
COUNTED = 4_000_000
FACTORS = 4
BATCH = 128
STEPS = 900
RATE = 0.1
L2 = 1e-3
_U = np.uint64


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32 per slot
    vectors: np.ndarray  # float32 per slot and factor

    def scores(self, slots: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Probabilities of texts whose distinct slots are slots[edges[i]:edges[i + 1]]."""
        out = np.full(len(edges) - 1, self.bias)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            at = edges[full]
            v = self.vectors[slots].astype(np.float64)
            s, q = np.add.reduceat(v, at, axis=0), np.add.reduceat((v * v).sum(1), at)
            out[full] += np.add.reduceat(self.weights[slots].astype(np.float64), at) + 0.5 * ((s * s).sum(1) - q)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def marked_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct slots of each text's terms (runs of letters, A-Z as a-z) and of the beginnings of longer ones, where each text's begin, and whether a slot is of a whole term."""
    words = words_of(column, fold=True, separators=NO_LETTERS, heads=STEMS)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)).astype(_U) << _U(BITS)
    whole = np.unique(text | (words.hashes >> _U(64 - BITS)))
    both = np.unique(np.concatenate([whole, *(text[at] | (h >> _U(64 - BITS)) for h, at in zip(words.heads, words.longer, strict=True))]))
    marks = np.zeros(len(both), bool)
    marks[np.searchsorted(both, whole)] = True
    return (both & _U(2**BITS - 1)).astype(np.int32), np.searchsorted(both, np.arange(len(words.first), dtype=_U) << _U(BITS)), marks


def term_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """marked_slots() without the marks."""
    return marked_slots(column)[:2]


def telling_pairs(terms: list[np.ndarray], y: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Slots of pairs whose documents' labels are not what the two slots tell apart from each other; one of each pair at least is among silent (per slot).

    terms: the distinct slots of each document. The labels expected of a pair are those of independent terms (their
    log-odds add); how unlikely the actual ones are is measured by relative entropy, which holds for small counts too.
    All pairs of all documents are counted, a block of silent slots at a time.
    """
    size = np.array([len(t) for t in terms], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *terms]).astype(np.int64)
    seen, labelled = np.bincount(flat, minlength=len(silent)), np.bincount(flat, np.repeat(y, size), len(silent))
    known = np.flatnonzero(seen >= PAIR_DOCS)
    known = np.concatenate([known[silent[known]], known[~silent[known]]])  # the silent ones first
    asked = int(silent[known].sum())
    if not asked:
        return known[:0]
    number = np.full(len(silent), -1)
    number[known] = np.arange(len(known))
    own, doc = number[flat], np.repeat(np.arange(len(terms)), size)
    own, doc = own[own >= 0], doc[own >= 0]
    placed = np.sort(doc * len(known) + own)
    doc, own = np.divmod(placed, len(known))
    last = np.searchsorted(doc, np.arange(1, len(terms) + 1))
    by_slot = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[by_slot], np.arange(len(known) + 1))
    base = np.log(y.mean() / (1 - y.mean()))
    odds = np.log((labelled[known] + y.mean()) / (seen[known] - labelled[known] + 1 - y.mean())) - base
    found = np.zeros(len(known), bool)
    label = 2.0**32 + y  # counts documents above and those of label 1 below
    low = 0
    while low < asked:
        # A pair of two silent slots is counted with the first of them: slots before this block take no part any more.
        width = len(known) - low
        high = min(asked, low + max(1, COUNTED // width))
        here = by_slot[edges[low] : edges[high]]
        slot = np.repeat(np.arange(high - low), np.diff(edges[low : high + 1]))
        start = np.searchsorted(placed, np.arange(len(terms)) * len(known) + low)
        length = (last - start)[doc[here]]
        total: np.ndarray | float = 0.0
        for a, b in _portions(np.cumsum(length), COUNTED):
            n = length[a:b]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[doc[here[a:b]]], n)
            total += np.bincount(np.repeat(slot[a:b] * width - low, n) + own[step], np.repeat(label[doc[here[a:b]]], n), (high - low) * width)
        often = np.flatnonzero(total >= PAIR_DOCS * 2.0**32)
        n, k = np.divmod(total[often], 2.0**32)
        s, t = low + often // width, low + often % width
        n, k, s, t = (x[s != t] for x in (n, k, s, t))
        expected = np.clip(1 / (1 + np.exp(-(base + odds[s] + odds[t]))), 0.02, 0.98)
        share = k / n
        with np.errstate(divide="ignore", invalid="ignore"):
            far = n * (np.where(share > 0, share * np.log(share / expected), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - expected)), 0))
        found[s[far >= PAIR_EVIDENCE]] = found[t[far >= PAIR_EVIDENCE]] = True
        low = high
    return known[found]


def _portions(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes (summed up in ends) come to about so much each."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def fit(rows: list[tuple], seed: int = 1, spread: float = 0.01) -> Model:
    """Logistic loss by Adagrad over small batches; the classes weigh the same. Without both labels the score is constant.

    rows: (slots, label, and which of the slots are of whole terms: by default all). Slots are learnt that are common,
    that tell by themselves, or that tell in a pair of whole terms, so few that rare ones can't be learnt by heart.
    Vectors start at random values of this spread; at 0 they stay 0, which leaves the linear score.
    """
    y = np.array([r[1] for r in rows], float)
    model = Model(0.0, np.zeros(2**BITS, np.float32), np.zeros((2**BITS, FACTORS), np.float32))
    if not len(y) or y.min() == y.max():
        model.bias = -5.0 if not len(y) or y.max() == 0 else 5.0
        return model
    seen, labelled = np.zeros((2, 2**BITS))
    for slots, label, *_ in rows:
        seen[slots] += 1
        labelled[slots] += label
    # How many standard errors a slot's share of label 1 lies from the whole's: rare slots are learnt only if that is far.
    far = np.abs(labelled - seen * y.mean()) / np.sqrt(np.maximum(seen, 1) * y.mean() * (1 - y.mean()))
    tells = (seen >= min(MIN_DOCS, len(y) // 10 + 1)) & ((far >= MIN_FAR) | (seen >= COMMON * len(y)))
    paired = telling_pairs([r[0][r[2]] if len(r) > 2 else r[0] for r in rows], y, ~tells)
    tells[paired] = True
    kept = np.flatnonzero(tells)
    number = np.full(2**BITS, -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    ids = [n[n >= 0] for n in (number[r[0]] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(kept)), rng.normal(0, 1, (len(kept), FACTORS)) * spread, 0.0
    v[np.isin(kept, paired)] *= HEAD_START
    gw, gv, gb = np.full(len(kept), 1e-3), np.full((len(kept), FACTORS), 1e-3), 1e-3
    cost = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    steps = -(-len(y) // BATCH)
    for _ in range(-(-STEPS // steps)):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            n = np.array([len(ids[i]) for i in batch])
            x = np.concatenate([ids[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), n)
            vx = v[x]
            s = np.stack([np.bincount(row, vx[:, f], len(batch)) for f in range(FACTORS)], 1)
            z = b + np.bincount(row, w[x], len(batch)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (vx * vx).sum(1), len(batch)))
            g = cost[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            used, inverse = np.unique(x, return_inverse=True)
            dw = np.bincount(inverse, g[row], len(used)) + L2 * w[used]
            pull = g[row][:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(FACTORS)], 1) + L2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            b -= RATE * g.sum() / np.sqrt(gb)
    model.bias = float(b)
    model.weights[kept], model.vectors[kept] = w, v
    return model


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, never learnt from: crc32 of doc_id as text, divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, slots) of about so many labelled documents outside the held-out fifth; slots are 4-byte binaries, those of whole terms marked by the bit above them. Null labels and doc_ids are left out."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, rows / max(1, usable.count()))
    usable = usable.filter(F.xxhash64("doc_id", F.lit("train")) <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                slots, edges, whole = marked_slots(part.column(2))
                slots = (slots | whole.astype(np.int32) << BITS).astype("<i4")
                lists = [slots[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.binary())], ["doc_id", "toxic", "slots"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(small(usable), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, slots binary")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic from the texts alone.

    The sample meets sorted in one task, which its bound allows, so reruns and retried tasks give the same model; only
    slots that were learnt travel to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(slots, "<i4"), toxic) for batch in batches for toxic, slots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        m = fit([(slots & (2**BITS - 1), toxic, slots >= 2**BITS) for slots, toxic in rows])
        used = np.flatnonzero(m.weights != 0)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), *(pa.array([x.tobytes()], pa.binary()) for x in (used, m.weights[used], m.vectors[used]))], ["bias", "used", "weights", "vectors"])

    learnt = sample(docs, labels, rows).repartition(1).sortWithinPartitions("doc_id", "slots", "toxic")
    row = learnt.mapInArrow(run, "bias double, used binary, weights binary, vectors binary").first()
    model = Model(0.0, np.zeros(2**BITS, np.float32), np.zeros((2**BITS, FACTORS), np.float32))
    if row is None:  # an empty partition runs no task
        return fit([])
    used = np.frombuffer(row.used, np.int64)
    model.bias, model.weights[used], model.vectors[used] = row.bias, np.frombuffer(row.weights, np.float32), np.frombuffer(row.vectors, np.float32).reshape(-1, FACTORS)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, others) with __score, the probability of label 1.

    Null and empty texts get the score of no terms. Equal texts get equal scores; rows and columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    at, names = named.columns.index("__text"), [*docs.columns, "__score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                scores = shared.value.scores(*term_slots(part.column(at)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), pa.array(scores)], names)

    return named.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", __score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those that score at least the threshold."""
    return score(docs, model).filter(F.col("__score") < threshold).drop("__score")
