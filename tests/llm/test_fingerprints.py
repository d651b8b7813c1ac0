import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, queries
from tests.llm.helpers import odd

DATA = "/root/testdata/sf0.001"


def next_of(rows, tie=lambda text: 0):
    """Rows by descending doc_id, null last, ties by a hash of the text and the text; each with the one after it."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    return [(r, order[(i + 1) % len(order)]) for i, r in enumerate(order)]


def mixed(h):
    for _ in range(2):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ (h >> 32)


def slow(text):
    """The fingerprint by its definition, byte by byte."""
    data = (text or "").encode()
    table, bases = [int(x) for x in fingerprints._TABLE], [int(x) for x in fingerprints._CONTEXT_BASE]
    size = 1
    while len(data) > 64 * size:
        size *= 2
    out = [str(size)]
    for s in (size, 2 * size):
        sign, start = "", 0
        for i in range(len(data)):
            rolling = mixed(sum(table[data[i - k]] * bases[k] for k in range(7)) % 2**64) if i >= 6 else 0
            if (rolling % s == s - 1 and i + 1 - start >= s // 4) or i + 1 == len(data):
                piece = mixed(sum(table[c] * pow(fingerprints._PIECE_BASE, k, 2**64) for k, c in enumerate(data[start : i + 1])) % 2**64)
                sign += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[piece >> 58]
                start = i + 1
        out.append(sign)
    return ":".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def like(x, y):
    if x == y:
        return 1.0
    (a, a1, a2), (b, b1, b2) = x.split(":"), y.split(":")
    near = lambda p, q: 1.0 - distance(p, q) / max(len(p), len(q)) if p or q else 1.0
    a, b = int(a), int(b)
    return max(near(a1, b1), near(a2, b2)) if a == b else near(a1, b2) if a == 2 * b else near(a2, b1) if b == 2 * a else 0.0


def test_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op3_piecewise_fingerprints(spark, DATA).collect()}
    alone = {d: fingerprints.fingerprint_all(pa.array([t]))[0] for d, t in docs}
    assert len(got) == len(docs)
    better = 0
    for (d, text), (e, following) in next_of(docs):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == alone[d] and r.edited_fingerprint == fingerprints.fingerprint_all(pa.array([changed]))[0]
        assert abs(r.near_next - like(alone[d], alone[e])) < 1e-9 and abs(r.near_edited - like(r.fingerprint, r.edited_fingerprint)) < 1e-9
        better += r.near_edited > r.near_next or d == e
    assert better > 0.95 * len(docs)


def test_fingerprints_by_definition(spark, monkeypatch):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(40).collect()
    texts = [r.text for r in rows] + ["", None, "a", "abcdef", "abcdefg", "aaaaaaaa" * 40, "Ünï çödé wörds " * 30]
    want = [slow(t) for t in texts]
    assert fingerprints.fingerprint_all(pa.array(texts)) == want
    for size in (5, 64, 777):  # long texts in slices
        monkeypatch.setattr(fingerprints, "CHUNK_BYTES", size)
        fingerprints._all_powers.cache_clear()
        assert fingerprints.fingerprint_all(pa.array(texts)) == want
    monkeypatch.undo()
    fingerprints._all_powers.cache_clear()


def test_boundaries_move_with_the_text():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(4000))
    a, b = fingerprints.fingerprint_all(pa.array([text, "inserted at the front " + text]))
    assert like(a, b) > 0.9
    assert fingerprints.fingerprint_all(pa.array(["", None])) == ["1::", "1::"]
    long = fingerprints.fingerprint_all(pa.array(["a" * 500_000, "ab " * 100_000]))
    assert all(len(x) < 1000 for x in long)


def test_ranges_and_odd_rows(spark):
    docs = odd(spark).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.concat(F.lit("t"), "id").alias("text")
    tables = {
        "odd": docs,
        "ties": spark.range(3000).select(((F.col("id") * 37) % 2500).alias("doc_id"), text),
        "large": spark.range(900).select((F.lit(2**60) + F.col("id")).alias("doc_id"), text),
        "negative": spark.range(900).select((F.lit(-(2**62)) + F.col("id") * 1000).alias("doc_id"), text),
        "null": spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), text),
        "one": spark.range(5000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.lit(777)).alias("doc_id"), text),
    }
    for name, df in tables.items():
        rows = df.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(2**20)).alias("h")).collect()
        hashes = {r.text: r.h for r in rows}
        got = sorted((str(r.doc_id), r.text, r.next_text) for r in fingerprints.with_next(df).collect())
        want = next_of([(r.doc_id, r.text) for r in rows], hashes.get)
        assert got == sorted((str(a[0]), a[1], b[1]) for a, b in want), name
    assert fingerprints.edited(docs.limit(0)).count() == 0
    assert fingerprints.fingerprints(docs, {"text": "f"}).columns == [*docs.columns, "f"]
    clash = docs.select("doc_id", "text", F.lit("x").alias("next_text"), F.lit("y").alias("edited"))
    assert sorted(fingerprints.edited(clash).columns) == ["doc_id", "edited", "n_chars", "next_text", "text"]
