import hashlib
import random

from lodestone.llm import queries, substrings
from tests.llm.helpers import SCHEMA, odd, words

DATA = "/root/testdata/sf0.001"


def brute(rows, window=50):
    first = {}
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(((substrings.NO_ID if r.doc_id is None else r.doc_id), r["__n_words"], r["__n_removed"], hashlib.sha256(r["__kept"].encode()).hexdigest()) for r in df.collect())


def pairs(df):
    return [(substrings.NO_ID if r.doc_id is None else r.doc_id, r.text) for r in df.collect()]


def test_query_by_brute_force(spark):
    want = brute(pairs(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert sum(r[2] > 0 for r in want) > 5
    assert sorted(map(tuple, queries.op2_substring_dedup(spark, DATA).collect())) == want


def test_mosaics(spark):
    """Passages cut, moved and spliced so that repeats begin, end and nest everywhere, some within one document."""
    rng = random.Random(5)
    pool = [f"w{rng.randrange(60)}" for _ in range(1500)]
    docs = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 7)):
            a = rng.randrange(1400)
            part = pool[a : a + rng.randrange(10, 130)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "odd"
            text += part
        docs.append((rng.randrange(50), " ".join(text), "s"))
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(substrings.remove(df)) == brute(pairs(df))
    assert got(substrings.remove(df, 9)) == brute(pairs(df), 9)


def test_odd_rows(spark):
    docs = odd(spark)
    assert got(substrings.remove(docs)) == brute(pairs(docs))
    assert substrings.remove(docs.limit(0)).count() == 0
    out = substrings.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_many_rows_without_an_id(spark):
    """10,000 rows without doc_id, many of them equal, and one doc_id with many rows: none of it meets in one group."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(70))
    own = lambda i: " ".join(f"{i}x{rng.randrange(9)}" for _ in range(5))
    docs = [(None, f"{own(i)} {passage}" if i % 3 else passage, "s") for i in range(10_000)] + [(7, f"{passage} {own(i)}", "s") for i in range(300)] + [(3, f"a {passage}", "s")]
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(substrings.remove(df)) == brute(pairs(df))


def test_maximal_repeats(spark):
    runs = [(1, 0, 9, 0, 4, 0, 3), (1, 0, 9, 0, 4, 3, 8), (1, 0, 9, 0, 4, 9, 9), (1, 0, 9, 0, 4, 11, 12), (1, 0, 9, 0, 5, 1, 2), (1, 0, 9, 1, 4, 4, 4), (2, 0, 9, 0, 4, 0, 20), (2, 0, 9, 0, 4, 3, 5)]
    got_ = substrings.maximal(spark.createDataFrame(runs, "__id long, __key long, l_id long, l_key long, shift int, lo int, hi int")).collect()
    assert sorted((r["__id"], r.lo, r.hi) for r in got_) == [(1, 0, 9), (1, 1, 2), (1, 4, 4), (1, 11, 12), (2, 0, 20)]
