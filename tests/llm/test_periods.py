import hashlib
import random
import zlib
from fractions import Fraction

from lodestone.llm import periods, queries
from tests.llm.helpers import odd, words

DATA = "/root/testdata/sf0.001"


def by_definition(w, min_length=6, exponent=4):
    """(start, length, period) of all runs: each period by itself, kept where no smaller one holds."""
    found = []
    for q in range(1, len(w) // exponent + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            elif not x and start is not None:
                n = i - start + q
                if n >= max(min_length, exponent * q) and not any(all(w[k] == w[k + d] for k in range(start, start + n - d)) for d in range(1, q)):
                    found.append((start, n, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_texts(seed):
    pick = random.Random(seed)
    out = []
    for n in range(400):
        text = []
        while len(text) < pick.randint(0, 60):
            unit = [pick.choice("abc"[: pick.randint(1, 3)]) for _ in range(pick.randint(1, 7))]
            text += unit * pick.choice([1, 1, 2, 3, 4, 5, 6]) + unit[: pick.randint(0, len(unit))]
        out.append((n, " ".join(text)))
    return out


def checked(spark, rows, **options):
    got = periods.collapse(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(r.text)
        want = by_definition(w, **options)
        assert [tuple(x) for x in r["__runs"]] == want, r.text
        assert r["__n_words"] == len(w) and r["__collapsed"] == collapsed(w, want)


def test_random_texts(spark):
    checked(spark, random_texts(1))
    checked(spark, random_texts(2), min_length=2, exponent=2)
    checked(spark, random_texts(3), min_length=12, exponent=3)


def test_known_strings(spark):
    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(morse)), (2, " ".join("abaab" * 8)), (3, "a " * 6), (4, "a " * 5), (5, "a b " * 3 + "a"), (6, "a b " * 4), (7, "x\ta\na  b a b a b a b y")]
    got = {r.doc_id: [tuple(x) for x in r["__runs"]] for r in periods.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 40, 5)], 3: [(0, 6, 1)], 4: [], 5: [], 6: [(0, 8, 2)], 7: [(2, 8, 2)]}


def test_texts_do_not_run_into_each_other(spark):
    checked(spark, [(n, "a a a") for n in range(50)])


def test_odd_rows(spark):
    docs = odd(spark)
    out = periods.collapse(docs)
    assert out.columns == [*docs.columns, "__n_words", "__runs", "__collapsed"]
    for r in out.collect():
        w = words(r.text)
        want = [(0, len(w), 1)] if len(w) > 1000 else by_definition(w)
        assert [tuple(x) for x in r["__runs"]] == want and r["__collapsed"] == collapsed(w, want)
    assert periods.collapse(docs.limit(0)).count() == 0


def planted(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        w = planted(r.doc_id, texts[r.doc_id])
        if len(w) > 900:
            continue
        runs = by_definition(w)
        some += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * r.length // r.period if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert some > 5
