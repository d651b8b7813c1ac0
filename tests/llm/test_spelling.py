import random
import re
import zlib
from collections import Counter, defaultdict

from lodestone.llm import queries, spelling

DATA = "/root/testdata/sf0.001"


def by_deletion(counts, factor=2):
    """word -> (form, root, n, n_near, form_n), from the words that share what is left after one deletion."""
    shared = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shared[w[:i] + w[i + 1 :], i].add(w)  # replaced: the same place is missing
            shared[w[:i] + w[i + 1 :], None].add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            near[w] |= shared[rest, i] - {w}
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, all_ in near.items():
        best = min(all_, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def grouped(spark, counts):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}


def random_words(seed, n, letters):
    pick = random.Random(seed)
    return {"".join(pick.choices(letters, k=pick.randint(1, 7))): int(pick.paretovariate(0.7)) for _ in range(n)}


def test_random_words(spark):
    for seed, letters in enumerate(("ab", "abcdef", "aàbé÷xyz", "аб語🙂z")):
        counts = random_words(seed, 600, letters)
        assert grouped(spark, counts) == by_deletion(counts)


def test_many_cells(spark, monkeypatch):
    counts = random_words(9, 3000, "abcdeé")
    monkeypatch.setattr(spelling, "CELL", 60)
    monkeypatch.setattr(spelling, "TOLD", 3)
    monkeypatch.setattr(spelling, "SAMPLE", 900)
    assert grouped(spark, counts) == by_deletion(counts)


def test_equal_vectors(spark):
    pick = random.Random(3)
    counts = {"".join(pick.sample("abcdefghij", 10)): 1 + pick.randint(0, 3) for _ in range(500)} | {"abcdefghi": 9, "abcdefghik": 5}
    assert grouped(spark, counts) == by_deletion(counts)


def test_chains_and_ties(spark):
    counts = {"aaaa" + "b" * k: 3 * 2**k for k in range(12)} | {"aaaac": 3, "zebra": 8, "zebru": 4, "zebro": 4, "zebrax": 8}
    got = grouped(spark, counts)
    assert got == by_deletion(counts)
    assert got["aaaa"][1] == "aaaa" + "b" * 11 and got["zebru"][0] == "zebra"


def test_odd_rows(spark):
    rows = [(None, 3), ("", 4), ("word", None), ("same", 2), ("same", 3), ("x" * 5000, 1), ("x" * 5001, 9), ("sane", 100)]
    got = {r.word: (r.n, r.form) for r in spelling.group(spark.createDataFrame([(*r, "a", 1) for r in rows], "word string, n long, form string, cell int")).collect()}
    assert got == {"same": (5, "sane"), "sane": (100, None), "x" * 5000: (1, "x" * 5001), "x" * 5001: (9, None)}
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling_variants(spark, DATA).collect()}
    assert got == by_deletion(counts) and sum(x[0] is not None for x in got.values()) > 20
