import re
from itertools import combinations

import numpy as np

from lodestone.llm import components, neardup, queries
from tests.llm.helpers import SCHEMA, odd, words

DATA = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=85):
    sets = [shingles(r.text) for r in rows]
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if rows[i].doc_id is None or rows[j].doc_id is None:
            continue
        both = len(sets[i] & sets[j])
        if both and 100 * both >= threshold * len(sets[i] | sets[j]):
            a, b = sorted((find(rows[i].doc_id), find(rows[j].doc_id)))
            root[b] = a
    return sorted((r.doc_id if r.doc_id is not None else -1, len(s), -1 if r.doc_id is None else find(r.doc_id), r.doc_id is None or find(r.doc_id) == r.doc_id) for r, s in zip(rows, sets, strict=True))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = brute(rows)
    assert sum(1 for r in want if not r[3]) > 5
    assert got(queries.op6_minhash_neardup(spark, DATA)) == want


def test_chains_without_a_common_leader(spark):
    """Each text is near its neighbours only, and a bucket's leader isn't near most of its members."""
    base = [f"w{i}" for i in range(400)]
    docs = []
    for k in range(30):
        docs.append((1000 - k, " ".join([*(f"x{i}" for i in range(3 * k)), *base[3 * k :]]), "s"))
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(neardup.link(df)) == brute(df.collect())


def test_odd_rows(spark):
    docs = odd(spark)
    assert got(neardup.link(docs)) == brute(docs.collect())
    assert neardup.link(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f g", ""), (5, "p q r s t u v", ""), (7, "p q r s t u v", ""), (3, "a b c d e f g", ""), (9, "only here", "")], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in neardup.link(twice).collect()} == {(5, 3), (7, 3), (3, 3), (9, 9)}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(7, 7), (41, None)]
    got_ = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got_ == {i: 0 for i in range(41)} | {i: 50 for i in [*range(50, 80), 100]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lower_threshold(spark):
    base = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(w if (j * 31 + i) % 41 or j % 97 != i % 97 else f"x{i}" for j, w in enumerate(base)), "s") for i in range(60)]
    docs += [(100 + i, " ".join(base[: 300 - 2 * i]), "s") for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(neardup.link(df, 80)) == brute(df.collect(), 80)


def test_one_doc_id_over_many_texts(spark):
    """A doc_id whose rows fall in three classes holds all of them together, at every place in the order."""
    texts = ["a b c d e f g", "p q r s t u v", "k l m n o i j", "1 2 3 4 5 6 7"]
    docs = [(i + 1, t, "s") for i, t in enumerate(texts[:3])] + [(5, t, "s") for t in texts[:3]] + [(9, texts[3], "s"), (9, "only here it is said", "s"), (9, texts[3], "s"), (8, texts[3], "s")]
    got_ = {(r.doc_id, r.component_id, r.kept) for r in neardup.link(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got_ == {(1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (9, 8, False), (8, 8, True)}


def near_copies(n, words_, changed, seed=5):
    """Copies of one text, each with some words changed for words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words_)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.choice(words_, changed(k), replace=False):
            text[at] = f"x{k}y{at}"
        out.append((k, " ".join(text), "s"))
    return out


def sparse_brute(rows, threshold):
    """Components by exact counts over an inverted index, for groups that are too large for pairs in Python."""
    sets = [shingles(t) for _, t, _ in rows]
    ids = {}
    coded = [np.array([ids.setdefault(x, len(ids)) for x in s]) for s in sets]
    n = np.array([len(s) for s in sets])
    has = np.zeros((len(rows), len(ids)), np.float32)
    for i, c in enumerate(coded):
        has[i, c] = 1
    has = has[:, has.sum(axis=0) > 1]
    both = has @ has.T
    near = 100 * both >= threshold * (n[:, None] + n[None, :] - both)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[near[i]].min(initial=label[i]) for i in range(len(rows))])
        new = new[new]
        if (new == label).all():
            return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
        label = new


def test_large_group_around_the_threshold(spark, monkeypatch):
    """3,000 near copies of which few link; compared in several blocks."""
    rows = near_copies(3000, 150, lambda k: k % 9)
    want = sparse_brute(rows, 85)
    assert 300 < len(set(want.values())) < 2900
    for block in (neardup.BLOCK, 60_000):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got_ = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got_ == want


def shuffled(spark, run):
    """What a run writes to shuffle files, in bytes."""
    before = {s.stageId(): s.shuffleWriteBytes() for s in stages(spark)}
    run()
    return sum(s.shuffleWriteBytes() for s in stages(spark) if s.stageId() not in before)


def stages(spark):
    listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [listed.apply(i) for i in range(listed.size())]


def test_shuffle_of_a_group_just_under_the_threshold_grows_with_its_rows(spark):
    """Near copies that all miss the threshold with each other: their sets are sent a constant number of times, though all share buckets."""
    sizes = {}
    for n in (500, 2000):
        rows = near_copies(n, 500, lambda k: 5)
        df = spark.createDataFrame(rows, SCHEMA).repartition(4).persist()
        df.count()
        sizes[n] = shuffled(spark, lambda: neardup.link(df).collect())  # noqa: B023
    assert sizes[2000] < 6 * sizes[500]
    assert sizes[2000] < 4 * sum(len(t) for _, t, _ in rows)


def test_forest():
    rng = np.random.default_rng(8)
    near = rng.random((60, 70)) < 0.02
    x, y = neardup._forest(near)
    assert near[x, y].all()

    def parts(edges):
        root = list(range(130))

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            root[find(a)] = find(60 + b)
        return [find(v) for v in range(130)]

    a, b = parts(zip(*np.nonzero(near), strict=True)), parts(zip(x, y, strict=True))
    assert len({*zip(a, b, strict=True)}) == len(set(a)) == len(set(b))


def test_recall_over_all_pairs(spark):
    """Every component of the larger tables that brute force finds, no fewer and no more."""
    data = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = sparse_brute([r for r in rows if shingles(r[1])], 85)
    got_ = {r.doc_id: r.component_id for r in queries.op6_minhash_neardup(spark, data).collect() if r.n_shingles}
    assert got_ == want
