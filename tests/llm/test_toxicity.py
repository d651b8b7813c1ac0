import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import queries, toxicity
from tests.llm.helpers import SCHEMA, odd

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.op7_toxicity_fm(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and t for p, t in judged)
    assert hit / sum(p for p, _ in judged) > 0.95 and hit / sum(t for _, t in judged) > 0.9


def test_pairs_decide():
    """One term or the other is label 1, both or none is label 0: no linear score tells it, as the ablation shows."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(1600):
        a, b = rng.integers(0, 2, 2)
        noise = " ".join(f"n{'abcdefghijklmno'[x]}" for x in rng.integers(0, 15, 4))
        texts.append((f"{'insult ' if a else ''}{'group ' if b else ''}{noise}", int(a ^ b)))
    slots, edges = toxicity.term_slots(pa.array([t for t, _ in texts]))
    rows = [(slots[a:b], y) for (a, b), (_, y) in zip(zip(edges[:-1], edges[1:], strict=True), texts, strict=True)]

    def right(model):
        return np.mean([(model.scores(s, np.array([0, len(s)]))[0] >= 0.5) == y for s, y in rows[1200:]])

    assert right(toxicity.fit(rows[:1200])) > 0.95
    linear = toxicity.fit(rows[:1200], spread=0.0)
    assert not linear.vectors.any() and right(linear) < 0.8


def rare_pair(share, n=8000, seed=1):
    """Rows, and whether they have a term: two terms in so many of the rows each, half of the time together, which alone is label 1; all other rows have either label by chance."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        kind = int(rng.random() / share * 2)
        noise = " ".join(f"n{'abcdefghijklmno'[x]}" for x in rng.integers(0, 15, 4))
        texts.append((f"{'insult ' if kind in (0, 1) else ''}{'group ' if kind in (0, 2) else ''}{noise}", int(kind == 0) if kind < 3 else int(rng.integers(0, 2)), kind < 3))
    slots, edges = toxicity.term_slots(pa.array([t for t, *_ in texts]))
    return [(slots[a:b], y) for a, b, (_, y, _) in zip(edges[:-1], edges[1:], texts, strict=True)], np.array([has for *_, has in texts])


def test_rare_terms_that_tell_nothing_alone():
    for share in (0.01, 0.02, 0.04):
        rows, has = rare_pair(share)
        model = toxicity.fit(rows[:6000])
        right = [(model.scores(s, np.array([0, len(s)]))[0] >= 0.5) == y for (s, y), x in zip(rows[6000:], has[6000:], strict=True) if x]
        assert len(right) > 20 and np.mean(right) > 0.95


def test_telling_pairs_by_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    terms = [np.unique(rng.integers(0, 40, rng.integers(0, 20))) for _ in range(500)]
    y = np.array([float((1 in t) == (2 in t) and rng.random() < 0.9 or 30 in t) for t in terms])
    silent = np.arange(64) < 28
    base = np.log(y.mean() / (1 - y.mean()))
    want = set()

    def odds(x):
        k, n = sum(y[i] for i, t in enumerate(terms) if x in t), sum(x in t for t in terms)
        return np.log((k + y.mean()) / (n - k + 1 - y.mean())) - base

    for a in range(40):
        for b in range(a):
            both = [y[i] for i, t in enumerate(terms) if a in t and b in t]
            if len(both) < toxicity.PAIR_DOCS or not (silent[a] or silent[b]):
                continue
            p, e = np.mean(both), np.clip(1 / (1 + np.exp(-(base + odds(a) + odds(b)))), 0.02, 0.98)
            far = len(both) * ((p * np.log(p / e) if p else 0) + ((1 - p) * np.log((1 - p) / (1 - e)) if p < 1 else 0))
            if far >= 3:
                want |= {a, b}
    monkeypatch.setattr(toxicity, "PAIR_EVIDENCE", 3.0)
    assert {1, 2} <= want and len(want) < 30
    for counted in (toxicity.COUNTED, 100):
        monkeypatch.setattr(toxicity, "COUNTED", counted)
        assert set(toxicity.telling_pairs(terms, y, silent).tolist()) == want
    assert not len(toxicity.telling_pairs([], np.array([]), silent)) and not len(toxicity.telling_pairs(terms, y, silent & False))


def test_scores_by_definition():
    model = toxicity.Model(-1.0, np.zeros(2**toxicity.BITS, np.float32), np.zeros((2**toxicity.BITS, toxicity.FACTORS), np.float32))
    rng = np.random.default_rng(5)
    ids = np.array([3, 8, 20, 90])
    model.weights[ids], model.vectors[ids] = rng.normal(size=4), rng.normal(size=(4, toxicity.FACTORS))
    z = -1.0 + model.weights[ids].sum() + sum(model.vectors[a] @ model.vectors[b] for i, a in enumerate(ids) for b in ids[:i])
    got = model.scores(np.concatenate([ids, ids[:1]]), np.array([0, 0, 4, 5]))
    assert np.allclose(got, [1 / (1 + np.e), 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(1 - model.weights[3]))], atol=1e-5)


def test_odd_rows(spark):
    docs = odd(spark)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, nothing)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "__score"]
    assert toxicity.drop_toxic(docs, model).count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (4, 0), (6, 0), (7, 1), (2, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(0 <= r["__score"] <= 1 for r in scored)
    one = spark.createDataFrame([(1, "a b", "")], SCHEMA).select("doc_id", "text", F.lit(2).alias("label"))
    assert toxicity.score(one, model).columns == ["doc_id", "text", "label", "__score"]


def test_beginnings_count_for_longer_terms_only():
    stem, longer, other = (set(toxicity.term_slots(pa.array([t]))[0].tolist()) for t in ("scoundr", "scoundrels", "SCOUNDREL"))
    assert len(stem) == 4 and len(longer) == 6 and len(other) == 6  # 4, 5 and 6 bytes and the whole; 4 to 8 and the whole
    assert len(longer & other) == 5 and len(stem & longer) == 3
