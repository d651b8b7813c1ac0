import numpy as np
import pytest

from lodestone.operators import ranking, vectors
from lodestone.plans import catalog

DATA = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>"


def table(spark, n=600, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 4 * rng.normal(size=(12, dim))[rng.integers(0, 12, n)]
    x[n // 2] = x[0]
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(n, None)], SCHEMA)


def exact_best(df, k):
    rows = [(r.vec_id, np.array(r.embedding, np.float32).astype(float)) for r in df.collect() if r.embedding]
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted(((-round(float(v @ x), 6), i) for i, x in rows))[:k]
            out[q] = [i for _, i in scores]
    return out


def found_by(df, index, k, **options):
    queries = df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    out = {}
    for r in sorted(vectors.search(index, queries, "q", k, **options).collect(), key=lambda r: (r.q, r.rank)):
        out.setdefault(r.q, []).append(r.id)
    return out


def test_exact_mode_equals_brute_force(spark):
    df = table(spark)
    index = vectors.build(df, "vec_id", vectors.train(df, "vec_id"))
    assert index.sizes.sum() == 600 and len(index.centroids) == 24
    for k, probes in ((5, 1), (10, 3), (700, 2)):
        assert found_by(df, index, k, probes=probes, exact=True) == exact_best(df, k)


def test_blocks_of_one_list(spark, monkeypatch):
    """All vectors in one list of several blocks."""
    monkeypatch.setattr(vectors, "SLICE", 50)
    df = table(spark)
    index = vectors.build(df, "vec_id", np.zeros((2, 8)))
    assert sorted(index.sizes.tolist()) == [0, 600]
    assert found_by(df, index, 7, probes=1) == exact_best(df, 7)


def test_recall_over_the_given_vectors(spark):
    rows = catalog.QUERIES["cosine_topk_probed"](spark, DATA).collect()
    want = exact_best(spark.read.parquet(f"{DATA}/embeddings.parquet"), 10)
    got = {q: {r.vec_id for r in rows if r.query_id == q} for q in want}
    assert np.mean([len(got[q] & {*ids}) / len(ids) for q, ids in want.items()]) >= 0.9


def test_few_probes_for_vectors_in_clusters(spark):
    df = table(spark, n=2000, dim=16, seed=4)
    index = vectors.build(df, "vec_id", vectors.train(df, "vec_id"))
    probes = vectors.calibrate(index, df, "vec_id", 10)
    want, got = exact_best(df, 10), found_by(df, index, 10, probes=probes)
    assert probes < len(index.centroids) / 2
    assert np.mean([len({*got[q]} & {*ids}) / len(ids) for q, ids in want.items()]) >= 0.9


def test_only_asked_lists_are_read(spark):
    df = table(spark)
    index = vectors.build(df, "vec_id", vectors.train(df, "vec_id"))
    plan = index.vectors(spark).filter("list IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_odd_vectors(spark):
    df = table(spark)
    index = vectors.build(df, "vec_id", vectors.train(df, "vec_id"))
    assert vectors.search(index, df.filter("embedding IS NULL"), "vec_id", 3).count() == 0
    empty = vectors.build(df.limit(0), "vec_id", index.centroids)
    assert vectors.search(empty, df, "vec_id", 3, exact=True).count() == 0 and len(vectors.train(df.limit(0), "vec_id")) == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.search(index, spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), "vec_id", 3).collect()
    named = df.selectExpr("concat('v', vec_id) AS vec_id", "embedding")
    by_name = vectors.build(named, "vec_id", index.centroids)
    assert vectors.search(by_name, named.filter("vec_id = 'v3'"), "vec_id", 1, exact=True).first().id == ranking.top(ranking.cosine(named, named.filter("vec_id = 'v3'"), "vec_id"), 1, "vec_id").first().vec_id


def test_products_are_held_a_few_at_a_time():
    import tracemalloc

    rnd = np.random.default_rng(2)
    q, v = rnd.standard_normal((2000, 16)).astype(np.float32), rnd.standard_normal((4096, 16)).astype(np.float32)
    tracemalloc.start()
    row, found, score = ranking.best_of(q, v, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # all products at once are 65 MB, and 200 with their order
    want = np.argsort(-np.round(q.astype(float) @ v.T.astype(float), 6), axis=1, kind="stable")[:, :3]
    assert (found.reshape(-1, 3) == want).all() and (row == np.repeat(np.arange(2000), 3)).all() and len(score) == 6000
    assert [s.stop - s.start for s in ranking.pieces(5, ranking.PAIRS)] == [1] * 5 and [*ranking.pieces(0, 7)] == []
