from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import query_tokens
from lodestone.operators import embedding, latent
from lodestone.plans import catalog

DATA = "/root/testdata"


def tf_idf(texts, slots):
    """By the definition, text by text."""
    counts = [Counter(crc32(t.encode()) % slots for t in query_tokens(text or "")) for text in texts]
    df = Counter(s for c in counts for s in c)
    out = np.zeros((len(texts), slots))
    for row, c in zip(out, counts):
        for s, n in c.items():
            row[s] = (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[s])) + 1)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-30)[:, None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").persist()


def test_equals_dense_svd(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    a = tf_idf([r.text for r in rows], 1024)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    model = latent.train(docs, dim=4, slots=1024, rounds=6)
    assert np.allclose(model.strengths, s[:4], rtol=1e-4)
    want = a @ v[:4].T
    want /= np.linalg.norm(want, axis=1)[:, None]
    got = np.array([r.embedding for r in latent.embed(docs, "doc_id", model).orderBy("doc_id").collect()])
    assert np.abs(got @ got.T - want @ want.T).max() < 0.02


def test_blocks_and_ranges(spark, docs, monkeypatch):
    whole = latent.train(docs, dim=4, slots=300)
    monkeypatch.setattr(latent, "ROWS", 7)
    monkeypatch.setattr(latent, "RANGE", 64)
    monkeypatch.setattr(latent, "LONG", 500)
    small = latent.train(docs.repartition(9), dim=4, slots=300)
    assert np.allclose(whole.strengths, small.strengths, rtol=1e-4) and np.allclose(whole.vectors, small.vectors, atol=1e-2)


def test_odd_texts(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "one two"), ("c", "one two"), ("d", "x " * 5), ("e", "one three " * 30_000)], "name string, text string").withColumn("id", F.lit(1)).withColumn("at", F.lit(2))
    model = latent.train(df)
    got = sorted((r.name, r.embedding) for r in latent.embed(df, "name", model).select(F.col("name"), "embedding").collect())
    assert [n for n, _ in got] == ["a", "b", "c", "c", "d", "e"]
    length = [round(float(np.linalg.norm(v)), 4) for _, v in got]
    assert length == [0, 0, 1, 1, 0, 1] and got[2] == got[3] and (model.strengths > 0).sum() == 2
    none = latent.train(df.limit(0))
    assert not none.vectors.any() and latent.embed(df.limit(0), "name", none).count() == 0
    assert np.abs(np.array(latent.embed(df, "name", none).first().embedding)).sum() == 0


def test_saved_model_and_new_texts(spark, docs, tmp_path):
    model = latent.train(docs, dim=6, slots=512)
    model.save(spark, str(tmp_path / "m"))
    again = latent.Latent.load(spark, str(tmp_path / "m"))
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.idf, again.idf) and np.array_equal(model.strengths, again.strengths)
    new = spark.createDataFrame([(1, docs.first().text + " and more")], "id long, text string")
    assert latent.embed(new, "id", again).collect() == latent.embed(new, "id", model).collect()


def own_half_first(df, embed):
    """How often the second half that is nearest to a text's first half is its own."""
    words = F.split("text", " ")
    half = (F.size(words) / 2).cast("int")
    first, second = (df.select("doc_id", F.array_join(x, " ").alias("text")) for x in (F.slice(words, 1, half), F.slice(words, half + 1, half + 1)))
    a, b = (np.array([r.embedding for r in embed(x).orderBy("doc_id").collect()]) for x in (first, second))
    scores = a @ b.T
    return np.mean(scores.diagonal() >= scores.max(1) - 1e-6)


def test_halves_find_each_other_better_than_by_hashed_counts(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").filter(F.length("text") > 400).select("doc_id", "text").persist()
    model, df = latent.train(df.filter("doc_id % 2 = 0")), df.filter("doc_id % 2 = 1")  # judged on texts it was not learnt from
    learnt, hashed = own_half_first(df, lambda x: latent.embed(x, "doc_id", model)), own_half_first(df, lambda x: embedding.embed(x, "doc_id"))
    print(f"learnt {learnt:.3f} hashed {hashed:.3f}")
    assert learnt > hashed


def test_query(spark):
    rows = catalog.QUERIES["embed_latent"](spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == 200 and all(len(r.embedding) == 64 for r in rows)


def test_counted_once_gives_the_same(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one three two " * 50), (5, "snake_case Words"), (6, "one two")], "doc_id long, text string")
    counts = latent.counted(df, "doc_id")
    assert {r.id: len(r.slot) for r in counts.collect()}.keys() == {1, 2, 3, 4, 5, 6}
    model = latent.train_counted(counts)
    got = {r.doc_id: r.embedding for r in latent.embed_counted(counts, "doc_id", model).collect()}
    want = {r.doc_id: r.embedding for r in latent.embed(df, "doc_id", latent.train(df)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(np.abs(got[k]), np.abs(want[k]), atol=1e-4) for k in got) and got[3] == got[6]
