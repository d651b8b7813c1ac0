from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import mixing, queries
from tests.llm.helpers import SCHEMA, odd, words

DATA = "/root/testdata/sf0.001"


def fill(sizes, weights, cap=3):
    """Targets by hand, in exact arithmetic."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(cap * sizes[s] for s in capped), sum(weights[s] for s in sizes if s not in capped)
        out = {s: cap * sizes[s] if s in capped else Fraction(weights[s] * rest, w or 1) for s in sizes}
        more = {s for s in sizes if out[s] > cap * sizes[s]}
        if not more:
            return out
        capped |= more


def test_query_keeps_to_its_targets(spark):
    rows = queries.op1_source_mix(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes = {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(sizes)
    expected = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len(words(docs[r.doc_id].text)) and r.source_size == sizes[source]
        assert abs(r.target - float(expected[source])) < 1e-6
        rate = float(expected[source] / sizes[source])
        assert r.taken in (r.size * int(rate), r.size * (int(rate) + 1)) and r.taken <= 3 * r.size
    assert sorted(rows) == sorted(queries.op1_source_mix(spark, DATA).collect())


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = queries.op1_source_mix(spark, DATA).toPandas().sort_values("doc_id")
    want = con.sql(queries.ORACLES["op1_source_mix"]).df().sort_values("doc_id")
    assert got[["doc_id", "size", "source_size", "target", "taken"]].values.tolist() == want[["doc_id", "size", "source_size", "target", "taken"]].values.tolist()


def test_caps_are_reshared(spark):
    per = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 1.0), ("c", 90, 100.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.targets(per).collect()}
    assert got["a"] == 30 and got["c"] == 270 and abs(sum(got.values()) - 1100) < 1e-9


def test_odd_rows(spark):
    docs = odd(spark)
    mixed = mixing.mix(docs)
    assert mixed.count() == docs.count()
    got = {(r.doc_id, r.source): r for r in mixed.collect()}
    assert got[(1, "a")]["__size"] == 0 and got[(1, "a")]["__target"] == 0  # a source of empty texts takes nothing
    assert got[(7, "c")]["__size"] == 30000
    assert {r["size"] for r in mixed.collect()} == {"extra"}
    assert mixing.emit(mixed).columns == docs.columns
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("__copies")).first()[0]
    assert mixing.emit(mixing.mix(spark.createDataFrame([], SCHEMA))).count() == 0


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], SCHEMA)
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    per = {r.source: r.n for r in mixing.emit(mixing.mix(docs, weights)).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(per["a"] - 300) < 40 and abs(per["b"] - 100) < 40


def test_large_sums(spark):
    """Sums that an int can't hold once a weight multiplies them, and far larger ones."""
    for scale in (1, 10**6):
        sizes = [200_000_000 * scale, 300_000_000 * scale, 250_000_000 * scale]
        docs = spark.createDataFrame([(i, "t", chr(97 + i), n) for i, n in enumerate(sizes)], "doc_id long, text string, source string, n long")
        got = {r.source: r["__target"] for r in mixing.mix(docs, size=F.col("n")).collect()}
        total = sum(sizes)
        want = {"a": total * 5 / 8, "b": total * 2 / 8, "c": total / 8}
        assert want["a"] < 3 * sizes[0] and all(abs(got[k] - v) <= 1e-9 * v for k, v in want.items())
