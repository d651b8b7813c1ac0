import random

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import postings, ranking

WORDS = ["The", "the", "HTTPServer", "snake_case_name", "_x", "__", "a1b2", "aB", "Ab9C", "ÄÖl", "x", "naïve", "A_B", "end\n", "9z"]


def rows(n, ids):
    pick = random.Random(5)
    return [(ids(k), " ".join(pick.choices(WORDS, k=pick.randrange(30)))) for k in range(n)] + [(n, None), (n + 1, "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(df):
    return sorted(map(tuple, df.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").count().collect()))


def test_terms_are_counted_in_tasks(spark):
    df = spark.createDataFrame(rows(80, lambda k: k), "doc_id long, text string")
    got = ranking.terms_of(df, "doc_id")
    assert sorted(map(tuple, got.collect())) == brute(df) and "Exchange" not in plan(got)
    assert sorted(map(tuple, ranking.term_counts(df, ["the", "b"], "doc_id").collect())) == sorted((r.doc_id, len(r.t), [r.t.count("the"), r.t.count("b")]) for r in df.select("doc_id", text.tokens(F.col("text")).alias("t")).collect())


def test_rows_of_one_id_add_up(spark):
    df = spark.createDataFrame(rows(80, lambda k: k // 3 if k % 2 else None), "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = df.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").count()
    assert sorted(map(tuple, ranking.terms_of(df, "doc_id").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_tokens_of_plain_words_are_not_split(spark):
    got = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", text.tokens(F.col("w")).alias("t")).collect()
    assert {r.w: r.t for r in got} == {w: text.query_tokens(w) for w in WORDS}


def test_a_term_of_many_postings_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FILE", 2)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("often").alias("text"))
    index = postings.read(spark, postings.write(postings.build(df, "doc_id"), str(tmp_path)))
    files = index["postings"].groupBy(F.input_file_name()).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 400
    assert [r.id for r in postings.top(index, "often", 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
