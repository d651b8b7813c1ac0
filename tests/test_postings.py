import random

import pytest

from lodestone.operators import postings, ranking

WORDS = "alpha beta gamma delta epsilon zeta eta theta common common common rare_one rareTwo HTTPServer".split()


def documents(n, seed):
    pick = random.Random(seed)
    out = [(k, " ".join(pick.choices(WORDS, k=pick.choice([0, 1, 3, 8, 30, 200])))) for k in range(n)]
    return [*out, (n, None), (n + 1, "unique_token"), (n + 2, "")]


def index_of(spark, rows, tmp_path):
    return postings.read(spark, postings.write(postings.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id"), str(tmp_path / "index")))


def ranked(df, id_col):
    return [(r[id_col], round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["alpha", "common rare", "common common beta", "unique_token alpha", "nothing here", "", "HTTPServer rareTwo eta theta zeta"])
def test_equals_scoring_everything(spark, tmp_path, query):
    rows = documents(600, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = index_of(spark, rows, tmp_path)
    from pyspark.sql import functions as F

    every = ranking.bm25(df, query, "doc_id").withColumn("score", F.round("score", 9))
    for k in (1, 10, 700):
        assert ranked(postings.top(index, query, k), "id") == ranked(every.orderBy(F.desc("score"), "doc_id").limit(k), "doc_id")


def test_reads_its_terms_buckets_and_classes(spark, tmp_path):
    index = index_of(spark, documents(300, 2), tmp_path)
    kept = index["postings"].filter("bucket IN (3) AND term = 'alpha' AND class >= 5")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,alpha)" in plan and "GreaterThanOrEqual(class,5)" in plan


def test_classes_that_can_not_count_are_left_out():
    known = {"often": {c: (1000 * (24 - c), 0.1 * (c + 1)) for c in range(20)}, "rare": {15: (3, 4.0), 20: (2, 5.0)}}
    cuts, left = postings._cuts(known, 4.5)
    assert cuts["often"] > 10 and cuts["rare"] <= 20 and sum(left.values()) < 4.5
    assert postings._cuts(known, 0.0) == ({"often": 0, "rare": 15}, {"often": 0.0, "rare": 0.0})


def test_update_by_delta(spark, tmp_path):
    rows = documents(300, 3)
    old = index_of(spark, rows, tmp_path)
    changed = [(k, f"{t or ''} changed words") for k, t in rows[50:90]] + [(5000, "new alpha common")]
    gone = spark.createDataFrame([(k,) for k, _ in rows[30:90]], "id long")
    fresh = postings.build(spark.createDataFrame(changed, "doc_id long, text string"), "doc_id")
    new = postings.read(spark, postings.write(postings.update(old, gone, fresh), str(tmp_path / "new")))
    whole = index_of(spark, [r for r in rows if not 30 <= rows.index(r) < 90] + changed, tmp_path / "whole")
    assert new["totals"].first() == whole["totals"].first()
    counts = lambda x: sorted(tuple(r) for r in x["heads"].select("term", "class", "n").collect())
    assert counts(new) == counts(whole)
    for query in ("alpha common", "changed rare"):
        assert ranked(postings.top(new, query, 25), "id") == ranked(postings.top(whole, query, 25), "id")


def test_empty(spark, tmp_path):
    index = index_of(spark, [], tmp_path)
    assert postings.top(index, "alpha", 5).count() == 0
