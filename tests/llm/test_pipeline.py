from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import toxicity
from tests.llm import test_neardup, test_substrings
from tests.llm.helpers import odd, words

DATA = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
            scores = {r.doc_id: r["__score"] for r in toxicity.score(spark.createDataFrame(before), model).collect()}
            assert {r.doc_id for r in after} == {d for d, s in scores.items() if s < 0.5}
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == [r[0] for r in test_neardup.brute(before, 80) if r[3]]
        if name == "repeated_passages":
            want = {r[0]: r for r in test_substrings.brute([(r.doc_id, r.text) for r in before])}
            text = {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in after} == {d for d, n in text.items() if want[d][2] == 0 or want[d][2] < want[d][1]}
            assert all(len(words(r.text)) == want[r.doc_id][1] - want[r.doc_id][2] and r.n_chars == len(r.text) for r in after if want[r.doc_id][2])
        if name == "source_mix":
            have = {r.doc_id: r for r in before}
            assert after and all(r == have[r.doc_id] for r in after)
        if name == "packing":
            per = defaultdict(list)
            for r in after:
                per[r.sequence_id].append(r)
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and sum(r.piece == 0 for r in after) == len(before)
            assert all(sum(r.length for r in p) <= 2048 and len(p) <= 64 for p in per.values())
            assert all(sum(r.length**2 for r in p) <= 0.75 * 2048**2 or len(p) == 1 for p in per.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_rows(spark, tmp_path):
    """Each stage takes nulls, empty and blank texts, ties, repeated rows, a missing doc_id and an empty table."""
    docs = odd(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    labels = tmp_path / "labels.parquet"
    spark.createDataFrame([(5, 1), (6, 0), (4, None), (None, 1)], "doc_id long, toxic int").write.parquet(str(labels))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, str(tmp_path)).collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "packing":
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        if name == "near_duplicates":
            assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted({(r.doc_id or -1, r.text or "") for r in docs.collect()})
        if name == "repeated_passages":
            assert len(rows) == docs.count()
        if name == "packing":
            assert sum(r.piece == 0 for r in rows) == docs.count()


def test_repeated_rows_stay_once(spark):
    texts = ["a b c d e f g h", "one two three four five six", "a b c d e f g h"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, "quite another text is this"), (None, "x"), (None, "x")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "x"), (-1, "x"), (1, texts[0]), (3, texts[1])]


def test_capacities_bind(spark):
    """Short documents fill a sequence by number, long ones by attention cost, before their tokens do."""
    docs = spark.createDataFrame([(i, "word " * 3) for i in range(300)] + [(1000 + i, "word " * 1800) for i in range(10)], "doc_id long, text string")
    per = defaultdict(list)
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        per[r.sequence_id].append(r)
    sizes = sorted(len(p) for p in per.values() if max(r.length for r in p) < 1000)
    assert sizes and max(sizes) <= 64 and sum(len(p) for p in per.values()) == 310
    assert sum(max(r.length for r in p) > 1700 for p in per.values()) == 10
    assert all(len(p) == 1 for p in per.values() if max(r.length for r in p) ** 2 > 0.75 * 2048**2)
    assert all(sum(r.length for r in p) < 2048 for p in per.values())
