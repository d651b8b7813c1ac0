from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import quality, queries
from tests.llm.helpers import SCHEMA, odd, words

DATA = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_figures_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    for r in queries.op10_line_quality(spark, DATA).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_odd_rows(spark):
    docs = odd(spark)
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["__q_n_words"], r["__q_word_chars"], r["__q_n_symbols"], r["__q_n_dup_lines"], r["__q_n_repeat_words"]) == base(r.text)
    assert quality.judge(docs.limit(0)).count() == 0


def test_lines(spark):
    prose = "This is a sentence that stands in an ordinary paragraph and ends well."
    cases = {prose: False, "Home | About | Contact | Help": True, "All rights reserved.": True, "#### $$$$ &&&& %%%%": True, "Menu": True, "A long line without any mark that goes on for more than eight words": False, "Done.": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "l string, want boolean")
    assert {r.l: r.got for r in df.select("l", quality.line_fails(F.col("l")).alias("got")).collect()} == cases
    doc = "\n".join([" ".join(f"w{i}{j}" for j in range(9)) + f" {i}." for i in range(9)] + ["Home | About | Contact | Help", ""])
    out = quality.clean(spark.createDataFrame([(1, doc, "s"), (2, "Home | About | Contact | Help\n" * 30, "s")], SCHEMA)).collect()
    assert [r.doc_id for r in out] == [1] and "Home" not in out[0].text and out[0].text.endswith("8.\n")


def test_native(spark):
    plan = queries.op10_line_quality(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
