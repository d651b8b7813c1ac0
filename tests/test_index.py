import os
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answering, blame, embedding, graph, names, ranking
from lodestone.sources import files

FILES = "file_path string, language string, text string, sha1 string"


def sources(spark, texts):
    rows = [(path, "python", text) for path, text in texts.items()]
    return spark.createDataFrame(rows, "file_path string, language string, text string").withColumn("sha1", F.sha1("text"))


def seen(index):
    return {name: sorted(map(str, table.drop("calls", "imports", "text").collect())) for name, table in index.items()}


def versions(path, name):
    return {v: sorted(b for b in os.listdir(f"{path}/{name}/{v}") if b.startswith("bucket=")) for v in os.listdir(f"{path}/{name}") if v.startswith("version=")}


def test_update_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = {f"p{k}/m{k}.py": f"import os\n\ndef f{k}():\n    g{k}()\n" for k in range(300)}
    first = files.write_buckets(files.build(sources(spark, texts)), path)
    assert seen(files.read_buckets(spark, path)) == seen(files.build(sources(spark, texts)))
    changed = texts | {"p7/m7.py": "import sys\n\ndef new():\n    h()\n"}
    second = files.update_buckets(spark, path, sources(spark, changed))
    for name in files.TABLES:
        new = {v: b for v, b in versions(path, name).items() if v == f"version={second}"}
        assert [len(b) for b in new.values()] == [1], name
    assert seen(files.read_buckets(spark, path)) == seen(files.build(sources(spark, changed)))
    assert seen(files.read_buckets(spark, path, first)) == seen(files.build(sources(spark, texts)))
    assert files.update_buckets(spark, path, sources(spark, changed)) == second
    left = {p: t for p, t in changed.items() if p != "p9/m9.py"} | {"q.py": "def q():\n    pass\n"}
    files.update_buckets(spark, path, sources(spark, left))
    assert seen(files.read_buckets(spark, path)) == seen(files.build(sources(spark, left)))


def test_readers_open_the_buckets_of_a_snapshot_only(spark, tmp_path):
    path = str(tmp_path / "index")
    files.write_buckets(files.build(sources(spark, {f"m{k}.py": "x = 1\n" for k in range(20)})), path)
    plan = files.read_buckets(spark, path, buckets=[3, 4])["chunks"]._jdf.queryExecution().executedPlan().toString()
    assert "version" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_write_that_fails_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = {f"m{k}.py": f"def f{k}():\n    pass\n" for k in range(10)}
    files.write_buckets(files.build(sources(spark, texts)), path)
    files._put(files.build(sources(spark, {"m1.py": "def other():\n    pass\n"})), path, 5)  # and no manifest
    assert seen(files.read_buckets(spark, path)) == seen(files.build(sources(spark, texts)))


def test_run_totals(spark):
    rows = [(k, (k * 37) % 100, k % 7, None if k % 11 == 0 else k % 5) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, at long, a long, b long").repartition(7)
    got = {r.id: r for r in blame.run_totals(df, ["at", "id"], ["a", "b"], {"a": 700, "b": 10**9}).collect()}
    a = b = 0
    crossed = []
    for k, _, x, y in sorted(rows, key=lambda r: (r[1], r[0])):
        a, b = a + x, b + (y or 0)
        assert (got[k].total_a, got[k].total_b) == (a, b)
        crossed += [k] if a > 700 and a - x <= 700 else []
    assert [k for k, r in got.items() if r.crossed_a] == crossed and not any(r.crossed_b for r in got.values())
    assert blame.run_totals(df.limit(0), ["at"], ["a"]).count() == 0


def test_late_interaction_changes_the_order(spark):
    docs = spark.createDataFrame([(1, "parse parse parse unrelated words"), (2, "parser parsing files"), (3, ""), (4, None), (5, "parse a file now")], "id long, text string")
    hits = docs.select("id", F.lit(1.0).alias("raw_score"))
    got = {r.id: r.raw_score for r in embedding.late_interaction(docs, "parse file", "id")(hits).collect()}
    assert got[3] == got[4] == 0 and abs(got[5] - 2) < 1e-9 and got[5] > got[2] > got[1] - 1e-9
    plain = [r.id for r in ranking.retrieve(docs, "parse file", None, "id", 3, "bm25").orderBy("rank").collect()]
    late = [r.id for r in ranking.retrieve(docs, "parse file", None, "id", 3, "bm25", embedding.late_interaction(docs, "parse file", "id")).orderBy("rank").collect()]
    assert late == [5, 2, 1] and plain != late


@pytest.mark.parametrize("part", ["tion", "TION%s", "t_on", "ab", "%", "no such", "a\\b", "xyz%zyx"])
def test_indexed_grep_equals_grep(spark, tmp_path, part):
    rows = [(k, n) for k, n in enumerate(["Action", "actions", "ration_s", "nothing", "ab", "", "tiOn", "xyzzyx", "a\\bc", "täion", "TIONATIONS", None])]
    df = spark.createDataFrame(rows, "chunk_id long, name string")
    path = names.write(df, "chunk_id", str(tmp_path / "grams"))
    assert names.grep(spark, path, df, part, "chunk_id").collect() == graph.grep_symbol(df, part, "chunk_id").collect()


def counting(folder, fails=None):
    """A provider that leaves a mark for each call; it fails once after so many calls."""

    def provider(prompts):
        for p in prompts:
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{p} {threading.get_ident()}\n")
            if fails and not os.path.exists(f"{folder}/failed") and len(open(f"{folder}/calls").readlines()) > fails:
                open(f"{folder}/failed", "w").close()
                raise RuntimeError("the provider is away")
        return [f"re: {p}" for p in prompts]

    return provider


def test_prompts_are_paid_for_once(spark, tmp_path):
    rows = [(k, f"prompt {k % 30}") for k in range(100)] + [(100, None)]
    prompts = spark.createDataFrame(rows, "n long, prompt string").repartition(3)
    budget, store = answering.Budget(limit=40), str(tmp_path / "replies")
    replies = {r.n: r.reply for r in answering.ask_once(prompts, counting(tmp_path), budget, store).collect()}
    assert replies == {k: p and f"re: {p}" for k, p in rows} and budget.calls == 30
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == 30 and len({c.split()[-1] for c in calls}) > 1
    more = spark.createDataFrame([(1, "prompt 5"), (2, "prompt 99")], "n long, prompt string")
    assert {r.reply for r in answering.ask_once(more, counting(tmp_path), budget, store).collect()} == {"re: prompt 5", "re: prompt 99"} and budget.calls == 31
    with pytest.raises(answering.BudgetExceeded):
        answering.ask_once(spark.range(20).select(F.concat(F.lit("q"), "id").alias("prompt")), counting(tmp_path), budget, store)


def test_a_failed_job_is_taken_up_where_it_stopped(spark, tmp_path):
    prompts = spark.createDataFrame([(f"prompt {k}",) for k in range(60)], "prompt string")
    store = str(tmp_path / "replies")
    with pytest.raises(Exception, match="away"):
        answering.ask_once(prompts, counting(tmp_path, 30), answering.Budget(), store, round_=6)
    done = spark.read.parquet(store).count()
    assert {r.reply for r in answering.ask_once(prompts, counting(tmp_path, 30), answering.Budget(), store, round_=6).collect()} == {f"re: prompt {k}" for k in range(60)}
    calls = [c.rsplit(" ", 1)[0] for c in (tmp_path / "calls").read_text().splitlines()]
    assert done > 0 and len(calls) <= 60 + 20 and spark.read.parquet(store).count() == 60
