import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import diff
from lodestone.plans import catalog

PARTS = ["diff --git a/x b/x", "==== //d/y#3 (text) ====", "==== none", "+++ b/x", "+++ b/z", "+++ /dev/null", "@@ -1,3 +7,3 @@ f", "@@ -1 +20 @@", "@@ -1,3 +-4,3 @@", "@@ -1,3 +4,3 @@x", "+a", "-b", " c", "--- a/x", ""]


def brute(lines):
    """(section, file_path, hunk, line_no, line) of a diff's hunk lines."""
    section, hunk, number, out, paths = 0, 0, None, [], {}
    for line in lines:
        if line.startswith(("diff --git ", "==== ")):
            section, number = section + 1, None
            at = re.match(r"==== ([^ ]*[^#]#[0-9][^ ]*)", line)
            paths.setdefault(section, {})["depot"] = at and at[1].split("#")[0]
        elif line.startswith("+++ b/"):
            paths.setdefault(section, {}).setdefault("git", line[6:])
        begin = re.match(r"@@ -[^ ]* \+([0-9]+)[^ ]* @@( |$)", line)
        if begin:
            hunk, number = hunk + 1, int(begin[1])
        if number is not None:
            out.append((section, hunk, number, line))
            number += 0 if line.startswith("-") and not line.startswith("---") else 1
    path = {s: p.get("git") or p.get("depot") for s, p in paths.items()}
    return sorted((s, path[s], h, n, line) for s, h, n, line in out if path.get(s))


@pytest.mark.parametrize("block", [2, 5, 65_536])
def test_hunks_of_odd_diffs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(diff, "BLOCK", block)
    rnd = random.Random(3)
    diffs = {i: [rnd.choice(PARTS[3:] if i % 3 else PARTS) for _ in range(rnd.randrange(40))] for i in range(40)}
    rows = spark.createDataFrame([(i, "\n".join(d)) for i, d in diffs.items()], "diff_id long, text string")
    got = {}
    for r in diff.hunk_lines(diff.lines_of(rows)).collect():
        got.setdefault(r.diff_id, []).append((r.section, r.file_path, r.hunk, r.line_no, r.line))
    assert {i: sorted(x) for i, x in got.items()} == {i: b for i, d in diffs.items() if (b := brute(d))}
    added = sorted(map(tuple, diff.added_lines(diff.lines_of(rows)).collect()))
    assert added == sorted((i, p, h, n) for i, d in diffs.items() for _, p, h, n, line in brute(d) if line.startswith("+") and not line.startswith("+++"))


def test_items_are_shuffled_once_to_make_and_count_lines(spark, tmp_path):
    spark.range(3000).select((F.col("id") / 3).cast("long").alias("l_orderkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = catalog._diffs(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    assert lines.count() == 1000 * 2 + 3000 * 3
    counted = lines.groupBy("diff_id").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
