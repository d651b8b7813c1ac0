from pyspark.sql import functions as F

from lodestone.operators import chunking


def test_lines_meet_symbols_once(spark):
    df = spark.createDataFrame([("f", "x\nfunction a() {\n}\ny"), ("g", "plain"), ("h", None), ("k", "function b() { }")], "file_path string, text string")
    chunks = chunking.brace_chunks(df, "javascript")
    got = sorted((r.file_path, r.symbol_name, r.start_line, r.end_line, r.text) for r in chunks.collect())
    assert got == [("f", "<module>", 1, 4, "x\ny"), ("f", "a", 2, 3, "function a() {\n}"), ("g", "<module>", 1, 1, "plain"), ("k", "b", 1, 1, "function b() { }")]
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # before, the rest was a second join of all lines


def test_block_ends_of_some_lines(spark):
    text = "\n".join(["a {", "b", "} c {", "d {", "}", "}", "e", "f {"] * 3)
    lines = chunking.lines_of(spark.createDataFrame([("f", text), ("g", "x\ny")], "file_path string, text string"))
    every = {(r.file_path, r.pos): r.end_line for r in chunking.block_ends(lines).collect()}
    asked = lines.filter(F.col("pos") % 2 == 0).select("file_path", "pos")
    some = {(r.file_path, r.pos): r.end_line for r in chunking.block_ends(lines, asked).collect()}
    assert {k for k in every if k[1] % 2 == 0} <= some.keys() and all(every[k] == v for k, v in some.items())
