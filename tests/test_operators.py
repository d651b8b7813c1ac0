import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, diff, graph, ranking
from lodestone.sources import files
from lodestone.streaming import ingest


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_tokens(spark):
    for text in ("plain", "snake_case_name", "CamelCase2x", "HTTPServer a.b_c", "x é été _private __", ""):
        assert one(spark, T.tokens, text) == T.query_tokens(text)
    assert T.query_tokens("plain") == ["plain"] * 3
    assert T.query_tokens("HTTPServer") == ["httpserver", "httpserver", "httpserver"]


def test_bm25_by_hand(spark):
    docs = [(1, "user login and user name"), (2, "login page"), (3, "nothing here"), (4, None)]
    q = "user login user"
    toks = {i: T.query_tokens(t or "") for i, t in docs}
    avg = sum(map(len, toks.values())) / len(docs)
    want = {}
    for i, t in toks.items():
        tf, s = Counter(t), 0.0
        for term in T.query_tokens(q):
            n = sum(term in x for x in toks.values())
            if tf[term]:
                s += math.log((4 - n + 0.5) / (n + 0.5) + 1) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(t) / max(avg, 1)))
        want[i] = s
    df = spark.createDataFrame(docs, "id long, text string")
    got = {r.id: r.score for r in ranking.bm25(df, q, "id").collect()}
    assert got == pytest.approx(want)
    assert ranking.bm25(df.limit(0), q, "id").count() == 0
    assert {r.score for r in ranking.bm25(df, "", "id").collect()} == {0.0}
    with pytest.raises(ValueError):
        ranking.retrieve(df, q, None, "id", mode="other")


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    b = spark.createDataFrame([(3, 1), (4, 2)], "id long, rank int")
    x = {r.id: r.score for r in ranking.rrf(a, b, "id").collect()}
    assert x == {r.id: r.score for r in ranking.rrf(b, a, "id").collect()}
    assert x[3] == pytest.approx(1 / 63 + 1 / 61)


def test_python_chunks(spark):
    source = '"""doc"""\nimport os\nfrom ..up import x\n\n@deco\ndef f(a):\n    return os.path.join(g(a))\n\nclass C:\n    def m(self):\n        return f(1)\n\n    async def n(self):\n        pass\n'
    df = spark.createDataFrame([("pkg/sub/a.py", source), ("b.py", "def broken(:\n"), ("c.py", "x = 1")], "file_path string, text string")
    got = {(r.file_path, r.symbol_name): r for r in chunking.python_chunks(df).collect()}
    assert set(got) == {("pkg/sub/a.py", n) for n in ("f", "C", "C.m", "C.n", "<module>")} | {("b.py", "<file>"), ("c.py", "<module>")}
    f = got["pkg/sub/a.py", "f"]
    assert (f.start_line, f.end_line, f.calls, f.symbol_kind) == (6, 7, ["g", "join"], "function")
    assert f.imports == ["os", "pkg.up.x"] and "@deco" in got["pkg/sub/a.py", "<module>"].text
    assert got["pkg/sub/a.py", "C"].calls == ["f"] == got["pkg/sub/a.py", "C.m"].calls


SOURCES = {
    "javascript": ("import a from 'lib';\nexport async function go(x) {\n  if (x) { run(x); }\n}\nclass K {\n  m() {}\n}\nconst h = (y) => {\n  z(y);\n};\nlet tail = 1;", {"go": ("function", 2, 4), "K": ("class", 5, 7), "h": ("function", 8, 10)}, ["lib"]),
    "go": ('package p\nimport (\n  "fmt"\n)\nfunc (s *S) Do(x int) {\n  fmt.Println(x)\n}\ntype S struct {\n  a int\n}', {"Do": ("function", 5, 7), "S": ("type", 8, 10)}, ["fmt"]),
    "rust": ("use std::io;\npub fn run(x: i32) -> i32 {\n  x\n}\nstruct P {\n}\nimpl P {\n}", {"run": ("function", 2, 4), "P": ("type", 5, 6)}, ["std::io"]),
    "csharp": ("using System;\nnamespace N {\n  public class A {\n    public int Go(int x) { return Do(x); }\n  }\n}", {"N": ("namespace", 2, 6), "A": ("class", 3, 5), "Go": ("method", 4, 4)}, ["System"]),
    "cpp": ('#include "a/b.h"\nclass W {\n};\nint W::go(int x)\n{\n  return f(x);\n}', {"W": ("class", 2, 3), "W::go": ("function", 4, 7)}, ["a/b.h"]),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_brace_chunks(spark, language):
    text, want, imports = SOURCES[language]
    rows = chunking.brace_chunks(spark.createDataFrame([("f", text)], "file_path string, text string"), language).orderBy("start_line").collect()
    got = {}
    for r in rows:
        got.setdefault(r.symbol_name, (r.symbol_kind, r.start_line, r.end_line))
        assert r.imports == imports
    assert {k: got.get(k) for k in want} == want
    if language == "javascript":
        assert next(r for r in rows if r.symbol_name == "<module>").text == "import a from 'lib';\nlet tail = 1;"
        assert next(r for r in rows if r.symbol_name == "go").calls == ["go", "if", "run"]


GIT = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -8,3 +10,5 @@ def f():
 keep
-gone
+new one
+new two
 keep
diff --git a/old.py b/old.py
--- a/old.py
+++ /dev/null
@@ -1,1 +0,0 @@
-x
==== src/b.py#7 (text) ====
@@ -1,2 +1,3 @@
+first
"""


def test_diff(spark):
    lines = diff.lines_of(spark.createDataFrame([(1, GIT)], "diff_id long, text string"))
    added = diff.added_lines(lines)
    assert sorted((r.file_path, r.line_no) for r in added.collect()) == [("src/a.py", 12), ("src/a.py", 13), ("src/b.py", 2)]
    assert sorted(r.line_no for r in diff.added_lines(lines, strict_lines=True).collect()) == [1, 11, 12]
    symbols = spark.createDataFrame([("src/a.py", "C.f", "method", 5, 12), ("src/a.py", "g", "function", 20, 30), ("src/b.py", "h", "function", 1, 9)], "file_path string, name string, kind string, start_line int, end_line int")
    changed = diff.changed_symbols(symbols, added)
    assert sorted(r.name for r in changed.collect()) == ["C.f", "h"]
    calls = spark.createDataFrame([("x.py", "k", "h"), ("x.py", "k2", "f")], "file_path string, caller string, callee string")
    assert [r.caller for r in diff.callers(changed, calls).collect()] == ["k"]
    assert sorted(r.caller for r in diff.callers(changed, calls, leaf_match=True).collect()) == ["k", "k2"]


def test_long_diffs_are_counted_in_blocks(spark, monkeypatch):
    want = sorted(map(tuple, diff.added_lines(diff.lines_of(spark.createDataFrame([(1, GIT), (2, GIT)], "diff_id long, text string"))).collect()))
    monkeypatch.setattr(diff, "BLOCK", 3)
    assert sorted(map(tuple, diff.added_lines(diff.lines_of(spark.createDataFrame([(1, GIT), (2, GIT)], "diff_id long, text string"))).collect())) == want


def test_impact(spark):
    from lodestone.operators import answering

    lines = diff.lines_of(spark.createDataFrame([(1, GIT)], "diff_id long, text string"))
    symbols = spark.createDataFrame([("src/a.py", "f", "function", 5, 12), ("src/a.py", "g", "function", 20, 3000), ("src/b.py", "h", "function", 1, 9)], "file_path string, name string, kind string, start_line int, end_line int")
    calls = spark.createDataFrame([(f"x{i:03}.py", "k", "h") for i in range(70)] + [("x001.py", "k", "h")], "file_path string, caller string, callee string")
    got = {r.name: r for r in diff.impact(symbols, lines, calls).collect()}
    assert set(got) == {"f", "h"}
    assert (got["f"].n_callers, got["f"].callers, got["f"].body) == (0, [], " keep\n-gone\n+new one\n+new two\n keep")
    assert got["h"].n_callers == 70 and got["h"].callers == [f"x{i:03}.py::k" for i in range(30)]
    prompts = answering.impact_prompts(diff.impact(symbols, lines, calls))
    report = answering.impact_report(answering.ask(prompts, lambda ps: [f" seen {p.count('::')} " for p in ps], answering.Budget()))
    assert report == "src/a.py: function f, callers: 0\nseen 0\n\nsrc/b.py: function h, callers: 70\nseen 30"
    assert answering.impact_report(prompts.limit(0).withColumn("reply", F.lit(""))) == "The diff touches no symbol of the index."
    paths = spark.createDataFrame([("src/b.py", "lib/b.py"), ("other", "x")], "depot string, local string")
    moved = diff.added_lines(diff.rewrite_paths(lines, paths)).collect()
    assert {r.file_path for r in moved} == {"src/a.py", "lib/b.py"}


FORMS = {
    "javascript": [("export default async function* gen(x) {", "function", "gen"), ("  export abstract class Öl {", "class", "Öl"), ("const f: Fn = async (x) => {", "function", "f"), ("let g = function(y) {", "function", "g"), ("export type T = string;", "type", "T"), ("interface I {", "type", "I"), ("var n = 3;", None, None), ("type = 3", None, None), ("return class_name(x)", None, None), ("constant(x)", None, None)],
    "go": [("func (s *Set[K]) Add(k K) {", "function", "Add"), ("func Map[T any](x T) {", "function", "Map"), ("type Pair[K any] struct {", "type", "Pair"), ("type R interface {", "type", "R"), ("type N int", None, None), ("functional(x)", None, None)],
    "rust": [("pub(crate) async unsafe fn go<T>(x: T) {", "function", "go"), ("extern \"C\" fn c(x: i32) {", "function", "c"), ("pub enum E {", "type", "E"), ("unsafe impl<T: A<B>, U> Send for S {", "impl", "Send"), ("impl S {", "impl", "S"), ("implement(x)", None, None), ("let fn_name = 3;", None, None)],
    "csharp": [("public sealed partial class A<T> : B {", "class", "A"), ("internal record struct P(int X);", "record", "P"), ("namespace A.B.C;", "namespace", "A.B.C"), ("public static Dictionary<string, int> Go(int x) {", "method", "Go"), ("protected override async Task<List<int>> Run<T>(T x)", "method", "Run"), ("private A(int x) : base(x) {", "constructor", "A"), ("var x = new Foo(1);", None, None), ("public int N = Make(3);", None, None), ("return Go(3);", None, None)],
    "cpp": [("template <typename T> class V {", "class", "V"), ("struct S final : B {", "class", "S"), ("class F;", None, None), ("inline namespace a::b {", "namespace", "a::b"), ("enum class E : int {", "enum", "E"), ("std::vector<int> W::all(int x) const {", "function", "W::all"), ("foo(x);", None, None)],
}


@pytest.mark.parametrize("language", sorted(FORMS))
def test_declarations(spark, language):
    rows = spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(FORMS[language])], "i int, line string")
    got = [r.s for r in rows.orderBy("i").select(chunking._symbol(language).alias("s")).collect()]
    assert [(s.kind, s.name) if s else (None, None) for s in got] == [(k, n) for _, k, n in FORMS[language]]


def test_package_context(spark):
    """Absolute paths: folders count from the topmost that holds an __init__.py without a gap below; relative ones: all folders."""
    paths = ["/r/app/__init__.py", "/r/app/ui/__init__.py", "/r/app/ui/w.py", "/r/app/gap/deep/__init__.py", "/r/app/gap/deep/x.py", "/r/alone.py", "pkg/sub/y.py", "top.py"]
    df = spark.createDataFrame([(p, "from ..core import x\nfrom . import y\ndef f():\n    pass") for p in paths], "file_path string, text string")
    assert {r.file_path: list(r.package) for r in chunking.packages(df).collect()} == {"/r/app/__init__.py": ["app"], "/r/app/ui/__init__.py": ["app", "ui"], "/r/app/ui/w.py": ["app", "ui"], "/r/app/gap/deep/__init__.py": ["deep"], "/r/app/gap/deep/x.py": ["deep"], "/r/alone.py": [], "pkg/sub/y.py": ["pkg", "sub"], "top.py": []}
    got = {r.file_path: r.imports for r in chunking.python_chunks(df).collect()}
    assert got["/r/app/ui/w.py"] == ["app.core.x", "app.ui.y"] and got["pkg/sub/y.py"] == ["pkg.core.x", "pkg.sub.y"] and len(got) == len(paths)


def test_imports_by_language(spark):
    said = {"javascript": ("import a, {b} from \"x/y\";\nexport * from './z';\nimport 'side';\nconst c = require('r');\nlet d = await import(`dyn`);", ["./z", "dyn", "r", "side", "x/y"]), "go": ('import f "fmt"\nimport (\n\t"a/b"\n)\nx := []string{"no", "none"}', ["a/b", "fmt"]), "rust": ("pub use a::b::{c, d};\n use ::std::io;", ["a::b", "std::io"]), "csharp": ("global using static A.B;\nusing X = C.D;", ["A.B", "C.D"]), "cpp": ('#include <vector>\n  # include "../a/b.hpp"', ["../a/b.hpp", "vector"])}
    files_ = spark.createDataFrame([(lang, lang, text + "\nend") for lang, (text, _) in said.items()], "file_path string, language string, text string")
    got = {r.file_path: r.imports for r in chunking.brace_chunks(files_).collect()}
    assert got == {lang: want for lang, (_, want) in said.items()}


def test_spans(spark):
    from lodestone.operators import spans

    ranges = [("a", i, s, e) for i, (s, e) in enumerate([(1, 1), (200, 1200), (255, 256), (256, 256), (5, 4), (700, 5000)])] + [("b", 9, 1, 9), ("b", 10, None, 3)]
    lines = [("a", n) for n in (1, 2, 255, 256, 257, 1200, 1201, 5000)] + [("c", 1), (None, 1)]
    got = spans.within(spark.createDataFrame(ranges, "file_path string, id int, start_line int, end_line int"), spark.createDataFrame(lines, "file_path string, n int"), "n").collect()
    assert sorted((r.id, r.n) for r in got) == sorted((i, n) for f, i, s, e in ranges for g, n in lines if f == g and s is not None and s <= n <= e)


def test_index(spark, tmp_path):
    """Every table follows a changed file; a snapshot is seen whole or not at all."""
    from lodestone.operators import actions

    def tree(rows):
        return spark.createDataFrame(rows, "file_path string, text string").withColumn("language", T.language_of(F.col("file_path"))).withColumn("sha1", F.sha1("text"))

    path = str(tmp_path)
    first = tree([("a.py", "import os\ndef f():\n    g()\n"), ("b.js", "function h() {\n  f();\n}"), ("c.py", "def old():\n    pass")])
    files.write_index(files.build(first), path)
    index = files.read_index(spark, path)
    assert {(r.name, r.file_path) for r in index["symbols"].collect()} == {("f", "a.py"), ("h", "b.js"), ("old", "c.py")}
    assert [r.module for r in actions.act(index, "imports", file="a.py").collect()] == ["os"]
    second = tree([("a.py", "import re\ndef f2():\n    h()\n"), ("b.js", "function h() {\n  f();\n}")])
    number = files.write_index(files.update(index, second), path)
    index = files.read_index(spark, path)
    assert files.read_index(spark, path, number)["chunks"].count() == index["chunks"].count()
    assert {(r.name, r.file_path) for r in index["symbols"].collect()} == {("f2", "a.py"), ("h", "b.js")}
    assert {tuple(r) for r in index["imports"].collect()} == {("a.py", "re")}
    assert ("a.py", "f2", "h") in {tuple(r) for r in index["calls"].collect()} and not index["calls"].filter("callee = 'g'").count()
    assert [r.caller for r in actions.act(index, "callers", symbol="h").collect()] == ["f2", "h"]
    assert [r.name for r in actions.act(index, "find", name=" h ").collect()] == ["h"] and [r.name for r in actions.act(index, "grep", pattern="F").collect()] == ["f2"]
    assert [r.file_path for r in actions.act(index, "files_importing", module="re").collect()] == ["a.py"]
    assert [(r.text, r.more) for r in actions.act(index, "fetch", file="a.py", symbol="f2").collect()] == [("def f2():\n    h()", 0)]
    assert actions.act(index, "search", query="f2").first().symbol_name == "f2"
    lines = spark.createDataFrame([("a.py", i, f"u{i}", "r", None) for i in range(1, 9)] + [("b.js", 2, "other", "r", None)], "file_path string, line_no int, author string, rev string, ts timestamp")
    assert {(r.what, r.value, r.lines) for r in actions.act(index, "blame", file="a.py", symbol="f2", lines=lines).collect()} == {("author", "u2", 1), ("author", "u3", 1), ("rev", "r", 2), ("all", "", 2)}
    with pytest.raises(ValueError):
        actions.act(index, "run", name="x")
    with pytest.raises(ValueError):
        actions.act(index, "find", name=" ")


def test_cosine_batch(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype("float32")
    rows = [(i, v[i].tolist()) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.filter("id % 20 = 0").withColumnRenamed("id", "q")
    want = {q: sorted(range(300), key=lambda i: (-round(float(v[q].astype(float) @ v[i].astype(float)), 6), i))[:7] for q in range(0, 300, 20)}
    for size in (4096, 70):
        monkeypatch.setattr(ranking, "SLICE", size)
        got = {}
        for r in ranking.cosine_batch(df, asked, "id", "q", 7).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.id)
        assert got == want
    assert ranking.cosine_batch(df.limit(0), asked, "id", "q", 7).count() == 0


def test_modules_and_graph(spark):
    paths = ["app/ui/w.py", "app/__init__.py", "lib/core.py", "inc/Foo.h", "main.py"]
    modules = {"app.ui.w": "app/ui/w.py", "app.ui.w.Klass": "app/ui/w.py", "lib.core.f": "lib/core.py", "inc/Foo.h": "inc/Foo.h", "Foo.h": "inc/Foo.h", "main": "main.py", "numpy.linalg": None}
    f = spark.createDataFrame([(p,) for p in paths], "file_path string")
    got = {r.module: r.file_path for r in graph.resolve_modules(spark.createDataFrame([(m,) for m in modules], "module string"), f).collect()}
    assert got == modules
    imports = spark.createDataFrame([("main.py", m) for m in modules], "file_path string, module string")
    edges = {(r.src, r.dst): r.weight for r in graph.edges(imports, f, external=True).collect()}
    assert edges == {("root", "app"): 2, ("root", "lib"): 1, ("root", "inc"): 2, ("root", "<ext>numpy"): 1}


def test_dot_file(spark, tmp_path):
    chunks = spark.createDataFrame([("a/x.py",), ("a/x.py",), ('b"/y.py',)], "file_path string")
    edges = spark.createDataFrame([("a", 'b"', 3)], "src string, dst string, weight long")
    graph.write_dot(graph.dot_lines(graph.nodes(chunks), edges), str(tmp_path / "g.dot"), "t")
    text = (tmp_path / "g.dot").read_text()
    assert '"a" -> "b\\"" [label="3", weight=3];' in text and '"a" [label="a\\n1 files, 2 chunks", fillcolor="#8282ff"];' in text and text.endswith("}\n")
    graph.write_dot(graph.dot_lines(graph.nodes(chunks.limit(0)), edges.limit(0)), str(tmp_path / "e.dot"), "t")
    assert (tmp_path / "e.dot").read_text().count("\n") == 4
    code = spark.createDataFrame([("a/x.py", ["b.y", "os"]), ("b/y.py", []), ("top.py", ["a.x"])], "file_path string, imports array<string>")
    for depth, want in ((1, {'"a" -> "b"', '"root" -> "a"'}), (None, {'"a/x.py" -> "b/y.py"', '"top.py" -> "a/x.py"'})):
        graph.export(code, str(tmp_path / f"{depth}.dot"), 'the "t"', depth)
        text = (tmp_path / f"{depth}.dot").read_text()
        assert all(w in text for w in want) and text.count("->") == 2 and 'label="the \\"t\\""' in text


def test_tree_and_index(spark, tmp_path):
    root = tmp_path / "repo"
    for path, content in {"src/a.py": b"def f():\r\n    pass\r\n", "src/b.txt": b"no", "node_modules/c.js": b"x", "src/d.GO": b"package d\xff"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    seen = files.read_tree(spark, str(root))
    got = {r.file_path: r for r in seen.collect()}
    assert set(got) == {"src/a.py", "src/d.GO"} and got["src/a.py"].text == "def f():\n    pass\n" and got["src/d.GO"].language == "go"
    assert {f.rsplit("/", 1)[1] for f in seen.inputFiles()} == {"a.py", "d.GO"}  # nothing else is opened
    odd = tmp_path / "o d{d}" / "x[1]"
    odd.mkdir(parents=True)
    (odd / "e.rs").write_text("fn f() {}")
    (odd / "sub.py").mkdir()
    (odd / "sub.py" / "g.py").write_text("x = 1")
    assert {r.file_path for r in files.read_tree(spark, str(tmp_path / "o d{d}")).collect()} == {"x[1]/e.rs", "x[1]/sub.py/g.py"}
    assert files.read_tree(spark, str(odd / "sub.py")).count() == 1
    stored = spark.createDataFrame([("src/a.py", got["src/a.py"].sha1), ("gone.py", "x"), ("src/d.GO", "old")], "file_path string, sha1 string")
    assert {r.file_path: r.action for r in files.delta(stored, seen).collect()} == {"src/a.py": "unchanged", "gone.py": "removed", "src/d.GO": "rebuilt"}
    again = seen.select("file_path", "sha1")
    assert {r.action for r in files.delta(again, again).collect()} == {"unchanged"}
    assert {r.symbol_name for r in chunking.chunk(seen).collect()} == {"f", "<module>"}


def test_streaming(spark, tmp_path):
    rows = [("a.py", "def f():\n    pass"), ("b.js", "function g() {\n}"), ("c.txt", "x")]
    spark.createDataFrame(rows, "file_path string, text string").write.parquet(str(tmp_path / "in"))
    q = ingest.stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    index = str(tmp_path / "index")
    assert {r.symbol_name for r in ingest.current(spark, index).collect()} == {"f", "g"}
    spark.createDataFrame([("a.py", "def z():\n    pass", 1), ("a.py", "def h():\n    pass", 2), ("b.js", " ", 1)], ingest.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.stream_chunks(spark, str(tmp_path / "in"), index, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.file_path, r.symbol_name) for r in ingest.current(spark, index).collect()] == [("a.py", "h")]


def test_replies(spark):
    fenced = 'text\n```json\n{"action": "find", "name": "x"}\n```\nmore'
    assert one(spark, lambda c: F.get_json_object(T.reply_json(c), "$.name"), fenced) == "x"
    assert one(spark, T.reply_json, "no json") is None
    for reply, want in {'{"severity": "ok"}': "ok", '{"severity": "huge"}': "minor", "factually off": "major", "fine": "minor", fenced: "minor"}.items():
        assert one(spark, T.severity, reply) == want
    assert one(spark, T.is_relevant, "  NOT_RELEVANT x") is False and one(spark, T.is_relevant, "") is True


PORCELAIN = """{a} 1 1 2
author Ann
author-time 1700000000
summary first
\tx = 1
{b} 2 2 1
author-mail <bob@x>
author-time bad
\ty = 2
{a} 3 3
\tz = 3""".format(a="a" * 40, b="b" * 40)


def test_blame_formats(spark):
    from lodestone.operators import blame

    def lines(text):
        return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file_path string, pos int, line string")

    got = {r.line_no: (r.rev[0], r.author, r.summary, r.ts is None) for r in blame.parse_porcelain(lines(PORCELAIN)).collect()}
    assert got == {1: ("a", "Ann", "first", False), 2: ("b", "bob@x", "", True), 3: ("a", "Ann", "first", False)}
    annotate = "//depot/f#3 - edit\n12: a\n14: b\nnoise\n12: c"
    assert [(r.line_no, r.rev) for r in blame.parse_annotate(lines(annotate), 2, 3).collect()] == [(2, "14"), (3, "12")]
    tagged = "... change 12\n... user ann\n... time 1700000000\n... desc first line\nsecond\n... change 14\n... user bob\n... time x"
    assert sorted((r.rev, r.author, r.summary) for r in blame.parse_changes(lines(tagged)).collect()) == [("12", "ann", "first line"), ("14", "bob", None)]


def test_answering(spark):
    from lodestone.operators import answering

    hits = spark.createDataFrame([("b.py", "python", "function", "g", 5, 6, 0.5, 2, "g()"), ("b.py", "python", "function", "f", 1, 2, 1.0, 1, "f()"), ("c.py", "python", "class", "K", 1, 9, 0.3, 3, "K")], "file_path string, language string, symbol_kind string, symbol_name string, start_line int, end_line int, score double, rank int, text string")
    prompts = answering.file_prompts(hits, "what?")
    text = {r.file_path: r.prompt for r in prompts.collect()}
    assert text["b.py"].index("[1] function f, lines 1 to 2, relevance 1.000") < text["b.py"].index("[2] function g")
    alone = {r.symbol_name: r.prompt for r in answering.chunk_prompts(hits, "what?").collect()}
    assert len(alone) == 3 and alone["K"].startswith("what?\n\nFrom c.py, python:\n[3] class K, lines 1 to 9, relevance 0.300\nK\n")
    budget = answering.Budget(limit=4)
    replies = answering.ask(prompts, lambda ps: ["NOT_RELEVANT" if "c.py" in p else "sums" for p in ps], budget)
    groups = ranking.group_by_file(hits).join(replies.select("file_path", "reply"), "file_path")
    assert "b.py: f, g, relevance 1.000\nsums" in answering.answer(groups, "what?", lambda ps: ps, budget)
    assert budget.calls == 3
    with pytest.raises(answering.BudgetExceeded):
        answering.ask(prompts, lambda ps: ps, budget)
    found = ranking.retrieve(hits.withColumn("id", F.col("rank").cast("long")), "f g", None, "id", mode="bm25")
    chunks = hits.drop("rank", "score").withColumn("id", F.when(F.col("symbol_name") == "f", 1).when(F.col("symbol_name") == "g", 2).otherwise(3).cast("long"))
    asked = answering.Budget()
    assert answering.one_shot(chunks, found, "id", "what?", lambda ps: ["NOT_RELEVANT" if "c.py" in p else f"<{p[:5]}>" for p in ps], asked) == "<what?>" and asked.calls == 3
    assert answering.one_shot(chunks, found, "id", "what?", lambda ps: ["NOT_RELEVANT"] * len(ps), answering.Budget()) == answering.NOTHING
    spent = answering.Budget(token_limit=10, token_warning=5)
    with pytest.warns(UserWarning, match="6 tokens"):
        spent.record(6)
    spent.record(6)
    with pytest.raises(answering.BudgetExceeded):
        spent.reserve(1)
    said = iter(['{"severity": "minor"}', "better", '{"severity": "ok"}'])
    assert answering.reviewed("draft", "q", lambda ps: [next(said)], answering.Budget(), spark, rounds=3) == ("better", ["minor", "ok"])


def test_embedding(spark):
    from lodestone.operators import embedding

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, ""), (4, None)], "id long, text string")
    got = {r.id: r.embedding for r in embedding.embed(docs, "id").collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and set(got[3]) == {0.0} == set(got[4])
    assert {r.id: r.embedding for r in embedding.embed_with(docs, "id", lambda: lambda t: [[float(len(x))] for x in t]).collect()}[1] == [10.0]
    step = embedding.rerank_with(docs, "q", "id", lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    found = ranking.retrieve(docs, "alpha", None, "id", mode="bm25", rerank=step).collect()
    assert found[0].id == 1 and found[0].raw_score == 10.0
