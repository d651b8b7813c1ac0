import random

from pyspark.sql import functions as F

from lodestone.operators import chunking, structure
from lodestone.plans import lineage

CPP = r"""#include <vector>
namespace outer {
namespace inner { // not a { brace
template <typename T, typename U>
class Container final : public Base<T> {
public:
    Container() = default;
    Container(int n) : size_(n), items_(n) {
    }
    void
    Add(const T& item)
    {
        if (item) { items_.push_back(item); }
        auto s = "} not { \\" one"; char c = '{';
        /* } several
           lines } { */
        for (int i = 0; i < 3; i++) { Log(R"( } )"); }
    }
    template <typename V>
    auto
    Transform(V func) const -> Container<U, V>
    {
        return Container<U, V>{};
    }
    struct Inner { int x; int get() const { return x; } };
private:
    std::vector<T> items_;
};
template <typename T>
T identity(T x) {
    return x;
}
enum class Difficulty { Easy, Hard };
void Player::TakeDamage(int dmg) { hp_ -= dmg; }
} // namespace inner
} // namespace outer
int main() { return 0; }
"""
CS = r"""using System;
namespace MyApp {
    public partial class UserService<T> where T : class {
        private readonly IRepo<T> _repo;
        [Fact]
        public UserService(IRepo<T> repo) {
            _repo = repo;
        }
        public async Task<T?> GetAsync(
            int id,
            CancellationToken ct = default
        ) {
            var v = @"multi ""line
 } string {
";
            return await _repo.FindAsync(id, ct);
        }
        public IEnumerable<T> All() => _repo.GetAll();
        public int Count { get; set; }
    }
    public partial class UserService<T> {
        public void Touch() { /* partial { */ }
    }
    public record User(string Name);
    public interface IUserRepo { void Save(); }
    enum Status { A, B }
}
"""
FILES = "file_path string, language string, text string"


def found(spark, rows):
    return {tuple(r)[2:] for r in structure.declarations(spark.createDataFrame(rows, FILES)).collect()}


def test_cpp(spark):
    assert found(spark, [("a.cpp", "cpp", CPP)]) == {
        ("namespace", "outer", 2, 36), ("namespace", "inner", 3, 35), ("class", "Container", 4, 28), ("method", "Container::Container", 8, 9), ("method", "Container::Add", 10, 18),
        ("method", "Container::Transform", 19, 24), ("struct", "Inner", 25, 25), ("method", "Inner::get", 25, 25), ("function", "identity", 29, 32), ("enum", "Difficulty", 33, 33),
        ("function", "Player::TakeDamage", 34, 34), ("function", "main", 37, 37),
    }


def test_csharp(spark):
    assert found(spark, [("b.cs", "csharp", CS)]) == {
        ("namespace", "MyApp", 2, 27), ("class", "UserService", 3, 20), ("constructor", "UserService", 5, 8), ("method", "GetAsync", 9, 17), ("method", "All", 18, 18), ("class", "UserService", 21, 23),
        ("method", "Touch", 22, 22), ("record", "User", 24, 24), ("interface", "IUserRepo", 25, 25), ("enum", "Status", 26, 26),
    }
    whole = "namespace A.B;\nclass C { struct D { void E() { if (x) { } } } }\nclass F {"
    assert found(spark, [("c.cs", "csharp", whole)]) == {("namespace", "A.B", 1, 3), ("class", "C", 2, 2), ("struct", "D", 2, 2), ("method", "E", 2, 2), ("class", "F", 3, 3)}


def code_of(text):
    """The code of each line, by a lexer that goes from character to character."""
    out, line, state, i = [], "", "code", 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if c == "\n":
            out.append(line)
            line, i = "", i + 1
            state = "code" if state in ("line", "string", "char") else state
        elif state == "code":
            if two == "//":
                state, i = "line", i + 2
            elif two == "/*":
                state, i = "block", i + 2
            elif two == '@"':
                state, i = "verbatim", i + 2
            elif text[i : i + 3] == 'R"(' and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
                state, i = "raw", i + 3
            elif c == '"':
                state, i = "string", i + 1
            elif c == "'":
                state, i = "char", i + 1
            else:
                line, i = line + c, i + 1
        elif state == "block" and two == "*/":
            state, i = "code", i + 2
        elif state == "raw" and two == ')"':
            state, i = "code", i + 2
        elif state == "verbatim" and c == '"':
            state, i = ("verbatim", i + 2) if two == '""' else ("code", i + 1)
        elif state in ("string", "char") and c == "\\" and i + 1 < len(text) and text[i + 1] != "\n":
            i += 2
        elif state == "string" and c == '"' or state == "char" and c == "'":
            state, i = "code", i + 1
        else:
            i += 1
    return [*out, line]


def test_lexer_by_brute_force(spark, monkeypatch):
    """Random lines of delimiters; states cross lines and blocks of lines."""
    pick = random.Random(4)
    parts = ["//", "/*", "*/", '"', "'", '@"', 'R"(', ')"', '""', "\\", "x", " {", "} ", ";", "\n", "\n", "word\n", "\n\n"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 120))) for _ in range(300)]
    files = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file_path string, text string")
    for lexed in (structure.LEXED, 5):
        monkeypatch.setattr(structure, "LEXED", lexed)
        got = {}
        for r in structure.lexed(chunking.lines_of(files)).collect():
            got.setdefault(int(r.file_path), {})[r.pos] = "".join(r.code.split())
        for k, text in enumerate(texts):
            want = ["".join(x.split()) for x in code_of(text)]
            assert [got[k][i + 1] for i in range(len(want))] == want, text


def test_odd_files(spark):
    long = "int f(" + "int a, " * 20000 + "int b) { return \"" + "x" * 100000 + "\"; }"
    rows = [("a", "cpp", None), ("b", "cpp", ""), ("c", "java", "class A {}"), ("d", "cpp", "}}} class A { void f() { }"), ("e", "cpp", long), ("f", "csharp", "prose without any end " * 5000)]
    got = {tuple(r)[:1] + tuple(r)[2:] for r in structure.declarations(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {("d", "class", "A", 1, 1), ("d", "method", "A::f", 1, 1), ("e", "function", "f", 1, 1)}
    assert structure.declarations(spark.createDataFrame([], FILES)).count() == 0


def test_many_lines_of_one_file(spark):
    """Blocks of lines are matched over their edges."""
    n = 3 * chunking.BLOCK
    text = "class A {\n" + "// {\n" * n + "void f() {\n" + "x;\n" * n + "}\n};\n"
    assert found(spark, [("a", "cpp", text)]) == {("class", "A", 1, 2 * n + 4), ("method", "A::f", n + 2, 2 * n + 3)}


def test_statements_are_lexed_once(spark):
    code = spark.createDataFrame([("f", 1, "class A {"), ("f", 2, "}")], "file_path string, pos int, code string")
    found = structure.statements(code)
    assert sorted((r.number, r.mark) for r in found.collect()) == [(0, "{"), (1, "}")]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_and_lines_agree(spark):
    """Random sources: one pass over each text finds what joins of its lines find."""
    pick = random.Random(7)
    heads = ["namespace N {", "namespace N.M;", "class A {", "class A : public B {", "struct S final {", "enum E {", "record R(int a);", "interface I {", "A(int n) {", "int f(int a,\n int b) {", "void A::g() const {", "int H() => 3;", "int h();", "if (x) {", "else {", "template <typename T>\n", "public:", "[Fact] ", "x = 1;"]
    parts = [*heads, "}", "}", "};", "}\n", " ", "\n", "\n", "\n\n", "/*", "*/", "//", '"', "'", "@\"", 'R"(', ')"', '""', "\\", "d'", "\n#define X {", "\n # if /* }", "\r\n", "ü", "{", ";"]
    rows = [(str(k), pick.choice(["cpp", "csharp"]), "".join(pick.choices(heads if k % 3 else parts, k=pick.randint(0, 8)) + pick.choices(parts, k=pick.randint(0, 60)))) for k in range(400)]
    files = spark.createDataFrame(rows, FILES)
    lines = chunking.lines_of(files).join(files.select("file_path", "language"), "file_path")
    got = sorted(map(tuple, structure.declarations(files).collect()))
    assert len(got) > 500
    assert got == sorted(map(tuple, structure.declarations_of_lines(lines).collect()))
    assert got == sorted((path, language, *x) for path, language, text in rows for x in structure.declared(text, language == "csharp"))


def test_texts_are_not_shuffled(spark):
    files = spark.createDataFrame([("a.cpp", "cpp", CPP)], FILES)
    assert "Exchange" not in structure.declarations(files)._jdf.queryExecution().executedPlan().toString()


def test_lines_end_at_newlines_alone(spark):
    text = "// a \r {   {\nclass A {\n/* \r { */ \"\\\r\n};\n"
    want = {("class", "A", 2, 4)}
    assert found(spark, [("a", "cpp", text)]) == want
    lines = spark.createDataFrame([("a", "cpp", i, x) for i, x in enumerate(text.split("\n"), 1)], "file_path string, language string, pos int, line string")
    assert {tuple(r)[2:] for r in structure.declarations_of_lines(lines).collect()} == want
    for language, source in (("cpp", CPP), ("csharp", CS)):
        assert found(spark, [("a", language, source.replace("\n", "\r\n"))]) == found(spark, [("a", language, source)])


def test_a_row_group_is_dealt_out(spark, tmp_path):
    spark.range(1000, numPartitions=1).write.parquet(str(tmp_path / "one"))
    whole = spark.read.parquet(str(tmp_path / "one"))
    assert lineage.dealt(whole, "id").select(F.spark_partition_id()).distinct().count() > 1
    spread = spark.range(1000, numPartitions=2 * spark.sparkContext.defaultParallelism)
    assert lineage.dealt(spread, "id") is spread
    assert lineage.dealt(whole.filter("id < 0"), "id").count() == 0


def test_odd_statements_take_no_longer_than_they_are_long(spark):
    """As one expression in Python each of these has more ways to be tried than can be gone through, or as many as the square of its length."""
    n = 20_000
    for text in ("void f() " + "const " * n + "x {", "A<x>::" * n + "(int a) {", "a <b " * n + "(int a) {", "a <b> " * n + "(int a) y {"):
        assert structure.declared(text, False) == structure.declared(text, True) == []
    rows = [("a", "cpp", "void f() " + "const " * 40 + "x {"), ("b", "cpp", "A<x>::" * 40 + "(int a) {"), ("c", "cpp", "int " + "A<x>::" * 40 + "f(int a) const noexcept override {")]
    lines = spark.createDataFrame([(f, language, 1, x) for f, language, x in rows], "file_path string, language string, pos int, line string")
    want = {("c", "cpp", "function", "A<x>::" * 40 + "f", 1, 1)}
    assert set(map(tuple, structure.declarations_of_lines(lines).collect())) == want
    assert set(map(tuple, structure.declarations(spark.createDataFrame(rows, FILES)).collect())) == want
