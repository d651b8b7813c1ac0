"""The catalog's queries lose no row, word or page."""

import hashlib
import re

from lodestone.operators import chunking
from lodestone.plans import catalog


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_hits_by_file(spark, tmp_path):
    turns = [(c, t, f"r{t}", "x") for c in range(1050) for t in range(2)]
    got = catalog.QUERIES["group_hits_by_file"](spark, write(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert sum(r.n_hits for r in got) == len(turns)
    assert sorted((r.first_rank, r.file_path) for r in got) == [(40 * f + 1, f"conv{f}") for f in range(53)]
    assert next(r.symbols for r in got if r.file_path == "conv52") == ", ".join(["r0", "r1"] * 10)


def test_aggregate_ranks_all_documents(spark, tmp_path):
    docs = [(i, "zzz " * 5, "en", f"src{i % 3}", 20) for i in range(100)] + [(500, "the and that with", "en", "last", 17)]
    vectors = [(i, [1.0, 0.0]) for i in range(5)]
    d = write(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), embeddings=(vectors, "vec_id long, embedding array<float>"))
    assert any("d500" in r.block for r in catalog.QUERIES["prompt_aggregate"](spark, d).collect())


def test_calls_name_every_word(spark, tmp_path):
    turns = [(1, 0, "user", "one two"), (1, 1, "assistant", "alpha beta gamma delta epsilon the last alpha"), (2, 1, "user", None)]
    d = write(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"))
    want = {("conv1", "assistant", w) for w in "alpha beta gamma delta epsilon the last".split()}
    assert {tuple(r) for r in catalog.QUERIES["derive_calls"](spark, d).collect()} == want
    assert [tuple(r) for r in catalog.QUERIES["callers_of"](spark, d).collect()] == [("conv1", "assistant")]


def test_every_page_is_a_file(spark, tmp_path):
    html = ['<a href="/the.one">{', '<a href="/two">}', "three", "three"]
    urls = ["http://a.org/x/1", "http://b.org/x/1", "http://b.org/x/1?page=2", "http://b.org/x/1/#top"]
    d = write(spark, tmp_path, pages=(list(zip(range(4), urls, html)), "page_id long, url string, html string"))
    names = ["a.org/x/1@0.js", "b.org/x/1@1.js", "b.org/x/1@2.js", "b.org/x/1@3.js"]
    got = {name: [tuple(r) for r in catalog.QUERIES[f"{name}"](spark, d).collect()] for name in ("file_sha1", "imports_of", "files_importing", "index_delta", "index_summary", "apply_snapshot", "brace_block_end")}
    assert sorted(got["file_sha1"]) == [(n, hashlib.sha1(h.encode()).hexdigest()) for n, h in zip(names, html)]
    assert sorted(got["imports_of"]) == [(names[0], "the.one"), (names[1], "two")]
    assert got["files_importing"] == [(names[0], "the.one")]
    assert sorted(got["index_delta"]) == [(n, "unchanged") for n in names[1:]]  # page 0 is in neither state
    assert got["index_summary"] == [("unchanged", 3)]
    assert sorted(got["apply_snapshot"]) == sorted(got["file_sha1"])[1:]
    assert {r[0] for r in got["brace_block_end"]} == set(names)


def test_prompts_hold_the_texts(spark, tmp_path):
    docs = [(i, f"zzz {i}", "en", f"src{i % 3}", 20) for i in range(100)] + [(500, "the and\nthat with", "en", "last", 17)]
    d = write(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), embeddings=([(0, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    got = {r.file_path: r for r in catalog.QUERIES["prompt_per_file"](spark, d).collect()}
    assert got["last/en"].first_rank == 2 and "[1] text d500, lines 500 to 502, relevance 0.500\nthe and\nthat with\n" in got["last/en"].prompt
    assert sum(r.prompt.count(", relevance ") for r in got.values()) == 20


DOCS = [(1, "Ä long { text\n\nclass Größe {\n}}}\nfunction é(x) {\nopen(", "de", "s", 9), (10, "x\ty\n", "en", "s", 3), (3, None, "en", "t", 0)]
HTML = [(7, "<p>a;function g(){b;}<i>class K {if(q){;"), (8, "plain"), (9, None)]


def brute_chunks(path, text):
    """Line by line and character by character."""
    lines, taken, out = text.split("\n"), set(), []
    for i, line in enumerate(lines):
        hit = next(((k, m[1]) for k, p in [e for form in chunking.FORMS["javascript"] for e in form.expressions()] if (m := re.search(p, line))), None)
        if hit is None:
            continue
        depth, end = 0, None
        for j in range(i, len(lines)):
            for c in lines[j]:
                if c == "{":
                    depth += 1
                elif c == "}" and depth:
                    depth -= 1
                    if depth == 0 and end is None:
                        end = j
            if end is not None:
                break
        end = len(lines) - 1 if end is None else end
        body = "\n".join(lines[i : end + 1])
        out.append((path, hit[1], hit[0], i + 1, end + 1, body, tuple(sorted(set(re.findall(chunking.CALL, body))))))
        taken |= set(range(i, end + 1))
    rest = "\n".join(x for i, x in enumerate(lines) if i not in taken)
    return out + ([(path, "<module>", "module", 1, len(lines), rest.strip(), ())] if rest.strip() else [])


def test_chunkers_read_whole_texts(spark, tmp_path):
    d = write(spark, tmp_path, documents=(DOCS, "doc_id long, text string, lang string, source string, n_chars long"), pages=(HTML, "page_id long, html string"))
    tail = "import x from '{s}';\nfunction f{i}(a) {{\n  if (a) {{\n    {l}(a);\n  }}\n}}\nclass C{i} {{\n  go() {{ }}\n}}\nconst {l} = 1;"
    files = {f"{s}/{i}.js": f"{t or ''}\n{tail.format(s=s, i=i, l=lang)}" for i, t, lang, s, _ in DOCS}
    files |= {f"pages/{i}.js": (t or "").replace(">", ">\n").replace(";", ";\n") for i, t in HTML}
    got = catalog.QUERIES["line_chunks_regex"](spark, d).collect()
    assert sorted((r.file_path, r.symbol_name, r.symbol_kind, r.start_line, r.end_line, r.text, tuple(r.calls)) for r in got) == sorted(x for f in files.items() for x in brute_chunks(*f))

    got = {(r.file_path, r.symbol_name): r for r in catalog.QUERIES["python_ast_chunks"](spark, d).collect()}
    assert got["s/1.py", "<module>"].text.startswith("# " + DOCS[0][1].replace("\n", "\n# ") + "\nfrom .de import thing")
    assert got["s/1.py", "C1.run"].start_line == 10 and got["s/10.py", "<file>"].text.startswith("# x\ty\n# \nfrom")
    assert got["pages/7.py", "<file>"].text == HTML[0][1] and got["pages/8.py", "<module>"].text == "plain" and got["t/3.py", "g"].symbol_kind == "async_function"
