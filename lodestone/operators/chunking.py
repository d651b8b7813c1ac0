"""Files to chunks: symbols by line patterns and brace blocks in Spark SQL, Python sources by their syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import spans
from lodestone.plans.lineage import written

#: Lines of a block in which braces are matched.
BLOCK = 4096

NAME, WORD, PATH = r"(?:[^\W\d]|[$])[\w$]*", r"[^\W\d]\w*", r"[^\W\d][\w.:]*"
SPACES, EMPTY = r"\s+", ""


@dataclass(frozen=True)
class Form:
    """How a line declares a symbol: words that may lead it, one that declares, something between, the name, something after."""

    declares: dict[str, str]  # expressions of declaring words, with the kind that each makes
    leading: tuple[str, ...] = ()
    least: int = 0  # so many leading words at least
    between: str = SPACES
    name: str = WORD
    after: str = EMPTY

    def expressions(self) -> list[tuple[str, str]]:
        """(kind, expression with the name as its group) per kind."""
        lead = rf"(?:(?:{'|'.join(self.leading)})\s+){{{self.least},}}" if self.leading else EMPTY
        kinds = dict.fromkeys(self.declares.values())
        words = {k: "|".join(w for w, kind in self.declares.items() if kind == k) for k in kinds}
        return [(k, rf"^\s*{lead}(?:{words[k]}){self.between}({self.name}){self.after}") for k in kinds]


_EXPORTED = ("export", "default", "declare", "abstract", "async")
_RUST = (r"pub(?:\([^)]*\))?", "async", "unsafe", "const", "default", r"extern(?:\s+\"[^\"]*\")?")
_ACCESS = ("public", "private", "protected", "internal")
_SHARP = (*_ACCESS, "static", "sealed", "abstract", "partial", "readonly", "virtual", "override", "async", "new", "unsafe", "extern")
_TYPE = r"[\w.]+(?:<[^()=]*>)?[\[\]?,]*"
#: By language, the forms of declarations in the order in which they are tried.
FORMS = {
    "javascript": [
        Form({r"function\b\s*[*]?": "function"}, _EXPORTED, between=r"\s*", name=NAME),
        Form({"class": "class"}, _EXPORTED, name=NAME),
        Form({"const|let|var": "function"}, _EXPORTED, name=NAME, after=r"\s*(?::[^=]*)?=\s*(?:async\b\s*)?(?:[(]|function\b)"),
        Form({"type|interface": "type"}, _EXPORTED, name=NAME),
    ],
    "go": [
        Form({r"func\b(?:\s*[(][^()]*[)])?": "function"}, between=r"\s*", after=r"\s*[(\[]"),
        Form({"type": "type"}, after=r"(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
    ],
    "rust": [
        Form({"fn": "function"}, _RUST, after=r"\s*[<(]"),
        Form({"struct|enum|trait|union": "type"}, _RUST),
        Form({r"impl(?:\s*<[^{]*?>(?=\s+[^\W\d]))?": "impl"}, ("unsafe",)),
    ],
    "csharp": [
        Form({w: w for w in ("class", "interface", "struct", "enum")} | {r"record(?:\s+(?:class|struct))?": "record"}, _SHARP),
        Form({"namespace": "namespace"}, name=PATH),
        Form({_TYPE: "method"}, _SHARP, 1, after=r"\s*(?:<[^>]*>)?\s*[(]"),
        Form({EMPTY: "constructor"}, _ACCESS, 1, between=EMPTY, after=r"\s*[(]"),
    ],
    "cpp": [
        Form({r"(?:template\s*<[^>]*>\s*)?(?:class|struct)": "class"}, after=r"\s*(?:final\s*)?(?:[:{]|$)"),
        Form({"namespace": "namespace"}, ("inline",), name=PATH),
        Form({r"enum(?:\s+(?:class|struct))?": "enum"}),
        Form({r"(?:[\w:<>,~*&]+\s+)+[*&]?": "function"}, between=EMPTY, name=r"(?:[^\W\d]|~)[\w:~]*", after=r"\s*[(][^;]*$"),
    ],
}
FORMS["typescript"] = FORMS["javascript"]
#: What each language imports, the name as group: quoted after a word, or a path of names after one.
IMPORTS = {
    "javascript": r"\b(?:from|import|require)\b[\s(]*[\"'`]([^\"'`\n]+)[\"'`]",
    "go": r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+)"\s*$',
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?:::)?(\w+(?:::\w+)*)",
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([^\W\d][\w.]*)\s*;",
    "cpp": r"(?m)^\s*#\s*include[\s<\"]*([^\s<>\"]+)",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
#: A call is a name before an opening bracket, words such as if included.
CALL = rf"(?<![\w$]){NAME}(?=\s*[(])"
CHUNK = "file_path string, symbol_name string, symbol_kind string, language string, start_line int, end_line int, text string, calls array<string>, imports array<string>"


def lines_of(files: DataFrame) -> DataFrame:
    """(file_path, pos, line) of (file_path, text), pos from 1."""
    return files.select("file_path", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("file_path", (F.col("p") + 1).alias("pos"), "line")


def matched(marks: DataFrame) -> DataFrame:
    """marks (file_path, block, pos, i, step, others) with level and next: step is 1 for an opening brace, -1 for a closing one, 0 for what only asks for its level.

    level is how deep an opener's inside is (of a closer that of what it closes, of others that of an inside that would
    begin there); next is an opener's next brace of its level (pos, step), which closes it unless more braces close than
    open. Depths are running sums within a block of lines, plus what the blocks before leave open; a next brace in a
    later block is found by a row for each block and level. So no file is one task, and work grows with the marks.
    """
    here, file = ["file_path", "block"], Window.partitionBy("file_path").orderBy("block")
    place = Window.partitionBy(*here).orderBy("pos", "i")
    marks = written(marks.withColumn("depth", F.sum("step").over(place.rowsBetween(Window.unboundedPreceding, 0))))
    open_ = marks.groupBy(*here).agg(F.sum("step").alias("net")).select(*here, F.coalesce(F.sum("net").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("open"))
    level = F.col("open") + F.col("depth") + F.when(F.col("step") > 0, 0).otherwise(1)
    levelled = marks.join(open_, here).withColumn("level", level).drop("depth", "open")
    braces = levelled.filter("step <> 0")
    brace = F.struct("pos", "i", "step")
    heads = braces.groupBy(*here, "level").agg(F.min(brace).alias("head"))
    heads = heads.select(*here, "level", F.lead("head").over(Window.partitionBy("file_path", "level").orderBy("block")).alias("later"))
    pairs = braces.withColumn("next", F.lead(brace).over(Window.partitionBy(*here, "level").orderBy("pos", "i"))).join(heads, [*here, "level"])
    pairs = pairs.withColumn("next", F.coalesce("next", "later")).drop("later")
    return pairs.unionByName(levelled.filter("step = 0").withColumn("next", F.lit(None).cast(pairs.schema["next"].dataType)))


def block_of(pos: Column) -> Column:
    return F.floor((pos - 1) / BLOCK)


def block_ends(lines: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(file_path, pos, end_line) of every line (pos from 1), or of those asked (file_path, pos) and some more: where the first brace block that opens on it or later closes, else the file's last line. Asked for some, only these and lines with braces are sorted."""
    spot, here = ["file_path", "block", "pos"], ["file_path", "block"]
    lines = lines.select("file_path", block_of(F.col("pos")).alias("block"), "pos", "line")
    signs = F.expr("filter(transform(split(line, ''), (c, i) -> struct(i AS i, CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 END AS step)), x -> x.step IS NOT NULL)")
    braces = lines.filter("line LIKE '%{%' OR line LIKE '%}%'").select(*spot, F.explode(signs).alias("x")).select(*spot, "x.*")
    close = F.when(F.col("next.step") < 0, F.col("next.pos"))
    first = matched(braces).filter("step = 1").groupBy(*spot).agg(F.min_by(F.struct(close.alias("e")), "i").alias("m"))
    if asked is None:
        spots = lines.select(*spot)
    else:
        first = written(first)
        spots = asked.select("file_path", block_of(F.col("pos")).alias("block"), "pos").union(first.select(*spot)).distinct()
    joined = spots.join(first, spot, "left")
    blocks = joined.groupBy(*here).agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("pos"))).alias("m"))  # a row per block
    after = Window.partitionBy("file_path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*here, F.last("m", ignorenulls=True).over(after).alias("after"))
    from_here = Window.partitionBy(*here).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    found = joined.withColumn("m", F.last("m", ignorenulls=True).over(from_here)).join(blocks, here).join(lines.groupBy("file_path").agg(F.max("pos").alias("last")), "file_path")
    return found.select("file_path", "pos", F.coalesce(F.coalesce("m", "after")["e"], F.col("last")).cast("int").alias("end_line"))


def _by_language(values: dict[str, Column], none: Column) -> Column:
    """The value of a row's language."""
    out = none
    for language, value in values.items():
        out = F.when(F.col("language") == language, value).otherwise(out)
    return out


def _symbol(language: str) -> Column:
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, expression in reversed([e for form in FORMS[language] for e in form.expressions()]):
        found = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", f"(?U){expression}", 1).alias("name"))
        out = F.when(F.col("line").rlike(f"(?U){expression}"), found).otherwise(out)
    return out


def brace_chunks(files: DataFrame, language: str | None = None) -> DataFrame:
    """Chunks of (file_path, text, language; or all of one language) in languages of braces: a chunk per symbol up to its block's end, and the remaining lines as <module>.

    All languages go through one pass. Lines meet the symbols they lie in by bins of lines, so a file of very many
    lines is no task of its own. Null texts and unknown languages give nothing.
    """
    if language is not None:
        files = files.withColumn("language", F.lit(language))
    languages = [language] if language else list(FORMS)
    files = files.filter(F.col("language").isin(languages))
    lines = files.select("file_path", "language", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("file_path", "language", (F.col("p") + 1).alias("pos"), "line")
    symbol = _by_language({x: _symbol(x) for x in languages}, F.lit(None).cast("struct<kind:string,name:string>"))
    starts = written(lines.select("file_path", "pos", symbol.alias("s")).filter("s IS NOT NULL"))
    found = starts.join(block_ends(lines.drop("language"), starts), ["file_path", "pos"]).select("file_path", "s.*", F.col("pos").alias("start_line"), "end_line")
    # Lines meet the symbols around them once: those that meet none are the rest of their file.
    around = spans.binned(found).withColumnRenamed("file_path", "__file")
    inside = (F.col("file_path") == F.col("__file")) & (spans.bin_of(F.col("pos")) == F.col("__bin")) & F.col("pos").between(F.col("start_line"), F.col("end_line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    parts = lines.select("file_path", "pos", "line").join(around, inside, "left").groupBy("file_path", "name", "kind", "start_line", "end_line").agg(text.alias("text"))
    lengths = files.groupBy("file_path").agg(F.max(F.size(F.split("text", "\n"))).alias("last"))
    none, is_rest = F.array().cast("array<string>"), F.col("start_line").isNull()
    parts = parts.filter(~is_rest | F.col("text").rlike(r"\S")).join(lengths, "file_path")
    calls = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?U){CALL}"), F.lit(0))))
    filled = {"name": "<module>", "kind": "module", "start_line": 1, "end_line": F.col("last"), "text": F.regexp_replace("text", r"^\s+|\s+$", ""), "calls": none}
    chunks = parts.select("file_path", *[F.when(is_rest, F.lit(v)).otherwise(calls if c == "calls" else F.col(c)).alias(c) for c, v in filled.items()])
    imported = _by_language({x: F.regexp_extract_all("text", F.lit(f"(?U){IMPORTS[x]}"), F.lit(1)) for x in languages}, none)
    imports = files.select("file_path", "language", F.array_sort(F.array_distinct(imported)).alias("imports"))
    return chunks.join(imports, "file_path").select("file_path", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), "language", "start_line", "end_line", "text", "calls", "imports")


class _Names(ast.NodeVisitor):
    """The leaf names of all calls, and all imports as absolute modules."""

    def __init__(self, package: list[str]):
        self.package, self.calls, self.imports = package, set(), set()

    def visit_Call(self, node: ast.Call) -> None:
        leaf = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
        self.calls |= {leaf} if leaf else set()
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        self.imports |= {a.name for a in node.names}

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        up = node.level - 1
        base = self.package[: len(self.package) - up] if 0 <= up <= len(self.package) else []
        module = ".".join([*base, *([node.module] if node.module else [])])
        self.imports |= {f"{module}.{a.name}" if module else a.name for a in node.names}


def packages(files: DataFrame) -> DataFrame:
    """(file_path, package) of files (file_path): of a relative path all its folders; of an absolute one the last folders that, one in the other, hold an __init__.py of the table."""
    folders = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    files = files.select("file_path", folders.alias("folders")).distinct()
    relative = files.filter(~F.col("file_path").startswith("/")).select("file_path", F.col("folders").alias("package"))
    inits = files.filter(F.col("file_path").endswith("/__init__.py")).select(F.array_join("folders", "/").alias("folder"), F.lit(True).alias("has")).distinct()
    levels = files.filter(F.col("file_path").startswith("/")).select("file_path", "folders", F.explode(F.sequence(F.lit(1), F.size("folders"))).alias("level"))
    levels = levels.withColumn("folder", F.array_join(F.slice("folders", F.lit(1), F.col("level")), "/")).join(inits, "folder", "left")
    lacks = levels.groupBy("file_path", "folders").agg(F.max(F.when(F.col("has").isNull(), F.col("level"))).alias("lacks"))
    absolute = lacks.select("file_path", F.slice("folders", F.coalesce("lacks", F.lit(0)) + 1, F.size("folders")).alias("package"))
    return relative.union(absolute)


def python_rows(path: str, text: str, package: list[str] | None = None) -> Iterator[tuple]:
    """Chunk rows of one Python source: functions, classes and their methods, the lines outside as <module>; a source that doesn't parse or holds nothing is one <file>.

    package: what relative imports start from, by default the path's folders.
    """
    lines = text.split("\n")
    whole = (path, "<file>", "module", "python", 1, len(lines), text, [])
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield (*whole, [])
        return
    names = _Names(path.split("/")[:-1] if package is None else package)
    names.visit(tree)
    imports = sorted(names.imports)
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async_function", ast.ClassDef: "class"}
    top = [n for n in tree.body if type(n) in kinds]
    wanted = [(n.name, kinds[type(n)], n) for n in top]
    wanted += [(f"{c.name}.{m.name}", "method", m) for c in top if isinstance(c, ast.ClassDef) for m in c.body if kinds.get(type(m), "class") != "class"]
    for name, kind, node in wanted:
        inner = _Names([])
        inner.visit(node)
        yield (path, name, kind, "python", node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), sorted(inner.calls), imports)
    taken = {i for n in top for i in range(n.lineno, n.end_lineno + 1)}
    rest = "\n".join(x for i, x in enumerate(lines, 1) if i not in taken).strip()
    if rest:
        yield (path, "<module>", "module", "python", 1, len(lines), rest, [], imports)
    elif not wanted:
        yield (*whole, imports)


def python_chunks(files: DataFrame) -> DataFrame:
    """Chunks of Python sources (file_path, text): a parser's work, so it runs in Arrow batches beside the JVM."""
    columns = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["file_path"], batch["text"], batch["package"], strict=True)
            yield pd.DataFrame([row for path, text, package in rows for row in python_rows(path, text, None if package is None else list(package))], columns=columns)

    relative = files.filter(~F.col("file_path").startswith("/")).select("file_path", "text", F.lit(None).cast("array<string>").alias("package"))
    absolute = files.filter(F.col("file_path").startswith("/"))
    placed = absolute.select("file_path", "text").join(packages(absolute), "file_path").select("file_path", "text", "package")
    return relative.union(placed).mapInPandas(run, CHUNK)


def chunk(files: DataFrame) -> DataFrame:
    """Chunks of files (file_path, language, text) of all known languages; blank files and unknown languages give none."""
    files = files.filter(F.col("text").rlike(r"\S"))
    return python_chunks(files.filter("language = 'python'")).unionByName(brace_chunks(files))
