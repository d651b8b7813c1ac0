"""Symbol and import graph: lookups, module resolution by equi-joins, package graph, DOT lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import package_of

def symbols(chunks: DataFrame) -> DataFrame:
    """Chunks that are symbols: names such as <module> are none."""
    return chunks.filter(~F.col("symbol_name").startswith("<"))


def imports(chunks: DataFrame) -> DataFrame:
    """(file_path, module), once each; all chunks of a file share one list."""
    return chunks.select("file_path", F.explode("imports").alias("module")).distinct()


def calls(chunks: DataFrame) -> DataFrame:
    """(file_path, caller, callee), once each."""
    return symbols(chunks).select("file_path", F.col("symbol_name").alias("caller"), F.explode("calls").alias("callee")).distinct()


def find_symbol(symbols_: DataFrame, name: str) -> DataFrame:
    return symbols_.filter(F.col("name") == name)


def grep_symbol(symbols_: DataFrame, part: str, id_col: str, limit: int = 50) -> DataFrame:
    """Names that contain the part, upper and lower case alike; % and _ of the part are wild."""
    pattern = "%" + part.replace("\\", "\\\\") + "%"
    return symbols_.filter(F.col("name").ilike(pattern)).orderBy(id_col).limit(limit)


def get_chunk(chunks: DataFrame, file_path: str, symbol_name: str, id_col: str) -> DataFrame:
    return chunks.filter((F.col("file_path") == file_path) & (F.col("symbol_name") == symbol_name)).orderBy(id_col).limit(1)


def callers_of(calls_: DataFrame, callee: str, limit: int = 200) -> DataFrame:
    return calls_.filter(F.col("callee") == callee).select("file_path", "caller").distinct().orderBy("file_path", "caller").limit(limit)


def imports_of(imports_: DataFrame, file_path: str) -> DataFrame:
    """What one file imports."""
    return imports_.filter(F.col("file_path") == file_path).select("module").distinct().orderBy("module")


def files_importing(imports_: DataFrame, module: str) -> DataFrame:
    """Files that import the module or something below it, once per such import."""
    return imports_.filter((F.col("module") == module) | F.col("module").ilike(f"{module}.%"))


def resolve_modules(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module, file_path) of every module: the file it names; else the file or folder of its longest dotted beginning; else, for header-like names, a file of that base name; else null. The least path of several.

    Modules and files are expanded to their few beginnings and joined by equality, so nothing compares all with all.
    """
    modules, files = modules.select("module").distinct(), files.select("file_path").distinct()
    literal = modules.join(files, F.col("module") == F.col("file_path")).select("module", F.lit(0).alias("way"), F.lit(0).alias("loss"), "file_path")
    parts = F.split("module", "[.]")
    begun = modules.select("module", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    begun = begun.select("module", (F.size(parts) - F.col("n")).alias("loss"), F.array_join(F.slice(parts, 1, F.col("n")), "/").alias("key"))
    steps = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    own = F.when(F.col("file_path").endswith(".py"), F.array(F.regexp_replace("file_path", "[.]py$", ""))).otherwise(F.array().cast("array<string>"))
    keys = files.select("file_path", F.explode(F.array_distinct(F.concat(own, F.when(F.size(steps) > 1, folders).otherwise(F.array().cast("array<string>"))))).alias("key"))
    dotted = begun.join(keys, "key").select("module", F.lit(1).alias("way"), "loss", "file_path")
    headers = modules.filter(F.col("module").contains("/") | F.col("module").rlike("[.](h|hpp|hh|hxx)$")).withColumn("leaf", F.regexp_extract("module", "[^/]*$", 0))
    named = files.withColumn("leaf", F.regexp_extract("file_path", "[^/]*$", 0))
    based = headers.join(named, "leaf").select("module", F.lit(2).alias("way"), F.lit(0).alias("loss"), "file_path")
    found = literal.union(dotted).union(based).groupBy("module").agg(F.min(F.struct("way", "loss", "file_path")).alias("best"))
    return modules.join(found, "module", "left").select("module", F.col("best.file_path").alias("file_path"))


def _node(path: Column, depth: int | None) -> Column:
    """A path's package of so many folders, or the file itself."""
    return path if depth is None else package_of(path, depth)


def nodes(chunks: DataFrame, depth: int | None = 1) -> DataFrame:
    """(node, chunks, files) per package, or per file without a depth."""
    per = chunks.groupBy("file_path").agg(F.count("*").alias("n"))
    return per.groupBy(_node(F.col("file_path"), depth).alias("node")).agg(F.sum("n").alias("chunks"), F.count("*").alias("files"))


def edges(imports_: DataFrame, files: DataFrame, depth: int | None = 1, external: bool = False) -> DataFrame:
    """(src, dst, weight) between packages, without self edges; with external, unresolved modules go to <ext> and their first part."""
    to = resolve_modules(imports_, files)
    dst = _node(F.col("to.file_path"), depth)
    outside = F.concat(F.lit("<ext>"), F.regexp_extract("to.module", "^[^./]*", 0))
    joined = imports_.alias("i").join(to.alias("to"), F.col("i.module") == F.col("to.module"))
    pairs = joined.select(_node(F.col("i.file_path"), depth).alias("src"), F.when(F.col("to.file_path").isNotNull(), dst).when(F.lit(external), outside).alias("dst"))
    return pairs.filter("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def stats(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """One row: how many nodes, and the sum of the edges' weights."""
    return nodes_.agg(F.count("*").alias("nodes")).crossJoin(edges_.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("edges")))


def quoted(id_: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(id_, F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(part, name, line): a DOT statement per node and edge; bluer with more chunks, wider with more imports."""
    most = nodes_.agg(F.max("chunks").alias("__most"))
    share = F.col("chunks") / F.col("__most")
    shade = F.floor(240 - 110 * share).cast("int")
    label = F.format_string("%s\\n%d files, %d chunks", F.replace(F.col("node"), F.lit('"'), F.lit('\\"')), "files", "chunks")
    node = F.format_string('  %s [label="%s", fillcolor="#%02x%02xff"];', quoted(F.col("node")), label, shade, shade)
    edge = F.format_string('  %s -> %s [label="%d", weight=%d];', quoted(F.col("src")), quoted(F.col("dst")), "weight", F.least(F.lit(20), F.col("weight").cast("int")))
    first = nodes_.crossJoin(F.broadcast(most)).select(F.lit(0).alias("part"), F.col("node").alias("name"), node.alias("line"))
    return first.union(edges_.select(F.lit(1), F.concat("src", F.lit("\t"), "dst"), edge))


def write_dot(lines: DataFrame, path: str, title: str) -> None:
    """One ordered text file: the graph's statements, a node per package, so it is as long as the folder list."""
    with open(path, "w") as f:
        f.write(f"digraph modules {{\n  graph [label={_text(title)}];\n  node [style=filled];\n")
        for row in lines.orderBy("part", "name").toLocalIterator():
            f.write(row.line + "\n")
        f.write("}\n")


def _text(title: str) -> str:
    return '"' + title.replace('"', '\\"') + '"'


def export(chunks: DataFrame, path: str, title: str, depth: int | None = 1, external: bool = False) -> None:
    """The import graph of chunks (file_path, imports) as a DOT file: packages of so many folders, or files with None. Without chunks the graph is empty."""
    files = chunks.select("file_path").distinct()
    write_dot(dot_lines(nodes(chunks, depth), edges(imports(chunks), files, depth, external)), path, title)
