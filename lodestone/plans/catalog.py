"""Registered queries over the given tables and the SQL that tells the same.

The tables play the parts of an index: documents are chunks (source is the file, lang the language), pages are source
files (the URL's path is the file, links are imports, name( is a call), embeddings are vectors, conversations are hits
and replies, events are blame lines, lineitem makes diffs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answering, blame, chunking, diff, embedding, graph, latent, names, postings, ranking, structure, vectors
from lodestone.plans.lineage import dealt
from lodestone.sources import files

QUERY = "the and tion that with the"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (read -> DataFrame) under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Views that several queries share, in both languages.
def _files(read) -> DataFrame:
    """Every page as a source file of its own: host, path and page_id tell them apart."""
    path = F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/$", "")
    return read("pages").select(F.concat(path, F.lit("@"), "page_id", F.lit(".js")).alias("file_path"), "page_id", F.col("html").alias("text"))


FILES = """files AS (
  SELECT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') || '@' || page_id || '.js' AS file_path, page_id, html AS text FROM pages
)"""


def _imports(read) -> DataFrame:
    links = F.regexp_extract_all("text", F.lit('href="/([^"]+)"'), F.lit(1))
    return graph.imports(_files(read).select("file_path", links.alias("imports")))


IMPORTS = f"""{FILES}, imports AS (
  SELECT DISTINCT file_path, unnest(regexp_extract_all(text, 'href="/([^"]+)"', 1)) AS module FROM files
)"""


def _symbols(read) -> DataFrame:
    """Documents as symbols of their sources: name from the first word."""
    name = F.regexp_extract("text", r"^\s*(\S+)", 1)
    return read("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_path"), F.when(F.col("doc_id") % 11 == 0, "<module>").otherwise(name).alias("name"), F.col("lang").alias("kind"), (F.col("doc_id") % 997).cast("int").alias("start_line"), (F.col("doc_id") % 997 + F.size(F.split("text", "\n"))).cast("int").alias("end_line"))


SYMBOLS = r"""symbols AS (
  SELECT doc_id AS chunk_id, source AS file_path, CASE WHEN doc_id % 11 = 0 THEN '<module>' ELSE regexp_extract(text, '^\s*(\S+)', 1) END AS name, lang AS kind,
    CAST(doc_id % 997 AS INTEGER) AS start_line, CAST(doc_id % 997 + len(string_split(text, chr(10))) AS INTEGER) AS end_line
  FROM documents
)"""


def _calls(read) -> DataFrame:
    """Conversations as calls: a role calls every word of its text."""
    called = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))
    return read("conversations").select(F.concat(F.lit("conv"), "conv_id").alias("file_path"), F.when(F.col("turn") == 0, "<module>").otherwise(F.col("role")).alias("symbol_name"), called.alias("calls"))


CALLS = """calls AS (
  SELECT DISTINCT file_path, caller, unnest(callees) AS callee FROM (
    SELECT 'conv' || conv_id AS file_path, CASE WHEN turn = 0 THEN '<module>' ELSE role END AS caller, regexp_extract_all(text, '[a-z]{3,}') AS callees FROM conversations
  ) WHERE NOT starts_with(caller, '<')
)"""
TOKENS = """tokens AS (
  SELECT doc_id, flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]+'), lambda w:
    list_concat([lower(w)], list_concat(list_transform(list_filter(string_split(w, '_'), lambda p: p <> ''), lambda p: lower(p)),
    list_transform(regexp_extract_all(w, '[A-Z]+[a-z0-9]*|[a-z0-9]+'), lambda p: lower(p)))))) AS t
  FROM documents
)"""
BM25 = f"""{TOKENS}, q AS (
  SELECT w AS term, CAST(sum(n) AS DOUBLE) AS weight FROM (VALUES ('the', 6), ('and', 3), ('tion', 3), ('that', 3), ('with', 3)) v(w, n) GROUP BY w
), counted AS (
  SELECT doc_id, len(t) AS dl, t FROM tokens
), tf AS (
  SELECT doc_id, dl, term, weight, len(list_filter(t, lambda x: x = term)) AS f FROM counted, q
), df AS (
  SELECT term, count(*) FILTER (WHERE f > 0) AS n_t FROM tf GROUP BY term
), st AS (
  SELECT count(*) AS n, avg(dl) AS avg_dl FROM counted
), bm25 AS (
  SELECT doc_id, sum(CASE WHEN f > 0 THEN weight * ln((n - n_t + 0.5) / (n_t + 0.5) + 1.0) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / greatest(avg_dl, 1.0))) ELSE 0.0 END) AS score
  FROM tf JOIN df USING (term), st GROUP BY doc_id
)"""
COSINE = """qv AS (
  SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)
), cosine AS (
  SELECT vec_id, list_sum(list_transform(list_zip(embedding, qe), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM embeddings, qv
)"""


def _query_vector(read) -> DataFrame:
    return read("embeddings").orderBy("vec_id").limit(1)


def _chunks(read) -> DataFrame:
    """Documents with the vector of their number, where there is one."""
    return read("documents").select("doc_id", "text").join(read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


@query(f"WITH {TOKENS} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tokens) GROUP BY doc_id, term")
def tokenize_terms(read):
    return ranking.terms_of(read("documents"), "doc_id")


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm25")
def bm25_scores(read):
    return ranking.bm25(read("documents"), QUERY, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 20")
def bm25_topk(read):
    scores = ranking.bm25(read("documents"), QUERY, "doc_id").withColumn("score", F.round("score", 9))
    return ranking.top(scores, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(ORACLES["bm25_topk"])
def bm25_postings_topk(read):
    """The same from an inverted index of all documents, written and read by the query's terms."""
    documents = read("documents")
    index = postings.read(documents.sparkSession, postings.write(postings.build(documents, "doc_id")))
    found = postings.top(index, QUERY, 20).withColumn("score", F.round("score", 9)).withColumnRenamed("id", "doc_id")
    return ranking.top(found, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {COSINE} SELECT vec_id, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cosine QUALIFY rank <= 20")
def cosine_topk(read):
    scores = ranking.cosine(read("embeddings"), _query_vector(read), "vec_id").withColumn("score", F.round("score", 9))
    return ranking.top(scores, 20, "vec_id").select("vec_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


RANKED = f"""{BM25}, {COSINE}, rc AS (
  SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM cosine WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY r <= 80
), rb AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm25 QUALIFY r <= 80
), fused AS (
  SELECT doc_id, rc.r AS rc, rb.r AS rb, coalesce(1.0::DOUBLE / (60 + rc.r), 0) + coalesce(1.0::DOUBLE / (60 + rb.r), 0) AS score FROM rc FULL JOIN rb USING (doc_id)
)"""


@query(f"WITH {RANKED} SELECT doc_id, rc AS first_rank, rb AS second_rank, round(score, 6) AS score FROM fused")
def rrf_fuse(read):
    chunks = _chunks(read)
    first = ranking.top(ranking.cosine(chunks, _query_vector(read), "doc_id"), 80, "doc_id")
    second = ranking.top(ranking.bm25(chunks, QUERY, "doc_id"), 80, "doc_id")
    fused = ranking.rrf(first, second, "doc_id")
    return fused.select("doc_id", F.col("first_rank").cast("long").alias("first_rank"), F.col("second_rank").cast("long").alias("second_rank"), F.round("score", 6).alias("score"))


@query(f"WITH {RANKED}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, rc NULLS LAST, rb NULLS LAST) AS rank FROM fused) SELECT doc_id, rank, round(1.0::DOUBLE / rank, 6) AS score, round(score, 6) AS raw_score FROM ranked WHERE rank <= 20")
def retrieve_hybrid(read):
    found = ranking.retrieve(_chunks(read), QUERY, _query_vector(read), "doc_id")
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"))


HITS = f"""{RANKED}, hits AS (
  SELECT doc_id, source, lang, text, rank, 1.0::DOUBLE / rank AS score FROM documents
  JOIN (SELECT doc_id, row_number() OVER (ORDER BY score DESC, rc NULLS LAST, rb NULLS LAST) AS rank FROM fused QUALIFY rank <= 20) USING (doc_id)
)"""


def _hits(read) -> DataFrame:
    """The retrieval's best documents, ranked over all of them."""
    found = ranking.retrieve(_chunks(read), QUERY, _query_vector(read), "doc_id")
    return read("documents").select("doc_id", "source", "lang", "text").join(F.broadcast(found), "doc_id")


@query(f"WITH {BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 20) SELECT doc_id, rank FROM r")
def rerank_identity(read):
    return ranking.retrieve(_chunks(read), QUERY, None, "doc_id", mode="bm25", rerank=lambda hits: hits.select("doc_id", "raw_score")).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH hits AS (SELECT 'conv' || (conv_id // 20) AS file_path, role AS symbol_name, conv_id * 100 + turn AS start_line, row_number() OVER (ORDER BY conv_id, turn) AS rank FROM conversations)
SELECT file_path, min(rank) AS first_rank, round(max(1.0::DOUBLE / rank), 6) AS top_score, count(*) AS n_hits, string_agg(symbol_name, ', ' ORDER BY start_line, symbol_name) AS symbols FROM hits GROUP BY file_path""")
def group_hits_by_file(read):
    """All turns as hits, twenty conversations a file."""
    turns = ranking.numbered(read("conversations").select("conv_id", "turn", "role"), F.floor(F.col("conv_id") / 1000), F.col("conv_id"), F.col("turn"))
    hits = turns.select(F.concat(F.lit("conv"), F.floor(F.col("conv_id") / 20)).alias("file_path"), F.col("role").alias("symbol_name"), (F.col("conv_id") * 100 + F.col("turn")).alias("start_line"), "rank", (1.0 / F.col("rank")).cast("double").alias("score"))
    return ranking.group_by_file(hits).withColumn("top_score", F.round("top_score", 6))


@query(f"WITH {SYMBOLS} SELECT * FROM symbols WHERE name = 'The'")
def find_symbol(read):
    return graph.find_symbol(_symbols(read), "The")


@query(f"WITH {SYMBOLS} SELECT * FROM symbols WHERE name ILIKE '%th%t%' ORDER BY chunk_id LIMIT 50")
def grep_symbol(read):
    return graph.grep_symbol(_symbols(read), "th%t", "chunk_id")


@query(f"WITH {SYMBOLS} SELECT * FROM symbols WHERE NOT starts_with(name, '<')")
def derive_symbols(read):
    return graph.symbols(_symbols(read).withColumnRenamed("name", "symbol_name")).withColumnRenamed("symbol_name", "name")


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'de' ORDER BY doc_id LIMIT 1")
def get_chunk(read):
    chunks = read("documents").select("doc_id", F.col("source").alias("file_path"), F.col("lang").alias("symbol_name"))
    return graph.get_chunk(chunks, "src3", "de", "doc_id").select("doc_id", F.col("file_path").alias("source"), F.col("symbol_name").alias("lang"))


@query(f"WITH {IMPORTS} SELECT file_path, module FROM imports")
def imports_of(read):
    return _imports(read)


@query(f"WITH {IMPORTS} SELECT file_path, module FROM imports WHERE module = 'the' OR module ILIKE 'the.%'")
def files_importing(read):
    return graph.files_importing(_imports(read), "the")


@query(f"WITH {CALLS} SELECT file_path, caller, callee FROM calls")
def derive_calls(read):
    return graph.calls(_calls(read))


@query(f"WITH {CALLS} SELECT DISTINCT file_path, caller FROM calls WHERE callee = 'the' ORDER BY file_path, caller LIMIT 200")
def callers_of(read):
    return graph.callers_of(graph.calls(_calls(read)), "the")


NAMES = "SELECT part.p_partkey, replace(p_name, ' ', '/') || '/x.' || (['py', 'JS', 'tsx', 'go', 'rs', 'cs', 'c++', 'h', 'txt', 'inl'])[p_partkey % 10 + 1] AS path FROM part"


def _paths(read) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, ["py", "JS", "tsx", "go", "rs", "cs", "c++", "h", "txt", "inl"])), (F.col("p_partkey") % 10 + 1).cast("int"))
    return read("part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lit("/x."), ends).alias("path"))


@query(f"""WITH p AS ({NAMES}) SELECT p_partkey, path, CASE lower(regexp_extract(path, '[.]([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go'
  WHEN 'rs' THEN 'rust' WHEN 'cs' THEN 'csharp' WHEN 'c++' THEN 'cpp' WHEN 'h' THEN 'cpp' WHEN 'inl' THEN 'cpp' END AS language FROM p""")
def language_dispatch(read):
    return _paths(read).withColumn("language", T.language_of(F.col("path")))


@query("""WITH p AS (SELECT p_partkey, (['src', 'build', 'build-x', 'node_modules', 'building', '.git', 'lib', 'out', 'cmake-build-y', 'outer'])[p_partkey % 10 + 1] || '/' || p_brand AS path FROM part)
SELECT p_partkey, path FROM p WHERE NOT regexp_matches(path, '(^|/)(build|node_modules|[.]git|out|build[.-][^/]*|cmake-build-[^/]*)(/|$)')""")
def ignore_filter(read):
    heads = F.element_at(F.array(*map(F.lit, ["src", "build", "build-x", "node_modules", "building", ".git", "lib", "out", "cmake-build-y", "outer"])), (F.col("p_partkey") % 10 + 1).cast("int"))
    paths = read("part").select("p_partkey", F.concat(heads, F.lit("/"), "p_brand").alias("path"))
    return paths.filter(~T.is_ignored(F.col("path")))


@query(f"WITH {FILES} SELECT file_path, sha1(text) AS sha1 FROM files")
def file_sha1(read):
    return _files(read).select("file_path", F.sha1("text").alias("sha1"))


DELTA = f"""{FILES}, stored AS (
  SELECT file_path, CASE WHEN page_id % 7 = 0 THEN 'old' ELSE sha1(text) END AS sha1 FROM files WHERE page_id % 5 > 0
), seen AS (
  SELECT file_path, CASE WHEN page_id % 13 = 0 THEN NULL ELSE sha1(text) END AS sha1 FROM files WHERE page_id % 6 > 0
), actions AS (
  SELECT file_path, CASE WHEN n.file_path IS NULL THEN 'removed' WHEN n.sha1 IS NULL THEN 'skipped' WHEN s.sha1 = n.sha1 THEN 'unchanged' ELSE 'rebuilt' END AS action
  FROM stored s FULL JOIN seen n USING (file_path)
)"""


def _delta(read) -> tuple[DataFrame, DataFrame]:
    all_ = _files(read).select("file_path", "page_id", F.sha1("text").alias("sha1"))
    stored = all_.filter("page_id % 5 > 0").withColumn("sha1", F.when(F.col("page_id") % 7 == 0, "old").otherwise(F.col("sha1")))
    seen = all_.filter("page_id % 6 > 0").withColumn("sha1", F.when(F.col("page_id") % 13 > 0, F.col("sha1")))
    return stored, seen


@query(f"WITH {DELTA} SELECT file_path, action FROM actions")
def index_delta(read):
    return files.delta(*_delta(read))


@query(f"WITH {DELTA} SELECT action, count(*) AS n FROM actions GROUP BY action")
def index_summary(read):
    return files.delta(*_delta(read)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {DELTA} SELECT file_path, sha1 FROM stored WHERE file_path NOT IN (SELECT file_path FROM actions WHERE action IN ('rebuilt', 'removed'))
UNION ALL SELECT file_path, sha1 FROM seen WHERE file_path IN (SELECT file_path FROM actions WHERE action = 'rebuilt')""")
def apply_snapshot(read):
    stored, seen = _delta(read)
    actions = files.delta(stored, seen)
    fresh = seen.join(actions.filter("action = 'rebuilt'"), "file_path", "left_semi").select("file_path", "sha1")
    return files.apply(stored.select("file_path", "sha1"), actions, fresh)


RESOLVED = """part_modules AS (
  SELECT p_partkey, replace(p_name, ' ', '.') || CASE p_partkey % 4 WHEN 0 THEN '.thing' WHEN 1 THEN '' WHEN 2 THEN '.h' ELSE '/a.h' END AS module FROM part
), part_files AS (
  SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '/__init__.py' ELSE '/a.h' END AS file_path FROM part WHERE p_partkey % 2 = 0
), modules AS (
  SELECT DISTINCT module FROM part_modules
), files AS (
  SELECT DISTINCT file_path FROM part_files
), begun AS (
  SELECT module, array_to_string(string_split(module, '.')[1:n], '/') AS key, len(string_split(module, '.')) - n AS loss FROM modules, unnest(range(1, len(string_split(module, '.')) + 1)) u(n)
), keys AS (
  SELECT file_path, array_to_string(string_split(file_path, '/')[1:n], '/') AS key FROM files, unnest(range(1, len(string_split(file_path, '/')))) u(n)
  UNION SELECT file_path, regexp_replace(file_path, '[.]py$', '') FROM files WHERE ends_with(file_path, '.py')
), found AS (
  SELECT module, 0 AS way, 0 AS loss, file_path FROM modules JOIN files ON module = file_path
  UNION ALL SELECT module, 1, loss, file_path FROM begun JOIN keys USING (key)
  UNION ALL SELECT module, 2, 0, file_path FROM modules JOIN files ON regexp_extract(module, '[^/]*$') = regexp_extract(file_path, '[^/]*$') WHERE contains(module, '/') OR regexp_matches(module, '[.](h|hpp|hh|hxx)$')
), resolved AS (
  SELECT m.module, min(f.file_path) AS file_path FROM modules m
  LEFT JOIN (SELECT *, rank() OVER (PARTITION BY module ORDER BY way, loss) AS r FROM found) f ON m.module = f.module AND f.r = 1 GROUP BY m.module
)"""


def _modules(read) -> tuple[DataFrame, DataFrame]:
    part = read("part")
    tail = F.element_at(F.array(*map(F.lit, [".thing", "", ".h", "/a.h"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    end = F.element_at(F.array(*map(F.lit, [".py", "/__init__.py", "/a.h"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    modules = part.select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), tail).alias("module"))
    return modules, part.filter("p_partkey % 2 = 0").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), end).alias("file_path"))


@query(f"WITH {RESOLVED} SELECT module, file_path FROM resolved")
def module_resolve(read):
    return graph.resolve_modules(*_modules(read))


GRAPH = f"""{RESOLVED}, imports AS (
  SELECT DISTINCT f.file_path, m.module FROM part_files f, (VALUES (1), (2), (12), (35)) v(step) JOIN part_modules m ON m.p_partkey = f.p_partkey + step
), edges AS (
  SELECT split_part(i.file_path, '/', 1) AS src, CASE WHEN r.file_path IS NULL THEN '<ext>' || regexp_extract(i.module, '^[^./]*') ELSE split_part(r.file_path, '/', 1) END AS dst
  FROM imports i JOIN resolved r USING (module)
), weighed AS (
  SELECT src, dst, count(*) AS weight FROM edges WHERE src <> dst GROUP BY src, dst
), nodes AS (
  SELECT CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE 'root' END AS node, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS files FROM (
    SELECT replace(p_name, ' ', '/') AS file_path, count(*) AS n FROM part GROUP BY p_name) GROUP BY 1
)"""


def _graph(read) -> tuple[DataFrame, DataFrame]:
    modules, paths = _modules(read)
    steps = paths.select("file_path", F.explode(F.array(*[F.col("p_partkey") + n for n in (1, 2, 12, 35)])).alias("p_partkey"))
    imports = steps.join(modules, "p_partkey").select("file_path", "module").distinct()
    chunks = read("part").select(F.replace(F.col("p_name"), F.lit(" "), F.lit("/")).alias("file_path"))
    return graph.nodes(chunks), graph.edges(imports, paths.select("file_path").distinct(), external=True)


@query(f"WITH {GRAPH} SELECT node, chunks, files FROM nodes")
def package_nodes(read):
    return _graph(read)[0]


@query(f"WITH {GRAPH} SELECT src, dst, weight FROM weighed")
def graph_edges(read):
    return _graph(read)[1]


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, CAST((SELECT coalesce(sum(weight), 0) FROM weighed) AS BIGINT) AS edges")
def graph_stats(read):
    return graph.stats(*_graph(read))


@query(f"""WITH {GRAPH}, most AS (SELECT max(chunks) AS m FROM nodes), shaded AS (
  SELECT *, lpad(lower(hex(CAST(floor(240 - 110 * (CAST(chunks AS DOUBLE) / m)) AS INTEGER))), 2, '0') AS shade FROM nodes, most
)
SELECT 0 AS part, node AS name, printf('  "%s" [label="%s\\n%d files, %d chunks", fillcolor="#%s%sff"];', node, node, files, chunks, shade, shade) AS line FROM shaded
UNION ALL SELECT 1, src || chr(9) || dst, printf('  "%s" -> "%s" [label="%d", weight=%d];', src, dst, weight, least(20, weight)) FROM weighed""")
def dot_lines(read):
    return graph.dot_lines(*_graph(read))


DIFFS = """items AS (
  SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber
), lines AS (
  SELECT l_orderkey // 100 AS diff_id, l_orderkey * 100 AS pos, 'diff --git a/f' || l_orderkey // 32 || ' b/f' || l_orderkey // 32 AS line FROM items GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey // 100, l_orderkey * 100 + 1, CASE WHEN l_orderkey % 9 = 0 THEN '+++ /dev/null' ELSE '+++ b/f' || l_orderkey // 32 END FROM items GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey // 100, l_orderkey * 100 + 10 * l_linenumber, '@@ -1,3 +' || CAST(l_quantity AS INTEGER) * 10 || ',3 @@ f' FROM items
  UNION ALL SELECT l_orderkey // 100, l_orderkey * 100 + 10 * l_linenumber + 1, CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END || l_linestatus FROM items
  UNION ALL SELECT l_orderkey // 100, l_orderkey * 100 + 10 * l_linenumber + 2, CASE l_linestatus WHEN 'F' THEN '+' ELSE '---' END || l_returnflag FROM items
), marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER w AS section, sum(CASE WHEN starts_with(line, '@@ ') THEN 1 ELSE 0 END) OVER w AS hunk
  FROM lines WINDOW w AS (PARTITION BY diff_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), pathed AS (
  SELECT *, max(CASE WHEN starts_with(line, '+++ b/') THEN line[7:] END) OVER (PARTITION BY diff_id, section) AS file_path,
    max(CASE WHEN starts_with(line, '@@ ') THEN CAST(regexp_extract(line, '[+]([0-9]+)', 1) AS INTEGER) END) OVER (PARTITION BY diff_id, section, hunk) AS start,
    coalesce(sum(CASE WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 0 ELSE 1 END) OVER (PARTITION BY diff_id, section, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM marked
), added AS (
  SELECT diff_id, file_path, CAST(hunk AS BIGINT) AS hunk, CAST(start + before AS INTEGER) AS line_no FROM pathed
  WHERE file_path IS NOT NULL AND start IS NOT NULL AND starts_with(line, '+') AND NOT starts_with(line, '+++')
)"""


def _diffs(read) -> DataFrame:
    """Each order as a file's section, each line of it as a hunk. Items are dealt by diff, so that nothing but them is shuffled to make and to count lines."""
    key = F.col("l_orderkey")
    dealt = read("lineitem").select(F.floor(key / 100).alias("diff_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus").repartition("diff_id")
    item = dealt.groupBy("diff_id", "l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_returnflag", "l_linestatus")])
    first = F.row_number().over(Window.partitionBy("diff_id", "l_orderkey").orderBy("l_linenumber")) == 1
    name, at, flag = F.floor(key / 32), key * 100, F.col("l_returnflag")
    heads = [F.concat(F.lit("diff --git a/f"), name, F.lit(" b/f"), name), F.when(key % 9 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/f"), name))]
    rows = [
        F.concat(F.lit("@@ -1,3 +"), F.col("l_quantity").cast("int") * 10, F.lit(",3 @@ f")),
        F.concat(F.when(flag == "R", "-").when(flag == "A", "+").otherwise(" "), "l_linestatus"),
        F.concat(F.when(F.col("l_linestatus") == "F", "+").otherwise("---"), flag),
    ]
    placed = lambda start, lines: F.array(*[F.struct((start + i).alias("pos"), line.alias("line")) for i, line in enumerate(lines)])
    body = placed(at + F.col("l_linenumber") * 10, rows)
    whole = F.when(F.col("first"), F.concat(placed(at, heads), body)).otherwise(body)
    return item.withColumn("first", first).select("diff_id", F.explode(whole).alias("x")).select("diff_id", "x.*")


def _touched(read) -> DataFrame:
    """Orders as symbols of the files that the diffs change."""
    key = F.col("o_orderkey")
    start = key % 32 * 15
    return read("orders").select(F.concat(F.lit("f"), F.floor(key / 32)).alias("file_path"), F.concat(F.lit("Order"), key).alias("name"), F.lit("function").alias("kind"), start.cast("int").alias("start_line"), (start + 20).cast("int").alias("end_line"))


TOUCHED = """syms AS (
  SELECT 'f' || o_orderkey // 32 AS file_path, 'Order' || o_orderkey AS name, 'function' AS kind, CAST(o_orderkey % 32 * 15 AS INTEGER) AS start_line, CAST(o_orderkey % 32 * 15 + 20 AS INTEGER) AS end_line FROM orders
), changed AS (
  SELECT * FROM syms s WHERE EXISTS (SELECT 1 FROM added a WHERE a.file_path = s.file_path AND a.line_no BETWEEN s.start_line AND s.end_line)
)"""
CALLEES = "SELECT 'part' || p_partkey AS file_path, p_brand AS caller, 'Order' || p_partkey * 3 // 2 AS callee FROM part"


def _callees(read) -> DataFrame:
    """Parts as callers of orders."""
    return read("part").select(F.concat(F.lit("part"), "p_partkey").alias("file_path"), F.col("p_brand").alias("caller"), F.concat(F.lit("Order"), F.floor(F.col("p_partkey") * 3 / 2)).alias("callee"))


@query(f"WITH {DIFFS} SELECT diff_id, file_path, hunk, line_no FROM added")
def diff_parse(read):
    return diff.added_lines(_diffs(read))


@query(f"WITH {DIFFS} SELECT diff_id, file_path, hunk, line_no - 1 AS line_no FROM added")
def diff_parse_strict(read):
    return diff.added_lines(_diffs(read), strict_lines=True)


@query(f"WITH {DIFFS}, {TOUCHED} SELECT * FROM changed")
def diff_overlap(read):
    return diff.changed_symbols(_touched(read), diff.added_lines(_diffs(read)))


@query(f"""WITH {DIFFS}, {TOUCHED} SELECT file_path, name, start_line, diff_id, hunk FROM (
  SELECT s.file_path, s.name, s.start_line, a.diff_id, a.hunk, row_number() OVER (PARTITION BY s.file_path, s.name, s.start_line ORDER BY a.diff_id, a.hunk) AS r
  FROM syms s JOIN added a ON a.file_path = s.file_path AND a.line_no BETWEEN s.start_line AND s.end_line) WHERE r = 1""")
def diff_first_hunk(read):
    return diff.first_hunks(_touched(read), diff.added_lines(_diffs(read)))


@query(f"""WITH {DIFFS}, {TOUCHED} SELECT DISTINCT c.name, p.file_path, p.caller FROM changed c JOIN ({CALLEES}) p ON p.callee = c.name""")
def diff_callers(read):
    changed = diff.changed_symbols(_touched(read), diff.added_lines(_diffs(read)))
    return diff.callers(changed, _callees(read))


@query(f"""WITH {DIFFS}, {TOUCHED}, firsts AS (
  SELECT s.*, a.diff_id, a.hunk, row_number() OVER (PARTITION BY s.file_path, s.name, s.start_line ORDER BY a.diff_id, a.hunk) AS r FROM syms s JOIN added a ON a.file_path = s.file_path AND a.line_no BETWEEN s.start_line AND s.end_line
), bodies AS (
  SELECT diff_id, file_path, CAST(hunk AS BIGINT) AS hunk, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT starts_with(line, '@@ ')), '') AS body FROM pathed WHERE file_path IS NOT NULL AND start IS NOT NULL GROUP BY diff_id, file_path, hunk
), called AS (
  SELECT callee, file_path || '::' || caller AS c, row_number() OVER (PARTITION BY callee ORDER BY file_path || '::' || caller) AS r FROM (SELECT DISTINCT * FROM ({CALLEES}))
), listed AS (
  SELECT callee, string_agg(c, chr(10) ORDER BY c) FILTER (WHERE r <= 30) AS cs, count(*) AS n FROM called GROUP BY callee
)
SELECT f.file_path, f.name, f.start_line, 'The function ' || f.name || ' (' || f.file_path || ', lines ' || f.start_line || ' to ' || f.end_line || ') changes:' || chr(10) || trim(b.body) || chr(10) || chr(10) || 'It is called, by name, from:' || chr(10)
  || coalesce(l.cs, 'none is known') || chr(10) || chr(10)
  || 'Say whether the change breaks a promise that callers rely on, which of them break and how, or that this can''t be told.' AS prompt, coalesce(l.n, 0) AS n_callers
FROM firsts f JOIN bodies b ON b.diff_id = f.diff_id AND b.file_path = f.file_path AND b.hunk = f.hunk LEFT JOIN listed l ON l.callee = f.name WHERE f.r = 1""")
def diff_impact(read):
    """A prompt for every symbol that the diffs change."""
    found = diff.impact(_touched(read), _diffs(read), _callees(read))
    return answering.impact_prompts(found).select("file_path", "name", "start_line", "prompt", "n_callers")


@query("""WITH headers AS (SELECT o_orderkey // 100 AS diff_id, o_orderkey AS pos, '==== //depot/c' || o_custkey || '#' || o_orderkey % 9 || ' (text) ====' AS line, o_custkey FROM orders)
SELECT diff_id, pos, CASE WHEN pos % 7 = 0 THEN '=== ' || pos WHEN c_custkey IS NULL THEN line ELSE replace(line, '//depot/c' || o_custkey, 'src/' || c_name) END AS line
FROM headers LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0""")
def depot_paths(read):
    """Orders as headers of depot files, two thirds of which the customers' map names anew."""
    key = F.col("o_orderkey")
    header = F.concat(F.lit("==== //depot/c"), "o_custkey", F.lit("#"), key % 9, F.lit(" (text) ===="))
    lines = read("orders").select(F.floor(key / 100).alias("diff_id"), key.alias("pos"), F.when(key % 7 == 0, F.concat(F.lit("=== "), key)).otherwise(header).alias("line"))
    paths = read("customer").filter("c_custkey % 3 > 0").select(F.concat(F.lit("//depot/c"), "c_custkey").alias("depot"), F.concat(F.lit("src/"), "c_name").alias("local"))
    return diff.rewrite_paths(lines, paths)


def _lines(read) -> DataFrame:
    return chunking.lines_of(_files(read).select("file_path", F.replace(F.replace(F.col("text"), F.lit(">"), F.lit(">\n")), F.lit(";"), F.lit(";\n")).alias("text")))


LINES = f"""{FILES}, lines AS (
  SELECT file_path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT file_path, string_split(replace(replace(text, '>', '>' || chr(10)), ';', ';' || chr(10)), chr(10)) AS l FROM files)
)"""


@query(f"""WITH {LINES}, chars AS (
  SELECT file_path, pos, unnest(range(1, length(line) + 1)) AS i, unnest(string_split(line, '')) AS c FROM lines WHERE regexp_matches(line, '[{{}}]')
), braces AS (
  SELECT *, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY file_path ORDER BY pos, i ROWS UNBOUNDED PRECEDING) AS depth FROM chars WHERE c IN ('{{', '}}')
), openers AS (
  SELECT o.file_path, o.pos, o.i, (SELECT min(c.pos * 1000000 + c.i) FROM braces c WHERE c.file_path = o.file_path AND c.c = '}}' AND (c.pos, c.i) > (o.pos, o.i) AND c.depth = o.depth - 1) // 1000000 AS close FROM braces o WHERE o.c = '{{'
), sized AS (SELECT file_path, max(pos) AS last FROM lines GROUP BY file_path)
SELECT l.file_path, l.pos, CAST(coalesce((SELECT arg_min(o.close, o.pos * 1000000 + o.i) FILTER (WHERE true) FROM openers o WHERE o.file_path = l.file_path AND o.pos >= l.pos), s.last) AS INTEGER) AS end_line
FROM lines l JOIN sized s USING (file_path)""")
def brace_block_end(read):
    return chunking.block_ends(_lines(read))


def _sources(read, end: str, code: Column, pages: Column, texts: Column) -> DataFrame:
    """All pages and documents as (file_path, text): their whole texts in a form, the documents' followed by code."""
    docs = read("documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(end)).alias("file_path"), F.concat(texts, F.lit("\n"), code).alias("text"))
    page = F.concat(F.lit("pages/"), "page_id", F.lit(end)).alias("file_path")
    return docs.union(read("pages").select(page, pages.alias("text")))


@query()
def line_chunks_regex(read):
    code = F.concat(F.lit("import x from '"), "source", F.lit("';\nfunction f"), "doc_id", F.lit("(a) {\n  if (a) {\n    "), "lang", F.lit("(a);\n  }\n}\nclass C"), "doc_id", F.lit(" {\n  go() { }\n}\nconst "), "lang", F.lit(" = 1;"))
    tags = F.replace(F.replace(F.coalesce("html", F.lit("")), F.lit(">"), F.lit(">\n")), F.lit(";"), F.lit(";\n"))
    return chunking.brace_chunks(_sources(read, ".js", code, tags, F.coalesce("text", F.lit(""))), "javascript")


@query()
def python_ast_chunks(read):
    """Documents as comments above code, so that most parse; pages as they are, which don't."""
    code = F.concat(F.lit("from ."), "lang", F.lit(" import thing\n\nclass C"), "doc_id", F.lit(":\n    def run(self):\n        return self."), "lang", F.lit("(len('"), F.col("n_chars").cast("string"), F.lit("'))\n\nasync def g():\n    pass\n"), F.when(F.col("doc_id") % 10 == 0, "broken(").otherwise("print(g)"))
    remarks = F.concat(F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# ")))
    return chunking.python_chunks(_sources(read, ".py", code, F.coalesce("html", F.lit("")), remarks))


BLAME = "SELECT CAST(user_id AS VARCHAR) AS author, event_type AS rev, ts FROM events"


def _blame(read) -> DataFrame:
    return read("events").select(F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("rev"), "ts")


def _seconds(c: str) -> Column:
    return F.unix_timestamp(c).alias(c)


@query(f"""WITH b AS ({BLAME}) SELECT what, value, lines, CAST(epoch(date_trunc('second', f)) AS BIGINT) AS first_ts, CAST(epoch(date_trunc('second', l)) AS BIGINT) AS last_ts FROM (
  SELECT * FROM (SELECT 'author' AS what, author AS value, count(*) AS lines, min(ts) AS f, max(ts) AS l FROM b GROUP BY author ORDER BY lines DESC, value LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'rev', rev, count(*) AS lines, min(ts), max(ts) FROM b GROUP BY rev ORDER BY lines DESC, rev LIMIT 5)
  UNION ALL SELECT 'all', '', count(*), min(ts), max(ts) FROM b)""")
def blame_summary(read):
    return blame.summary(_blame(read)).select("what", "value", "lines", _seconds("first_ts"), _seconds("last_ts"))


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type FROM events""")
def blame_carry_forward(read):
    lines = read("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("event_type"))
    return blame.carry_forward(lines, "user_id", ["ts", "event_id"], ["event_type"]).drop("ts")


@query("""SELECT e.event_id, CASE WHEN c.c_custkey IS NULL THEN CAST(e.user_id AS VARCHAR) ELSE c.c_name END AS author FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 2 = 0""")
def blame_left_join(read):
    lines = read("events").select("event_id", F.col("user_id").alias("rev"), F.col("user_id").cast("string").alias("author"), "ts")
    changes = read("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("rev"), F.col("c_name").alias("author"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return blame.with_changes(lines, changes).select("event_id", "author")


@query("""SELECT user_id, event_id, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM (
  SELECT user_id, event_id, ts, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) WHERE total > 100) WHERE r = 1""")
def token_budget_crossing(read):
    calls = read("events").select("user_id", "event_id", "ts", F.abs("value").alias("value"))
    return blame.crossing(calls, "user_id", ["ts", "event_id"], "value", 100).select("user_id", "event_id", F.round("total", 6).alias("total"))


REPLY = """CASE conv_id % 5 WHEN 0 THEN 'NOT_RELEVANT ' || text WHEN 1 THEN '```json' || chr(10) || '{"severity": "' || CASE turn % 3 WHEN 0 THEN 'Major' WHEN 1 THEN ' ok ' ELSE 'bad' END || '", "n": ' || turn || '}' || chr(10) || '```'
  WHEN 2 THEN '{"n": ' || turn || '}' WHEN 3 THEN 'This is wrong: ' || role ELSE 'NOT_RELEVANTLY ' || role END"""


def _replies(read) -> DataFrame:
    kind, turn = F.col("conv_id") % 5, F.col("turn")
    level = F.when(turn % 3 == 0, "Major").when(turn % 3 == 1, " ok ").otherwise("bad")
    fenced = F.concat(F.lit('```json\n{"severity": "'), level, F.lit('", "n": '), turn, F.lit("}\n```"))
    reply = F.when(kind == 0, F.concat(F.lit("NOT_RELEVANT "), "text")).when(kind == 1, fenced).when(kind == 2, F.concat(F.lit('{"n": '), turn, F.lit("}"))).when(kind == 3, F.concat(F.lit("This is wrong: "), "role")).otherwise(F.concat(F.lit("NOT_RELEVANTLY "), "role"))
    return read("conversations").select("conv_id", "turn", reply.alias("reply"))


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {REPLY} AS reply FROM conversations) WHERE regexp_extract(reply, '^\\s*(\\S+)', 1) <> 'NOT_RELEVANT'")
def not_relevant_filter(read):
    return _replies(read).filter(T.is_relevant(F.col("reply"))).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (1, 2) THEN CAST(turn AS VARCHAR) END AS n FROM conversations")
def parse_action_json(read):
    return _replies(read).select("conv_id", "turn", F.get_json_object(T.reply_json(F.col("reply")), "$.n").alias("n"))


@query(f"""SELECT conv_id, turn, CASE conv_id % 5 WHEN 1 THEN CASE turn % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'ok' ELSE 'minor' END WHEN 2 THEN 'minor'
  ELSE CASE WHEN regexp_matches(lower({REPLY}), '{"|".join(T.MAJOR)}') THEN 'major' ELSE 'minor' END END AS severity FROM conversations""")
def review_severity(read):
    return _replies(read).select("conv_id", "turn", T.severity(F.col("reply")).alias("severity"))


PROMPTS = f"""WITH {HITS}, placed AS (
  SELECT *, source || '/' || lang AS file_path, CAST(doc_id % 997 AS INTEGER) AS a, CAST(doc_id % 997 + len(string_split(text, chr(10))) AS INTEGER) AS b FROM hits
), blocks AS (
  SELECT *, row_number() OVER (PARTITION BY file_path, lang ORDER BY a, b, 'd' || doc_id) AS n FROM placed
)
SELECT file_path, min(rank) AS first_rank, '{QUERY}' || chr(10) || chr(10) || 'Passages of ' || file_path || ', ' || lang || ':' || chr(10)
  || string_agg('[' || n || '] text d' || doc_id || ', lines ' || a || ' to ' || b || ', relevance ' || printf('%.3f', floor(score * 1000 + 0.5) / 1000) || chr(10) || text, chr(10) ORDER BY n)
  || chr(10) || chr(10) || '{answering.TRIAGE}' AS prompt FROM blocks GROUP BY file_path, lang"""


def _prompt_hits(read, file_path: Column) -> DataFrame:
    """The retrieval's hits with lines, scores and texts."""
    start, lines = F.col("doc_id") % 997, F.size(F.split("text", "\n"))
    place = [start.cast("int").alias("start_line"), (start + lines).cast("int").alias("end_line")]
    return _hits(read).select(file_path.alias("file_path"), F.col("lang").alias("language"), F.lit("text").alias("symbol_kind"), F.concat(F.lit("d"), "doc_id").alias("symbol_name"), *place, "score", "rank", "text")


@query(PROMPTS)
def prompt_per_file(read):
    """A prompt for each file of the retrieval's hits."""
    return answering.file_prompts(_prompt_hits(read, F.concat("source", F.lit("/"), "lang")), QUERY)


@query(f"""WITH {HITS} SELECT doc_id, '{QUERY}' || chr(10) || chr(10) || 'From ' || source || ', ' || lang || ':' || chr(10) || '[' || rank || '] text d' || doc_id || ', lines ' || CAST(doc_id % 997 AS INTEGER)
  || ' to ' || CAST(doc_id % 997 + len(string_split(text, chr(10))) AS INTEGER) || ', relevance ' || printf('%.3f', floor(score * 1000 + 0.5) / 1000) || chr(10) || text || chr(10) || chr(10) || '{answering.TRIAGE}' AS prompt FROM hits""")
def prompt_per_chunk(read):
    hits = _prompt_hits(read, F.col("source"))
    return answering.chunk_prompts(hits, QUERY).select(F.substring("symbol_name", 2, 20).cast("long").alias("doc_id"), "prompt")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files FROM documents")
def index_stats(read):
    return read("documents").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"))


@query("""SELECT 'f' || user_id // 4 AS file_path, CAST(event_id AS INTEGER) AS line_no, sha1('r' || user_id) AS rev, 'u' || user_id AS author, CAST(1700000000 + user_id AS BIGINT) AS ts, 's' || user_id AS summary FROM events""")
def blame_porcelain(read):
    rev = F.sha1(F.concat(F.lit("r"), "user_id"))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    told = [F.concat(rev, F.lit(" 1 "), "event_id", F.lit(" 1"))]
    told += [F.when(F.col("first"), F.concat(F.lit(f"{field} "), value)) for field, value in (("author", F.concat(F.lit("u"), "user_id")), ("author-mail", F.lit("<m>")), ("author-time", (F.col("user_id") + 1700000000).cast("string")), ("summary", F.concat(F.lit("s"), "user_id")))]
    told.append(F.concat(F.lit("\t"), "event_type"))
    rows = read("events").withColumn("first", first).select(F.concat(F.lit("f"), F.floor(F.col("user_id") / 4)).alias("file_path"), "event_id", F.posexplode(F.array(*told)).alias("i", "line"))
    lines = rows.filter("line IS NOT NULL").select("file_path", (F.col("event_id") * 10 + F.col("i")).alias("pos"), "line")
    return blame.parse_porcelain(lines).withColumn("ts", F.unix_timestamp("ts"))


@query()
def embed_hash(read):
    return embedding.embed(read("documents").select("doc_id", "text"), "doc_id")


@query()
def embed_latent(read):
    """Vectors of all documents in the directions learnt from all of them."""
    counts = latent.counted(read("documents"), "doc_id")
    return latent.embed_counted(counts, "doc_id", latent.train_counted(counts))


# Both format halves upwards, as Spark does: DuckDB's printf takes the even digit.
@query(f"""WITH {HITS}, replies AS (SELECT source, string_agg('d' || doc_id, ', ' ORDER BY doc_id) AS symbols, max(score) AS top FROM hits GROUP BY source)
SELECT source AS file_path, source || ': ' || symbols || ', relevance ' || printf('%.3f', floor(top * 1000 + 0.5) / 1000) || chr(10) || 'about ' || source AS block FROM replies WHERE source <> 'src3'""")
def prompt_aggregate(read):
    hits = _hits(read).select(F.col("source").alias("file_path"), F.concat(F.lit("d"), "doc_id").alias("symbol_name"), F.col("doc_id").alias("start_line"), "rank", "score")
    reply = F.when(F.col("file_path") == "src3", "NOT_RELEVANT").otherwise(F.concat(F.lit("about "), "file_path"))
    return answering.evidence(ranking.group_by_file(hits).withColumn("reply", reply)).select("file_path", "block")


@query(f"""WITH {COSINE} SELECT vec_id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank, round(score, 5) AS raw_score FROM cosine QUALIFY rank <= 20""")
def retrieve_cosine(read):
    vectors = read("embeddings").select("vec_id", F.lit("").alias("text"), "embedding")
    found = ranking.retrieve(vectors, "", _query_vector(read), "vec_id", mode="cosine")
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("raw_score", 5).alias("raw_score"))


@query("""WITH scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 10""")
def cosine_topk_batch(read):
    """The ten best vectors for each vector whose id is divisible by 20, against all."""
    vectors = read("embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.cosine_batch(vectors, queries, "vec_id", "query_id", 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def _probed(read, exact: bool) -> DataFrame:
    table = read("embeddings").select("vec_id", "embedding")
    index = vectors.build(table, "vec_id", vectors.train(table, "vec_id"))
    queries = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = vectors.PROBES if exact else vectors.calibrate(index, table, "vec_id", 10)
    found = vectors.search(index, queries, "query_id", 10, probes, exact)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(ORACLES["cosine_topk_batch"])
def cosine_topk_lists(read):
    """The same from an index of lists, of which those are read that can hold a better vector."""
    return _probed(read, exact=True)


@query()
def cosine_topk_probed(read):
    """The same from the nearest lists alone, so many that a sample finds 95 percent; tests measure the recall."""
    return _probed(read, exact=False)


@query(f"WITH {IMPORTS}, one AS (SELECT file_path FROM files ORDER BY page_id LIMIT 1) SELECT DISTINCT module FROM imports WHERE file_path = (SELECT file_path FROM one)")
def imports_of_file(read):
    first = _files(read).orderBy("page_id").first().file_path
    return graph.imports_of(_imports(read), first).select("module").distinct()


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN role || ' is vague, turn ' || turn ELSE '' END AS issues, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS n_missing FROM conversations""")
def review_lists(read):
    """Reviews of every turn: the lists in their JSON; those of odd conversations are prose."""
    turns = read("conversations")
    said = F.to_json(F.struct(F.array(F.concat("role", F.lit(" is vague")), F.concat(F.lit("turn "), "turn")).alias("issues"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("sources"))).alias("missing")))
    reply = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), said, F.lit("\n```"))).otherwise(F.concat(F.lit("no list, "), "role"))
    return turns.select("conv_id", "turn", F.array_join(T.review_list(reply, "issues"), ", ").alias("issues"), F.size(T.review_list(reply, "missing")).alias("n_missing"))


#: Languages by turns of doc_id: ending, what it imports a source by, how a function begins and ends, and its kind.
CODED = {
    "javascript": (".js", "import s from '%s';", "function %s(a) {", "}", "function"),
    "go": (".go", 'import "%s"', "func %s(a int) {", "}", "function"),
    "rust": (".rs", "use %s;", "pub fn %s(a: i32) {", "}", "function"),
    "csharp": (".cs", "using %s;", "public static List<int> %s(int a) {", "}", "method"),
    "cpp": (".cpp", '#include "%s"', "static int %s(int a) {", "}", "function"),
    "python": (".py", "import %s", "def %s(a):", "", "function"),
}
CODE = r"""code AS (
  SELECT source || '/' || doc_id || list_extract(ENDINGS, doc_id % 6 + 1) AS file_path, list_extract(KINDS, doc_id % 6 + 1) AS kind, doc_id % 6 = 5 AS python, i, 'f_' || ws[i][1] AS name, 'f_' || ws[i][-1] AS called FROM (
    SELECT doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_extract_all(l, '[A-Za-z]{2,}')), lambda w: len(w) > 0) AS ws FROM documents
  ), unnest(range(1, len(ws) + 1)) u(i)
)""".replace("ENDINGS", str([x[0] for x in CODED.values()])).replace("KINDS", str([x[4] for x in CODED.values()]))


def _code(read) -> DataFrame:
    """Documents as sources of six languages: each line is a function named by its first word that calls its last word and quotes all."""
    turn = F.col("doc_id") % len(CODED)
    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in CODED.values()]), (turn + 1).cast("int"))
    named = lambda form, name: F.replace(form, F.lit("%s"), name)
    docs = read("documents").select("doc_id", "source", "text", *[pick(n).alias(c) for n, c in enumerate(("end", "import", "open", "close"))])
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: F.regexp_extract_all(l, F.lit("[A-Za-z]{2,}"), F.lit(0))), lambda w: F.size(w) > 0)
    body = F.transform(lines, lambda w: F.concat(named(F.col("open"), F.concat(F.lit("f_"), F.get(w, F.lit(0)))), F.lit("\n  f_"), F.element_at(w, -1), F.lit("(a, '"), F.array_join(w, " "), F.lit("')\n"), F.col("close")))
    text = F.concat(named(F.col("import"), F.col("source")), F.lit("\n"), F.array_join(body, "\n"))
    path = F.concat("source", F.lit("/"), "doc_id", "end")
    return docs.select(path.alias("file_path"), T.language_of(path).alias("language"), text.alias("text")).withColumn("sha1", F.sha1("text"))


@query(f"""WITH {CODE} SELECT kind, file_path, name, CAST(3 * i - 1 AS INTEGER) AS start_line, CAST(CASE WHEN python THEN 3 * i ELSE 3 * i + 1 END AS INTEGER) AS end_line FROM code
UNION ALL SELECT DISTINCT 'call', file_path, name || ' ' || c, 0, 0 FROM (SELECT file_path, name, unnest(CASE WHEN python THEN [called] ELSE [name, called] END) AS c FROM code)
UNION ALL SELECT 'import', source || '/' || doc_id || list_extract({[x[0] for x in CODED.values()]}, doc_id % 6 + 1), source, 0, 0 FROM documents""")
def index_build(read):
    """Symbols, calls and imports of an index built from every document's lines, in six languages."""
    index = files.build(_code(read))
    none = F.lit(0)
    symbols = index["symbols"].select("kind", "file_path", "name", "start_line", "end_line")
    calls = index["calls"].select(F.lit("call"), "file_path", F.concat_ws(" ", "caller", "callee"), none, none)
    return symbols.union(calls).union(index["imports"].select(F.lit("import"), "file_path", "module", none, none))


@query(r"""WITH d AS (
  SELECT doc_id, doc_id % 2 = 0 AS cpp, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_extract_all(l, '[A-Za-z]{2,}')), lambda w: len(w) > 0) AS ws FROM documents
), f AS (SELECT doc_id, CASE WHEN cpp THEN 'cpp' ELSE 'csharp' END AS language, 'C' || doc_id AS c, cpp, ws, len(ws) AS n, 'd' || doc_id AS file_path FROM d)
SELECT file_path, language, 'namespace' AS symbol_kind, 'N' || doc_id AS symbol_name, 1 AS start_line, CAST(3 * n + 4 AS INTEGER) AS end_line FROM f
UNION ALL SELECT file_path, language, 'class', c, 2, CAST(3 * n + 3 AS INTEGER) FROM f
UNION ALL SELECT file_path, language, 'method', CASE WHEN cpp THEN c || '::' ELSE '' END || 'f_' || ws[i][1], CAST(3 * i AS INTEGER), CAST(3 * i + 2 AS INTEGER) FROM f, unnest(range(1, n + 1)) u(i)""")
def structure_symbols(read):
    """Documents as C++ and C# sources: each line is a method over three lines, with its words and braces in comments and strings."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: F.regexp_extract_all(l, F.lit("[A-Za-z]{2,}"), F.lit(0))), lambda w: F.size(w) > 0)
    body = F.transform(lines, lambda w: F.concat(F.lit("  int f_"), F.get(w, F.lit(0)), F.lit("(\n    int a) { /* { "), F.array_join(w, " "), F.lit('\n  } */ g("} '), F.array_join(w, " "), F.lit('"); }\n')))
    text = F.concat(F.lit("namespace N"), "doc_id", F.lit(" {\nclass C"), "doc_id", F.lit(" {\n"), F.array_join(body, ""), F.lit("}\n}"))
    language = F.when(F.col("doc_id") % 2 == 0, "cpp").otherwise("csharp")
    documents = dealt(read("documents").select("doc_id", "text"), "doc_id")
    return structure.declarations(documents.select(F.concat(F.lit("d"), "doc_id").alias("file_path"), language.alias("language"), text.alias("text")))


@query("""SELECT conv_id, turn, tokens, cost, CAST(sum(tokens) OVER w AS BIGINT) AS total_tokens, CAST(sum(cost) OVER w AS BIGINT) AS total_cost, sum(tokens) OVER w > 100000 AND sum(tokens) OVER w - tokens <= 100000 AS crossed_tokens
FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS tokens, CAST(length(text) * CASE role WHEN 'user' THEN 1 ELSE 4 END AS BIGINT) AS cost FROM conversations) WINDOW w AS (ORDER BY conv_id, turn, tokens, cost ROWS UNBOUNDED PRECEDING)""")
def run_totals(read):
    """Totals of tokens and cost over a whole run, and the call that crosses a limit: all turns as calls, what a user says at a quarter of the price."""
    tokens = F.length("text").cast("long")
    calls = read("conversations").select("conv_id", "turn", tokens.alias("tokens"), (tokens * F.when(F.col("role") == "user", 1).otherwise(4)).cast("long").alias("cost"))
    return blame.run_totals(calls, ["conv_id", "turn", "tokens", "cost"], ["tokens", "cost"], {"tokens": 100_000})


LATE_RUNS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: ('^' || {0} || '$')[i:i + 2]))"


@query(f"""WITH {BM25}, pool AS (SELECT doc_id FROM bm25 ORDER BY score DESC, doc_id LIMIT 80), asked AS (SELECT w AS q, {LATE_RUNS.format('w')} AS qr FROM (SELECT DISTINCT unnest(['the', 'and', 'tion', 'that', 'with']) AS w)
), held AS (SELECT doc_id, p, {LATE_RUNS.format('p')} AS pr FROM (SELECT DISTINCT doc_id, unnest(t) AS p FROM tokens JOIN pool USING (doc_id))
), best AS (SELECT doc_id, q, max(len(list_intersect(qr, pr)) / (sqrt(len(qr)) * sqrt(len(pr)))) AS b FROM held, asked GROUP BY doc_id, q
), late AS (SELECT doc_id, round(coalesce(sum(b), 0), 9) AS score FROM pool LEFT JOIN best USING (doc_id) GROUP BY doc_id)
SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, round(score, 6) AS raw_score FROM late QUALIFY rank <= 20""")
def rerank_late(read):
    """The words' pool in the order of late interaction between tokens."""
    rerank = embedding.late_interaction(read("documents"), QUERY, "doc_id")
    found = ranking.retrieve(_chunks(read), QUERY, None, "doc_id", mode="bm25", rerank=lambda hits: rerank(hits).withColumn("raw_score", F.round("raw_score", 9)))
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("raw_score", 6).alias("raw_score"))


@query(f"WITH {SYMBOLS} SELECT * FROM symbols WHERE name ILIKE '%tion%t%' ORDER BY chunk_id LIMIT 50")
def grep_symbol_indexed(read):
    """Names with a part, by an index of trigrams of all names."""
    symbols = _symbols(read)
    spark = read("documents").sparkSession
    return names.grep(spark, names.write(symbols, "chunk_id"), symbols, "tion%t", "chunk_id")
