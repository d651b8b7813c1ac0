"""What an assistant may ask of an index, by name: each action is a DataFrame of the rows that it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import blame, graph, ranking
from lodestone.plans.lineage import small

#: How many rows an action shows, and how many characters of a text.
SHOWN = {"find": 30, "grep": 30, "callers": 50, "imports": 200, "files_importing": 50, "fetch": 1}
FETCHED = 1_500
#: Index tables to rows; arguments by keyword.
Action = Callable[..., DataFrame]


def find(index: dict[str, DataFrame], name: str) -> DataFrame:
    """Symbols of this very name."""
    return graph.find_symbol(index["symbols"], name).orderBy("file_path", "start_line").limit(SHOWN["find"])


def grep(index: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Symbols whose name contains the pattern."""
    found = graph.grep_symbol(index["symbols"].withColumn("__place", F.struct("file_path", "start_line", "name")), pattern, "__place", SHOWN["grep"])
    return found.drop("__place")


def callers(index: dict[str, DataFrame], symbol: str) -> DataFrame:
    """Who calls a name."""
    return graph.callers_of(index["calls"], symbol, SHOWN["callers"])


def imports(index: dict[str, DataFrame], file: str) -> DataFrame:
    """What a file imports."""
    return graph.imports_of(index["imports"], file).limit(SHOWN["imports"])


def files_importing(index: dict[str, DataFrame], module: str) -> DataFrame:
    """Files that import a module or something below it."""
    return graph.files_importing(index["imports"], module).select("file_path").distinct().orderBy("file_path").limit(SHOWN["files_importing"])


def fetch(index: dict[str, DataFrame], file: str, symbol: str) -> DataFrame:
    """A symbol's chunk, its text cut for display; more says how many characters that leaves out."""
    chunk = index["chunks"].filter((F.col("file_path") == file) & (F.col("symbol_name") == symbol)).orderBy("start_line").limit(SHOWN["fetch"])
    return chunk.select("file_path", "symbol_name", "symbol_kind", "start_line", "end_line", F.substring("text", 1, FETCHED).alias("text"), F.greatest(F.length("text") - FETCHED, F.lit(0)).alias("more"))


def search(index: dict[str, DataFrame], query: str, top_k: int = 10, query_vector: DataFrame | None = None) -> DataFrame:
    """The best chunks for a query, by words, or by words and vectors where a query vector is given (one row with embedding)."""
    chunks = index["chunks"].withColumn("chunk_id", F.concat_ws(":", "file_path", F.lpad(F.col("start_line").cast("string"), 9, "0"), "symbol_name"))
    found = ranking.retrieve(chunks, query, query_vector, "chunk_id", top_k, "bm25" if query_vector is None else "hybrid")
    shown = chunks.select("chunk_id", "file_path", "start_line", "symbol_kind", "symbol_name")
    return shown.join(small(found, top_k), "chunk_id").drop("chunk_id").orderBy("rank")


def blamed(index: dict[str, DataFrame], file: str, symbol: str, lines: DataFrame) -> DataFrame:
    """Who wrote a symbol's lines: blame.summary of lines (file_path, line_no, author, rev, ts) within it."""
    place = index["symbols"].filter((F.col("file_path") == file) & (F.col("name") == symbol)).orderBy("start_line").limit(1).select("start_line", "end_line")
    own = lines.filter(F.col("file_path") == file).crossJoin(F.broadcast(place)).filter("line_no BETWEEN start_line AND end_line")  # one row
    return blame.summary(own)


ACTIONS: dict[str, Action] = {"search": search, "blame": blamed, "find": find, "grep": grep, "callers": callers, "imports": imports, "files_importing": files_importing, "fetch": fetch}


def act(index: dict[str, DataFrame], action: str, **arguments) -> DataFrame:
    """The rows of an action; an unknown one, or blank arguments, are errors."""
    if action not in ACTIONS:
        raise ValueError(f"actions are {sorted(ACTIONS)}, not {action!r}")
    arguments = {k: v.strip() if isinstance(v, str) else v for k, v in arguments.items()}
    if "" in [v for v in arguments.values() if isinstance(v, str)]:
        raise ValueError(f"{action} needs all of its arguments")
    return ACTIONS[action](index, **arguments)
