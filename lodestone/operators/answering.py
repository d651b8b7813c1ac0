"""From hits to a model's answer: prompts as columns, batched calls in tasks, budgets and reviews on the driver."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import is_relevant, severity
from lodestone.operators.ranking import group_by_file
from lodestone.plans.lineage import cut, small

#: A provider: a function of (prompts) that returns replies in the same order.
Provider = Callable[[list[str]], list[str]]


#: How a passage's prompt ends; a reply that begins with NOT_RELEVANT drops out.
TRIAGE = "Answer from these passages; begin with NOT_RELEVANT if they say nothing of it."
NOTHING = "No relevant code was found."


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """Calls are reserved before a job starts, since retried tasks can't be trusted to count; tokens are counted from the replies kept."""

    limit: int = 100
    calls: int = 0
    token_limit: int | None = None
    token_warning: int | None = None
    tokens: int = 0
    warned: bool = False

    def reserve(self, n: int) -> None:
        if self.calls + n > self.limit:
            raise BudgetExceeded(f"{self.calls} of {self.limit} calls are used; {n} more were asked for")
        if self.token_limit is not None and self.tokens >= self.token_limit:
            raise BudgetExceeded(f"{self.tokens} tokens are used, of {self.token_limit}")
        self.calls += n

    def record(self, tokens: int) -> None:
        """Counts tokens of prompts and replies; warns once when the warning mark is reached."""
        self.tokens += tokens
        if self.token_warning is not None and self.tokens >= self.token_warning and not self.warned:
            self.warned = True
            warnings.warn(f"{self.tokens} tokens are used; the warning was set at {self.token_warning}", stacklevel=2)


def chunk_block(number: Column, kind: Column, name: Column, start: Column, end: Column, score: Column, text: Column) -> Column:
    """One numbered passage of a prompt."""
    return F.format_string("[%d] %s %s, lines %d to %d, relevance %.3f\n%s", number, kind, name, start, end, score, text)


def chunk_prompts(hits: DataFrame, question: str) -> DataFrame:
    """hits (see file_prompts) with prompt: one for each hit alone."""
    block = chunk_block(F.col("rank"), F.col("symbol_kind"), F.col("symbol_name"), F.col("start_line"), F.col("end_line"), F.col("score"), F.col("text"))
    return hits.withColumn("prompt", F.concat(F.lit(f"{question}\n\nFrom "), "file_path", F.lit(", "), "language", F.lit(":\n"), block, F.lit(f"\n\n{TRIAGE}")))


def file_prompts(hits: DataFrame, question: str) -> DataFrame:
    """(file_path, first_rank, prompt) of hits (file_path, language, symbol_kind, symbol_name, start_line, end_line, score, rank, text): a prompt per file, its chunks by line.

    hits are a retrieval's, so few; a file's are gathered in one row.
    """
    fields = ["start_line", "end_line", "symbol_kind", "symbol_name", "score", "text"]
    grouped = hits.groupBy("file_path", "language").agg(F.min("rank").alias("first_rank"), F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    blocks = F.transform("c", lambda x, i: chunk_block(i + 1, x["symbol_kind"], x["symbol_name"], x["start_line"], x["end_line"], x["score"], x["text"]))
    return grouped.select("file_path", "first_rank", F.concat(F.lit(f"{question}\n\nPassages of "), "file_path", F.lit(", "), "language", F.lit(":\n"), F.array_join(blocks, "\n"), F.lit(f"\n\n{TRIAGE}")).alias("prompt"))


def impact_prompts(impacts: DataFrame) -> DataFrame:
    """impacts (of diff.impact) with prompt: the change, the symbol and who calls it."""
    callers = F.when(F.size("callers") > 0, F.array_join("callers", "\n")).otherwise("none is known")
    head = F.format_string("The %s %s (%s, lines %d to %d) changes:\n%s\n\nIt is called, by name, from:\n", "kind", "name", "file_path", "start_line", "end_line", F.trim("body"))
    return impacts.withColumn("prompt", F.concat(head, callers, F.lit("\n\nSay whether the change breaks a promise that callers rely on, which of them break and how, or that this can't be told.")))


def impact_report(replies: DataFrame) -> str:
    """The answer on a diff from impact_prompts() with reply: a paragraph per changed symbol, as many rows as a diff changes."""
    rows = replies.select("file_path", "kind", "name", "start_line", "n_callers", F.trim("reply").alias("reply")).orderBy("file_path", "start_line", "name").collect()
    return "\n\n".join(f"{r.file_path}: {r.kind} {r.name}, callers: {r.n_callers}\n{r.reply}" for r in rows) or "The diff touches no symbol of the index."


def ask(prompts: DataFrame, provider: Provider, budget: Budget, prompt_col: str = "prompt") -> DataFrame:
    """Adds reply. The prompts (a few per query) are counted against the budget first; write the result out before using it twice."""
    budget.reserve(prompts.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=provider(batch[prompt_col].tolist()))

    return prompts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", reply string")


def ask_once(prompts: DataFrame, provider: Provider, budget: Budget, store: str, prompt_col: str = "prompt", at_once: int = 8, round_: int = 512) -> DataFrame:
    """As ask, but each prompt is paid for once: replies are kept in a Parquet table at store (prompt_key, reply), and what it has is not asked again.

    Prompts that are new there, each once, are counted against the budget and asked in rounds of about so many; a round
    is appended when all of it is answered, so after a failure only its own prompts are asked anew. In a task so many
    calls run at a time; replies keep the order of their prompts. Null prompts get null replies.
    """
    spark = prompts.sparkSession
    schema = "prompt_key string, reply string"
    spark.createDataFrame([], schema).write.mode("append").parquet(store)
    known = lambda: spark.read.schema(schema).parquet(store).dropDuplicates(["prompt_key"])
    keyed = cut(prompts.withColumn("prompt_key", F.sha2(F.col(prompt_col), 256)))
    new = keyed.filter("prompt_key IS NOT NULL").select("prompt_key", F.col(prompt_col).alias("prompt")).dropDuplicates(["prompt_key"])
    new = cut(new.join(known(), "prompt_key", "left_anti"))
    n = new.count()
    budget.reserve(n)
    rounds = -(-n // round_)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                replies = list(pool.map(lambda p: provider([p])[0], batch["prompt"]))
                yield pd.DataFrame({"prompt_key": batch["prompt_key"], "reply": replies})

    for k in range(rounds):
        new.filter(F.pmod(F.xxhash64("prompt_key"), F.lit(rounds)) == k).mapInPandas(run, schema).write.mode("append").parquet(store)
    return keyed.join(known(), "prompt_key", "left").select(*prompts.columns, "reply")


def evidence(groups: DataFrame) -> DataFrame:
    """Adds block to the relevant groups (file_path, symbols as a list joined by commas, top_score, reply): what the final prompt says of each file."""
    block = F.concat("file_path", F.lit(": "), "symbols", F.format_string(", relevance %.3f\n%s", "top_score", "reply"))
    return groups.filter(is_relevant(F.col("reply"))).withColumn("block", block)


def answer(groups: DataFrame, question: str, provider: Provider, budget: Budget) -> str:
    """One last call over the blocks of the relevant groups by their first rank: at most top_k rows reach the driver."""
    blocks = [r.block for r in evidence(groups).orderBy("first_rank").select("block").collect()]
    if not blocks:
        return NOTHING
    budget.reserve(1)
    return provider([f"{question}\n\nWhat was found, best file first:\n\n" + "\n\n".join(blocks) + "\n\nAnswer from this alone, name files and symbols, and say what is missing."])[0]


def one_shot(chunks: DataFrame, hits: DataFrame, id_col: str, question: str, provider: Provider, budget: Budget) -> str:
    """A question answered over hits (id, rank, score) of ranking.retrieve: their chunks (id, file_path, ...) grouped by file, one call a file, then one over the relevant replies."""
    found = chunks.join(small(hits.select(id_col, "rank", "score")), id_col)
    replies = cut(ask(file_prompts(found, question), provider, budget).select("file_path", "reply"))
    return answer(group_by_file(found).join(replies, "file_path"), question, provider, budget)


def reviewed(draft: str, question: str, provider: Provider, budget: Budget, spark, rounds: int = 1) -> tuple[str, list[str]]:
    """(answer, severities): reviews and rewrites a draft until a review says ok, 1 to 5 rounds."""
    said = []
    for _ in range(min(5, max(1, rounds))):
        budget.reserve(1)
        reply = provider([f"Review this answer to: {question}\n\n{draft}\n\nReply in JSON with severity (ok, minor, major), issues, missing."])[0]
        said.append(spark.createDataFrame([(reply,)], "r string").select(severity(F.col("r"))).first()[0])
        if said[-1] == "ok":
            break
        budget.reserve(1)
        draft = provider([f"Rewrite the answer to: {question}\n\n{draft}\n\nMind this review:\n{reply}"])[0]
    return draft, said
