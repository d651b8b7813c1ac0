"""Line-first quality rules, in Spark SQL functions only.

Each line is judged on its own (punctuation, navigation, boilerplate); failed lines go; a document that loses too
much of its text, or that fails the rules on the whole text, is rejected. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import SPACE, word_count

MIN_WORDS = 50
#: Percent of the words that may lie in repeated 3-word windows, and that failed lines may take with them.
MAX_REPEATED = 50
MAX_LOST = 50
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line fails with more symbols than this share of its words.
MAX_SYMBOLS = 0.3
#: A line without any sentence mark fails below so many words (headings, menu entries).
MIN_OPEN_LINE = 8
#: Phrases of boilerplate lines, lower case; a corpus in other languages brings its own as a parameter.
BOILERPLATE = [
    "all rights reserved", "copyright ©", "licensed under", "released under", "terms of service", "terms of use", "terms and conditions",
    "privacy policy", "cookie policy", "accept cookies", "accept all", "we use cookies", "enable javascript", "javascript is disabled",
    "click here", "read more", "learn more", "show more", "sign up", "sign in", "log in", "forgot password", "create an account",
    "subscribe to", "unsubscribe", "newsletter", "share this", "share on", "follow us", "contact us", "about us", "site map",
    "skip to content", "back to top", "previous page", "next page", "related articles", "leave a comment", "powered by", "add to cart",
]
#: Boilerplate is a short line; a phrase inside a paragraph is prose.
MAX_BOILERPLATE_WORDS = 25


def _symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def line_fails(line: Column, phrases: list[str] = BOILERPLATE) -> Column:
    """True for a line with words that is no prose: see the rules of this module. phrases stand for themselves, in lower case."""
    n = word_count(line)
    bars = F.length(line) - F.length(F.translate(line, "|»›•", ""))
    open_line = ~line.rlike("[.!?…。:;]")
    punctuation = (open_line & (n < MIN_OPEN_LINE)) | (_symbols(line) > n * MAX_SYMBOLS)
    navigation = (bars >= 2) & (bars * 8 >= n)
    boilerplate = (n <= MAX_BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(f"\\Q{x}\\E" for x in phrases) or "(?!)")
    return punctuation | navigation | boilerplate


def measure(docs: DataFrame, phrases: list[str] = BOILERPLATE) -> DataFrame:
    """Adds __q_n_words, __q_word_chars, __q_n_symbols, __q_n_dup_lines, __q_n_repeat_words and __q_n_lost (words of failed lines).

    Null and empty texts measure 0. Columns of docs keep their names and values; docs must have text and no column
    that begins with __q_. Words in 3-word windows found twice or more are counted so: the windows' hashes are sorted
    beside their places, equal ones become neighbours, and each of their places, in order, covers three words but for
    those that the next place covers as well: O(n log n) in the length of the text, in a row of its own.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*keep, text.alias("__q_text"), F.split(text, SPACE).alias("__q_split"))
    out = out.select(*keep, "__q_text", F.expr("filter(__q_split, w -> w != '')").alias("__q_words"), F.filter(F.split("__q_text", "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")).alias("__q_lines"))
    out = out.withColumn("__q_windows", F.expr("sort_array(transform(slice(__q_words, 3, greatest(size(__q_words) - 2, 0)), (w, i) -> struct(xxhash64(__q_words[i], __q_words[i + 1], w) AS h, i AS i)))"))
    twice = "get(__q_windows, j - 1).h <=> x.h OR get(__q_windows, j + 1).h <=> x.h"
    out = out.withColumn("__q_places", F.expr(f"sort_array(filter(transform(__q_windows, (x, j) -> IF({twice}, x.i, NULL)), i -> i IS NOT NULL))"))
    covered = F.expr("aggregate(transform(__q_places, (p, j) -> coalesce(least(3, get(__q_places, j + 1) - p), 3)), 0L, (a, n) -> a + n)")
    failed = F.filter("__q_lines", lambda l: line_fails(l, phrases))
    return out.select(
        *keep,
        F.size("__q_words").cast("long").alias("__q_n_words"),
        F.aggregate("__q_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("__q_word_chars"),
        _symbols(F.col("__q_text")).alias("__q_n_symbols"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("__q_n_dup_lines"),
        # An expression that isn't deterministic keeps filters above this select; pushed down, they would copy all of it into one expression.
        F.when(F.spark_partition_id() >= 0, covered).alias("__q_n_repeat_words"),
        F.aggregate(failed, F.lit(0).cast("long"), lambda a, l: a + word_count(l)).alias("__q_n_lost"),
    )


def judge(docs: DataFrame, phrases: list[str] = BOILERPLATE) -> DataFrame:
    """measure() with __q_base_failed (rules on the whole text) and __q_kept (neither those failed nor too much text lost)."""
    n = F.col("__q_n_words")
    base = (n < MIN_WORDS) | (F.col("__q_n_repeat_words") * 100 > n * MAX_REPEATED)
    return measure(docs, phrases).withColumn("__q_base_failed", base).withColumn("__q_kept", ~base & (F.col("__q_n_lost") * 100 <= n * MAX_LOST))


def clean(docs: DataFrame, phrases: list[str] = BOILERPLATE) -> DataFrame:
    """The kept documents with the lines that passed, in docs' columns. Lines without words stay as they are."""
    kept = judge(docs, phrases).filter("__q_kept")
    passed = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda l: ~l.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(l, phrases))
    return kept.select(*[F.array_join(passed, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
