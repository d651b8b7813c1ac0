"""Column expressions for code and text: tokens, languages, ignored paths, packages, model replies."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by language.
EXTENSIONS = {
    "python": ["py"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "go": ["go"],
    "rust": ["rs"],
    "csharp": ["cs"],
    "cpp": ["cpp", "cc", "cxx", "c++", "h", "hpp", "hh", "hxx", "h++", "inl"],
}
#: Folder names that are never indexed, and beginnings of such names.
IGNORED = [
    ".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".next", ".nuxt",
    ".venv", "venv", "env", "dist", "build", "target", ".gradle", "cmake-build-debug", "cmake-build-release", "obj", "bin", "out",
]
IGNORED_STARTS = ["build.", "build-", "cmake-build-"]
#: What marks code in a reply, and words that make a review without JSON a major one.
FENCE = "```"
MAJOR = ["major", "incorrect", "wrong", "factually"]
#: What a term is; scores of an index depend on it.
IDENTIFIER, PIECE = "[A-Za-z_][A-Za-z0-9_]+", "[A-Z]+[a-z0-9]*|[a-z0-9]+"
WORD = re.compile(IDENTIFIER)
#: Words whose tokens a task remembers, and from how many characters a text's words are not listed at once.
CACHED, LONG = 200_000, 1_000_000


def tokens(text: Column) -> Column:
    """Identifiers of two characters and more in lower case, each followed by its parts at underscores and at capitals; repeats stay."""

    def parts(word: Column) -> Column:
        snake = F.transform(F.filter(F.split(word, "_"), lambda p: p != ""), F.lower)
        camel = F.transform(F.regexp_extract_all(word, F.lit(PIECE), F.lit(0)), F.lower)
        # A plain word is its own only part, both times; most are, and need no splitting.
        return F.when(word.rlike("^[A-Za-z][a-z0-9]*$"), F.array_repeat(F.lower(word), 3)).otherwise(F.concat(F.array(F.lower(word)), snake, camel))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), parts))


def query_tokens(text: str) -> list[str]:
    """tokens() of a query on the driver."""
    out = []
    for word in re.findall(IDENTIFIER, text):
        out += [word.lower(), *(p.lower() for p in word.split("_") if p), *(p.lower() for p in re.findall(PIECE, word))]
    return out


@lru_cache(maxsize=CACHED)
def token_counts(word: str) -> tuple[tuple[str, int], ...]:
    """The tokens of one word with how often each occurs."""
    if "_" not in word and word[1:].islower():
        return ((word.lower(), 3),)
    return tuple(Counter(query_tokens(word)).items())


def word_counts(text: str | None) -> Counter[str]:
    """How often each identifier occurs in a text; those of a long text are never listed."""
    found = WORD.findall(text) if text and len(text) < LONG else (m[0] for m in WORD.finditer(text or ""))
    return Counter(found)


def language_of(path: Column) -> Column:
    """By the extension; null for all others."""
    known = F.create_map(*map(F.lit, chain.from_iterable((x, language) for language, all_ in EXTENSIONS.items() for x in all_)))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def is_ignored(path: Column) -> Column:
    """Whether any part of a relative path is an ignored name."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(IGNORED) | p.rlike("^(" + "|".join(map(re.escape, IGNORED_STARTS)) + ")"))


def package_of(path: Column, depth: int = 1) -> Column:
    """The first parts of a path; files at the top belong to root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, F.lit("root")).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


def reply_json(reply: Column) -> Column:
    """The JSON object of a model's reply as text: the first object that stands alone between fences, else the whole; null if it doesn't parse."""
    between = F.filter(F.split(reply, FENCE), lambda part, i: i % 2 == 1)
    objects = F.filter(F.transform(between, lambda part: F.btrim(F.when(part.startswith("json"), F.substring(part, 5, 1 << 30)).otherwise(part), F.lit(" \n\r\t"))), lambda part: part.startswith("{") & part.endswith("}"))
    text = F.coalesce(F.get(objects, F.lit(0)), F.trim(reply))
    return F.when(F.try_parse_json(text).isNotNull(), text)


def is_relevant(reply: Column) -> Column:
    """False where the first word of a triage reply is NOT_RELEVANT."""
    return F.coalesce(F.regexp_extract(reply, r"^\s*(\S+)", 1) != "NOT_RELEVANT", F.lit(True))


def severity(reply: Column) -> Column:
    """ok, minor or major of a review: the JSON's own, minor for any other value there; without JSON major if one of MAJOR occurs anywhere, even inside a word, else minor."""
    parsed = reply_json(reply)
    own = F.lower(F.trim(F.coalesce(F.get_json_object(parsed, "$.severity"), F.lit(""))))
    found = F.exists(F.array(*map(F.lit, MAJOR)), lambda word: F.contains(F.lower(reply), word))
    return F.when(parsed.startswith("{"), F.when(own.isin("ok", "minor", "major"), own).otherwise("minor")).otherwise(F.when(found, "major").otherwise("minor"))


def review_list(reply: Column, field: str) -> Column:
    """The texts of a list in a review's JSON (issues, missing); empty without JSON or such a list."""
    listed = F.from_json(F.get_json_object(reply_json(reply), f"$.{field}"), "array<string>")
    return F.coalesce(listed, F.array().cast("array<string>"))
