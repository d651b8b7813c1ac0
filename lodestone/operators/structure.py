"""Structure of C++ and C# sources: declarations with the types they stand in, by a lexer and a scope stack.

The lexer blanks comments, strings and characters. Code is then cut into statements at ; and braces, over line ends; a
statement that opens a brace, or is one of a few forms without, may declare something. A source that comes as one text
is read once, from its beginning to its end, within the task that has it: nothing is shuffled.

Sources that come as tables of lines are not put together. What a line leaves open (a block comment, a verbatim or a raw
string) depends on what it begins in, so each line has a table from the state at its beginning to that at its end;
tables are composed within blocks of lines, then over a file's blocks, which tells every line's state. The innermost
type around a declaration is the last one before it that opened one level above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.chunking import block_of, matched
from lodestone.plans.lineage import written

#: Lines whose states are composed at a time.
LEXED = 256
#: Texts whose declarations are found into one batch, and up to how many characters a statement, once told, is remembered.
TEXTS, SHORT = 256, 200
#: What is blanked; lines end at \n alone. Groups catch what stays open at a line's end: states 1 to 3.
_GONE = r"""(?d)//.*$|/\*.*?\*/|(/\*).*$|\bR"\(.*?\)"|\b(R")\(.*$|@\$?"(?:[^"]|"")*+"|(@\$?")(?:[^"]|"")*+$|"(?:\\.|[^"\\])*+\\?"?|(?<![0-9A-Fa-f])'(?:\\.|[^'\\])*+\\?'?"""
_OPEN = ["/*", "R\"", "\""]
#: How each open state ends.
_ENDS = [r"(?d)^.*?\*/", r"(?d)^.*?\)\"", r'^(?:[^"]|"")*+"']
#: The same over a whole text, and what else a reader stops at: ; and braces, and the beginning of a preprocessor line.
#: Every alternative begins with a character of its own, so that what lies between is skipped.
_STOPS = re.compile(r""";|\{|\}|\n[ \t\x0b\f\r]*#|/(?:/[^\n]*+|\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?)|R(?<!\wR)"\([^)]*+(?:\)(?!")[^)]*+)*+(?:\)")?|@\$?"[^"]*+(?:""[^"]*+)*+"?|"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+\\?"?|'(?<![0-9A-Fa-f]')[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+\\?'?""")
_NAME, _GENERIC = r"[^\W\d]\w*", r"(?:\s*<[^()]*?>)?"
#: Words that stand before a bracket without naming a function.
_CONTROL = "if|for|foreach|while|switch|catch|return|using|lock|fixed|sizeof|alignas|decltype|noexcept|when|else|do|new|throw|operator"
_ROUND = r"\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)"
TYPES = ("class", "struct", "interface", "record")
#: What stands before a declaration: access, attributes, templates.
_ACCESS = r"^ *(?:(?:public|private|protected)(?: \w+)? ?:(?!:) *|\[[^\]]*\] *)+"
_TEMPLATE = r"^(?:(?:template ?<(?:[^<>]|<(?:[^<>]|<[^<>]*+>)*+>)*+>|export) ?)+"
_MODIFIERS = r"^(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|file|new|unsafe|typedef|inline|constexpr|virtual|override|async|extern|friend|required) )*"
#: A type: its word and its name; all that may follow it; what may follow a record.
_TYPED = rf"{_MODIFIERS}(class|struct|interface|record|enum)(?: (?:class|struct))?(?: (?:\[\[.*?\]\]|alignas ?\([^()]*\)))*(?: ({_NAME}(?:::{_NAME})*))?"
_TYPE = rf"{_TYPED}(?: ?<.*>)?(?: final)?(?: ?:(?!:).*| where .*)?$"
_RECORD = rf"{_TYPED}{_GENERIC} ?{_ROUND}(?: ?:.*| where .*)?$"
_SPACE = r"^(?:inline )?namespace(?: ([\w:.]+))?$"
#: What follows a function's arguments: qualifiers, a trailing type, initialisers, constraints, or an expression.
_TAIL = r"(?: ?(?:const|volatile|override|final|noexcept(?: ?\([^()]*\))?|mutable|&&?|try)\b)* ?(?: ?->.*| ?:(?!:).*| where .*| ?=>.*)?$"
#: What may stand before a function's name, and the name with what qualifies it (of several arguments in <> the first begin, the last end).
_BEFORE = rf"^(?!(?:{_CONTROL})\b)(?:[^()=]*?[\s*&>\]])?"
_QUALIFIED = rf"(?:{_NAME}<[^()]*>::(?:{_NAME}::)*)?"
_NAMED = rf"((?:{_NAME}::)*{{}}~?{_NAME}|(?:{_NAME}::)*operator ?[^\s(]+)"
_CALL = rf"{_BEFORE}{_NAMED.format(_QUALIFIED)}{_GENERIC} ?{_ROUND}{_TAIL}"
_CALLED = rf"(^|::)(?:{_CONTROL})$"
_WORDS = r"^(?:else|do|try|return|throw|new|await|goto|case|delete)\b"
_SHORT = r"\) ?(?:where .*)?=>"
NOWHERE = "<anonymous>"
FOUND = "file_path string, language string, symbol_kind string, symbol_name string, start_line int, end_line int"


def lexed(lines: DataFrame) -> DataFrame:
    """lines (file_path, pos, line) with code: the line without comments, strings, characters and preprocessor lines, each blanked by a space."""
    rests = [F.col("line"), *[F.when(F.col("line").rlike(e), F.regexp_replace("line", e, "")) for e in _ENDS]]
    codes = [F.regexp_replace(r, _GONE, " $1$2$3") for r in rests]

    def after(state: int) -> Column:
        out = F.lit(0)
        for k, mark in reversed([*enumerate(_OPEN, 1)]):
            out = F.when(codes[state].endswith(mark), F.lit(k)).otherwise(out)
        return F.coalesce(F.when(codes[state].isNull(), F.lit(state)).otherwise(out), F.lit(state))

    plain = ~F.col("line").rlike("""[/*"'@]""")
    identity = F.array(*map(F.lit, range(4)))
    table = F.when(plain | F.col("line").isNull(), identity).otherwise(F.array(*map(after, range(4))))
    # Only lines that change some state take part; their texts stay behind.
    steps = lines.select("file_path", "pos", table.alias("t")).filter(F.col("t") != identity)
    moved = steps.groupBy("file_path", F.floor((F.col("pos") - 1) / LEXED).alias("lexed")).agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("steps"))
    moved = written(moved.withColumn("t", F.expr("aggregate(steps, array(0, 1, 2, 3), (s, x) -> transform(s, k -> x.t[k]))")))
    fold = "aggregate({0}, struct(CAST({1} AS int) AS s, CAST(array() AS array<struct<k:bigint,s:int>>) AS out), (a, x) -> struct(x.t[a.s] AS s, concat(a.out, array(struct(CAST(x.{2} AS bigint) AS k, {3} AS s))) AS out), a -> a.out)"
    blocks = moved.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("lexed", "t"))).alias("blocks"))
    starts = blocks.select("file_path", F.explode(F.expr(fold.format("blocks", "0", "lexed", "a.s"))).alias("x")).select("file_path", F.col("x.k").alias("lexed"), F.col("x.s").alias("start"))
    states = moved.join(starts, ["file_path", "lexed"]).select("file_path", F.explode(F.expr(fold.format("steps", "start", "pos", "x.t[a.s]"))).alias("x")).select("file_path", F.col("x.k").cast("int").alias("from"), F.col("x.s").alias("state"))
    # Lines that begin in another state than code: after such a change, up to the next one.
    last = lines.groupBy("file_path").agg(F.max("pos").alias("last"))
    until = states.withColumn("next", F.lead("from").over(Window.partitionBy("file_path").orderBy("from"))).filter("state > 0").join(last, "file_path")
    until = until.withColumn("to", F.coalesce("next", "last")).filter(F.col("from") < F.col("to"))
    inside = until.select("file_path", F.explode(F.sequence(F.col("from") + 1, F.col("to"))).alias("pos"), "state")
    placed = lines.join(inside, ["file_path", "pos"], "left")
    state = F.coalesce("state", F.lit(0))
    code = F.lit("")
    for k in range(4):
        code = F.when(state == k, F.coalesce(codes[k], F.lit(""))).otherwise(code)
    code = F.when((state == 0) & F.col("line").rlike(r"^\s*#"), F.lit("")).otherwise(F.regexp_replace(code, r'(/\*|R"|@\$?")$', ""))
    return placed.select(*lines.columns, code.alias("code"))


def statements(code: DataFrame) -> DataFrame:
    """(file_path, number, start_line, pos, i, mark, text, level, close) of code (file_path, pos, code): statements up to ; or a brace, with the level inside and, of openers, the line that closes them."""
    here = ["file_path", "block"]
    pieces = code.select("file_path", block_of(F.col("pos")).alias("block"), "pos", F.posexplode(F.regexp_extract_all("code", F.lit("[^;{}]*[;{}]|[^;{}]+"), F.lit(0))).alias("i", "piece"))
    mark = F.when(F.col("piece").rlike("[;{}]$"), F.right("piece", F.lit(1)))
    pieces = written(pieces.withColumn("mark", mark))  # lexed once: counted, put together and matched
    order = Window.partitionBy(*here).orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy(*here).agg(F.count("mark").alias("n"))
    counts = counts.select(*here, F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = pieces.withColumn("n", F.count("mark").over(order)).join(counts, here).withColumn("number", F.col("n") + F.col("earlier"))
    first = F.min(F.when(F.col("piece").rlike(r"[^\s;{}]"), F.col("pos")))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "i", "piece"))), lambda x: x["piece"]), " ")
    texts = numbered.groupBy("file_path", "number").agg(first.alias("start_line"), told.alias("text"))
    steps = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)
    levels = matched(numbered.filter("mark IS NOT NULL").select(*here, "pos", "i", steps.alias("step"), "number", "mark"))
    close = F.when(F.col("next.step") < 0, F.col("next.pos"))
    levels = levels.select("file_path", "number", "pos", "i", "mark", "level", close.alias("close"), F.when(F.col("next.step") < 0, F.col("next.i")).alias("close_i"))
    return levels.join(texts, ["file_path", "number"])


def _declared(language: Column) -> Column:
    """kind and name that a statement's text may declare; methods and constructors are functions here."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"[;{} ]+$", ""), _ACCESS, ""))
    head = F.regexp_replace(text, _TEMPLATE, "")
    sharp = language == "csharp"
    kind = F.regexp_extract(head, _TYPED, 1)
    named = F.regexp_extract(head, _TYPED, 2)
    is_type = head.rlike(_TYPE) | (sharp & (kind == "record") & head.rlike(_RECORD))
    function = F.regexp_extract(head, _CALL, 1)
    is_function = head.rlike(_CALL) & ~function.rlike(_CALLED) & ~head.rlike(_WORDS)
    # Without a brace: a namespace of a whole file, a record, a method that is an expression.
    ended = F.col("mark") == ";"
    short = sharp & (head.rlike(_SPACE) | ((kind == "record") & is_type) | (is_function & head.rlike(_SHORT)))
    pick = lambda k, n: F.struct(k.alias("kind"), n.alias("name"))
    filled = lambda n: F.when(n == "", NOWHERE).otherwise(n)
    found = F.when(head.rlike(_SPACE), pick(F.lit("namespace"), filled(F.regexp_extract(head, _SPACE, 1))))
    found = found.when(is_type & (kind != "") & ((named != "") | sharp), pick(kind, filled(named))).when(is_function, pick(F.lit("function"), F.regexp_replace(function, " ", "")))
    return F.when((F.col("mark") == "{") | (ended & short), found)


def _expression(pattern: str) -> re.Pattern[str]:
    """A pattern as Spark reads it: classes hold ASCII alone, bounds of words don't."""
    return re.compile("(?a:" + pattern.replace(r"\b", r"(?u:\b)") + ")")


_E = {p: _expression(p) for p in (r"\s+", r"\S", _ACCESS, _TEMPLATE, _TYPED, _TYPE, _RECORD, _SPACE, _CALLED, _WORDS, _SHORT)}
_ARGUMENTS = _expression(_ROUND + _TAIL)
#: What stands before a function's arguments: without <> that matter, with some that qualify, with some of its own.
_LEADS = [_expression(_BEFORE + _NAMED.format(q) + g + " ?") for q, g in (("", ""), (_QUALIFIED, ""), (_QUALIFIED, _GENERIC))]
_QUALIFIES = _expression(rf">::(?:{_NAME}::)*~?{_NAME} ?$")


def _function(head: str) -> str | None:
    """The name that _CALL finds. Its arguments begin at the first bracket; <> before it are looked into only where they come to something, else each would be followed to its end."""
    at = head.find("(")
    if at < 0 or not _ARGUMENTS.match(head, at):
        return None
    before = head[:at]
    lead = _LEADS[2 if before.rstrip(" ").endswith(">") else 1 if _QUALIFIES.search(before) else 0].fullmatch(before)
    return lead and lead[1]


def _told(text: str, sharp: bool) -> tuple[str, str] | None:
    """_declared() of one statement, its mark at the end."""
    ended = text[-1] == ";"
    text = _E[_ACCESS].sub("", _E[r"\s+"].sub(" ", text).rstrip(";{} ")).strip(" ")
    head = _E[_TEMPLATE].sub("", text)
    typed = _E[_TYPED].match(head)
    kind, named = (typed[1], typed[2] or "") if typed else ("", "")
    space = _E[_SPACE].match(head)
    is_type = kind != "" and bool(_E[_TYPE].match(head) or sharp and kind == "record" and _E[_RECORD].match(head))
    function = _function(head)
    if function is not None and (_E[_CALLED].search(function) or _E[_WORDS].match(head)):
        function = None
    if ended and not (sharp and (space or kind == "record" and is_type or function is not None and _E[_SHORT].search(head))):
        return None
    if space:
        return "namespace", space[1] or NOWHERE
    if is_type and (named or sharp):
        return kind, named or NOWHERE
    return None if function is None else ("function", function.replace(" ", ""))


_remembered = lru_cache(maxsize=1 << 16)(_told)


def declared(text: str, sharp: bool) -> list[tuple[str, str, int, int]]:
    """(kind, name, start_line, end_line) of one C# or else C++ source, in one pass from its beginning to its end."""
    text = "\n" + text  # each line has its end before it
    found: list[list] = []
    open_: list[tuple[str | None, str | None, int | None]] = []  # kind, name and place among those found of each brace that is open
    parts: list[tuple[int, int]] = []  # code of the statement so far, which goes on from at
    at = line = counted = 0

    def line_of(place: int) -> int:
        nonlocal line, counted
        line, counted = line + text.count("\n", counted, place), place
        return line

    for stop in _STOPS.finditer(text):
        start, mark = stop.start(), text[stop.start()]
        if mark not in ";{}":
            if start > at:
                parts.append((at, start))
            end = stop.end()
            if mark == "\n" and start >= at and (end := text.find("\n", end)) < 0:
                end = len(text)
            at = max(at, end)
        elif start >= at:  # not on a preprocessor line
            parts.append((at, start))
            told = None
            if mark == "{" or mark == ";" and sharp:
                code = " ".join([text[a:b] for a, b in parts]) + mark
                told = (_remembered if len(code) <= SHORT else _told)(code, sharp)
            place = None
            if told:
                kind, name = told
                around, type_ = open_[-1][:2] if open_ else ("namespace", None)
                if kind == "function" and around in TYPES:
                    kind = "constructor" if sharp and name == type_ else "method"
                    name = name if sharp or "::" in name else f"{type_}::{name}"
                if around == "namespace" or around in TYPES:
                    first = next((m.start() for a, b in parts if (m := _E[r"\S"].search(text, a, b))), start)
                    place = len(found)
                    found.append([kind, name, line_of(first), line_of(start) if mark == ";" and kind != "namespace" else None])
            if mark == "{":
                open_.append((*(told or (None, None)), place))
            elif mark == "}" and open_ and (place := open_.pop()[2]) is not None:
                found[place][3] = line_of(start)
            parts, at = [], start + 1
    last = line_of(len(text))
    return [(kind, name, first, last if end is None else end) for kind, name, first, end in found]


def declarations(files: DataFrame) -> DataFrame:
    """(file_path, language, symbol_kind, symbol_name, start_line, end_line) of C++ and C# files (file_path, language, text).

    Kinds: namespace, class, struct, interface, record, enum, function, method, constructor. A C++ method has the name
    of the innermost type it stands in before it (Type::name); a C# one its own, and a constructor that of its type.
    Only what stands at the top, in a namespace or in a type is declared: blocks inside functions are not. Signatures may
    span lines; braces in strings and comments don't count. An unclosed block ends with the file. Raw strings with a
    delimiter and braces in a constructor's initialisers are not known. Null texts give nothing.
    Each file is read within the task that holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sharp, found, rows = [x == "csharp" for x in part.column(1).to_pylist()], [], []
                for i, text in enumerate(part.column(2)):
                    if text.is_valid:
                        found += (here := declared(text.as_py().decode("utf-8", "replace"), sharp[i]))
                        rows += [i] * len(here)
                told = list(zip(*found, strict=True)) or [()] * 4
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *map(pa.array, told, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    # Bytes, since a text that is not quite UTF-8 is read all the same.
    return files.filter(F.col("language").isin("cpp", "csharp")).select("file_path", "language", F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


def declarations_of_lines(lines: DataFrame) -> DataFrame:
    """The same of files that come as lines (file_path, language, pos from 1, line), by joins: no file is one task."""
    lines = lines.filter(F.col("language").isin("cpp", "csharp"))
    last = lines.groupBy("file_path").agg(F.first("language").alias("language"), F.max("pos").alias("last"))
    rows = statements(lexed(lines.select("file_path", "pos", "line"))).filter("mark IN ('{', ';')").join(last, "file_path").withColumn("d", _declared(F.col("language")))
    # Around a statement stands the last opener before it one level up, if that is still open.
    opener = F.struct("number", "close", "close_i", F.col("d.kind").alias("kind"), F.col("d.name").alias("name"))
    asks = rows.filter("d IS NOT NULL").select("file_path", (F.col("level") - 1).alias("key"), "number", "pos", "i", "start_line", "close", "mark", "d", "language", "last", F.lit(None).cast("struct<number:bigint,close:int,close_i:int,kind:string,name:string>").alias("opener"))
    tells = rows.filter("mark = '{'").select("file_path", F.col("level").alias("key"), "number", "pos", "i", "start_line", "close", "mark", "d", "language", "last", opener.cast("struct<number:bigint,close:int,close_i:int,kind:string,name:string>").alias("opener"))
    before = Window.partitionBy("file_path", "key").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = asks.withColumn("asks", F.lit(True)).union(tells.withColumn("asks", F.lit(False))).withColumn("around", F.last("opener", ignorenulls=True).over(before)).filter("asks")
    around = F.when(F.col("around.close").isNull() | (F.struct(F.col("around.close").alias("pos"), F.col("around.close_i").alias("i")) >= F.struct("pos", "i")), F.col("around"))
    placed = placed.withColumn("around", around)
    in_type, kind, name = F.coalesce(F.col("around.kind").isin(*TYPES), F.lit(False)), F.col("d.kind"), F.col("d.name")
    free = F.col("around").isNull() | F.coalesce(F.col("around.kind").isin("namespace", *TYPES), F.lit(False))
    function = kind == "function"
    maker = function & (F.col("language") == "csharp") & in_type & (name == F.col("around.name"))
    new_kind = F.when(maker, "constructor").when(function & in_type, "method").otherwise(kind)
    new_name = F.when(function & in_type & (F.col("language") == "cpp") & ~name.contains("::"), F.concat("around.name", F.lit("::"), name)).otherwise(name)
    end = F.when(F.col("mark") == ";", F.col("pos")).otherwise(F.coalesce("close", "last"))
    whole = (F.col("mark") == ";") & (kind == "namespace")
    return placed.filter(free).select("file_path", "language", new_kind.alias("symbol_kind"), new_name.alias("symbol_name"), F.coalesce("start_line", "pos").alias("start_line"), F.when(whole, F.col("last")).otherwise(end).cast("int").alias("end_line"))
