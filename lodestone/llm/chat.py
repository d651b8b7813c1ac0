"""Chat formatting with a loss mask aligned by offsets.

Conversations are dealt by ranges of (conversation, turn) and rendered in that order, whole or in segments that end
with a turn: a conversation is cut only where a range or SEGMENT ends, so one that holds most rows is many segments of
several tasks. Marks of turns are tokens of their own, so the segments' ids one after another are the whole's. Each
segment is encoded once; the tokens' lengths give their byte offsets, and sorted spans of trained texts meet sorted
spans of tokens by binary search.

A text can't forge a mark: in "<|", with any backslashes between, one more backslash is put before the bar, which
unescape() takes out again. In roles, backslashes and line breaks are escaped besides.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learnt.
TRAINED = "assistant"
#: A segment ends with the turn that passes so many characters.
SEGMENT = 1_000_000
#: Rows leave a task in batches of about so many characters.
BATCH = 2_000_000
FORMATTED = "conv_id long, segment long, whole boolean, n_turns long, formatted string, ids array<int>, ends array<int>, learnt array<boolean>"
_PARTS = "conv_id long, segment long, whole boolean, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    """One turn as the template has it."""
    return f"{OPEN}{_role(role)}\n{escape(text)}{CLOSE}\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted segment."""
    out = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, text = turn.partition("\n")
        out.append((_plain_role(role), unescape(text.removesuffix(f"{CLOSE}\n"))))
    return out


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    """The byte-level BPE with the two marks as tokens, and the bytes of each token."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    first = len(ranks) + 1  # the id between is the vocabulary's own end of text, which a text can't hold unescaped
    encoder = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={OPEN: first, CLOSE: first + 1})
    lengths = np.zeros(first + 2, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    lengths[first:] = len(OPEN), len(CLOSE)
    return encoder, lengths


def masked(ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token meets a span. ends: of the tokens, which follow each other from 0; spans: rows of (start, end), sorted, apart."""
    starts = np.concatenate([[0], ends[:-1]])
    filled = spans[spans[:, 1] > spans[:, 0]]
    if not len(filled):
        return np.zeros(len(ends), bool)
    next_ = np.searchsorted(filled[:, 1], starts, side="right")  # the first span that ends after the token's start
    return (next_ < len(filled)) & (filled[np.minimum(next_, len(filled) - 1), 0] < ends)


def encode(turns: list[tuple[str, str]], ranks_path: str | None = None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(formatted, ids, ends in bytes, learnt) of turns (role, text)."""
    encoder, lengths = _encoder(ranks_path)
    parts, spans, at = [], [], 0
    for role, text in turns:
        parts.append(render(role, text))
        size = len(parts[-1].encode())
        if role == TRAINED:
            end = at + size - len(CLOSE) - 1
            spans.append((at + len(OPEN) + len(_role(role).encode()) + 1, end))
        at += size
    formatted = "".join(parts)
    ids = encoder.encode_to_numpy(formatted, allowed_special="all").astype(np.int64)
    ends = np.cumsum(lengths[ids])
    return formatted, ids, ends, masked(ends, np.array(spans, np.int64).reshape(-1, 2))


def learnt_texts(formatted: str, ends: np.ndarray, learnt: np.ndarray) -> list[str]:
    """The texts under the mask, unescaped: one for each run of learnt tokens."""
    raw = formatted.encode()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], learnt, [False]]).astype(np.int8)))
    starts = np.concatenate([[0], ends])
    return [unescape(raw[starts[a] : starts[b]].decode()) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def format_chats(rows: DataFrame, ranks_path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, whole, n_turns, formatted, ids, ends, learnt) of rows (conv_id, turn, role, text).

    Turns go by turn, ties by role, then text; nulls come first, a null role or text is empty, rows without conv_id are
    one conversation. A conversation's segments rise with their number; whole marks one that is all of its conversation
    (and is never wrongly set). Segments are sorted within a partition. learnt marks the tokens of texts of role
    "assistant". Repeated rows stay; other columns are left out; an empty table gives none.
    """
    order = ["conv_id", "turn", "role", "text"]
    chosen = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = chosen.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        held, size = 0, 0
        turns: list[tuple[str, str]] = []
        current, started, cut = None, False, True  # the first conversation may have begun in another task

        def close(whole: bool) -> None:
            nonlocal number, turns, size, held
            if turns:
                formatted, ids, ends, learnt = encode(turns, ranks_path)
                out.append((current, number, whole, len(turns), formatted, ids.astype(np.int32), ends.astype(np.int32), learnt))
                held += len(formatted)
            number, turns, size = number + 1, [], 0

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            names = [c.split()[0] for c in FORMATTED.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            held = 0
            return made

        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if started and conv != current:
                    close(not cut)
                    cut = False
                elif size > segment:
                    cut = True
                    close(False)
                current, started = conv, True
                turns.append((role, text.as_py()))
                size += len(turns[-1][1])
                if held > BATCH:
                    yield batch_of()
        close(False)  # the last may go on in another task
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from format_chats()'s rows.

    turns_sha256 is of role, line break, text, line break for each turn; loss_sha256 of all text under the mask.
    Whole conversations are digested where they lie; only the segments of others move, and are hashed one after
    another as they come, so a conversation's size costs no memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                conv, segment, whole, n, text = (batch.column(i)[row].as_py() for i in range(5))
                ends, learnt = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (6, 7))
                told = turns_of(text)
                turns = "".join(f"{r}\n{t}\n" for r, t in told).encode()
                loss = "".join(learnt_texts(text, ends, learnt))
                loss_bytes = loss.encode()
                if whole:
                    turns, loss_bytes = (hashlib.sha256(x).digest() for x in (turns, loss_bytes))
                out.append((conv, segment, whole, len(told), turns, loss_bytes, len(loss), len(text)))
            if out:
                yield _batch(out, _PARTS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
        started, current, sums, hashes = False, None, [0, 0, 0], []
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                conv, _, whole, n, turns, loss, chars, all_ = (batch.column(i)[row].as_py() for i in range(8))
                if started and (whole or conv != current):
                    out.append((current, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]))
                    started = False
                if whole:
                    out.append((conv, n, turns.hex(), chars, loss.hex(), all_))
                    continue
                if not started:
                    started, current, sums, hashes = True, conv, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
                sums = [sums[0] + n, sums[1] + chars, sums[2] + all_]
                hashes[0].update(turns)
                hashes[1].update(loss)
            if out:
                yield _batch(out, schema)
        if started:
            yield _batch([(current, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2])], schema)

    parts = formatted.mapInArrow(read, _PARTS)
    n = partitions(formatted.sparkSession)
    placed = parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "segment")
    return placed.mapInArrow(join, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])
