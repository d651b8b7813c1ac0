"""Words and rolling hashes of whole Arrow batches with numpy, for operators whose hashes Spark's functions can't express.

Every function takes whole texts. A batch is sliced between rows into chunks of about CHUNK_BYTES; of a longer text, bytes
are hashed in slices that end between words, so what a text takes beside itself is some 40 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 500_000

_U = np.uint64
_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=_U)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
# Odd, so that they have an inverse modulo 2**64; 3 modulo 8, so that powers differ in low bits too.
_BASES = [(int(b) & ~7) | 3 for b in _RNG.integers(2**40, 2**63, 2, dtype=_U)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: For terms: whatever is no ASCII letter and no byte of a longer code point.
NO_LETTERS = np.ones(256, bool)
NO_LETTERS[65:91] = NO_LETTERS[97:123] = NO_LETTERS[128:] = False


def word_list(text: Column) -> Column:
    """The words of a text as an array, null text as none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words."""
    return F.size(word_list(text)).cast("long")


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES) + 1
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(size, base, _U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        have = _POWERS[which] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """Words of several texts, one after another."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    hashes: np.ndarray  # 64 bits of each word
    heads: list[np.ndarray]  # for each size asked for: of the first bytes of words longer than that, unlike that of a word of just these bytes
    longer: list[np.ndarray]  # and the places of these words
    first: np.ndarray  # index of each text's first word; one more entry at the end

    def grams(self, k: int, base: int = 1) -> np.ndarray:
        """Hash of words i to i + k - 1 for each i with i + k <= all words; a caller drops those that cross texts."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, _U)
        p, inv = _powers(base, n + 1)
        sums = np.concatenate([[_U(0)], np.cumsum(self.hashes * p[:n], dtype=_U)])
        return mix((sums[k:] - sums[: n - k + 1]) * inv[: n - k + 1])

    def text_hash(self, base: int = 1) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        n = len(self.hashes)
        p, inv = _powers(base, n + 1)
        sums = np.concatenate([[_U(0)], np.cumsum(self.hashes * p[:n], dtype=_U)])
        a, b = self.first[:-1], self.first[1:]
        return mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(_U))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(at) > 1 else np.empty(0, np.uint8)
    return raw, at - at[0]


def _slices(raw: np.ndarray, at: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of slices of about CHUNK_BYTES, each at a separator or the end of a text, so that no word is cut."""
    a, n = 0, len(raw)
    while a < n:
        b = min(a + CHUNK_BYTES, n)
        while b < n:
            until = min(b + CHUNK_BYTES, n)
            end = at[np.searchsorted(at, b)]  # the next text begins here
            free = np.flatnonzero(separators[raw[b : min(until, end)]])
            if len(free):
                b += int(free[0])
                break
            b = min(until, int(end))
            if b == end:
                break
        yield a, b
        a = b


def words_of(column: pa.Array, fold: bool = False, separators: np.ndarray = SPACES, heads: tuple[int, ...] = ()) -> Words:
    """Splits and hashes every text; fold takes A-Z as a-z; heads: also hash the first so many bytes of longer words."""
    raw, at = texts_of(column)
    table = _FOLDED if fold else _BYTE
    parts: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, _U)]]
    firsts: list[list[np.ndarray]] = [[np.empty(0, _U)] for _ in heads]
    places: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in heads]
    done = 0
    for a, b in _slices(raw, at, separators):
        n = b - a
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~separators[raw[a:b]]
        bounds = at[(at >= a) & (at <= b)] - a
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        before[bounds] = False
        starts = np.flatnonzero(inside & ~before)
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        cut[n] = True
        ends = np.flatnonzero(inside[:n] & (~inside[1:] | cut[1:])) + 1
        p, inv = _powers(0, n + 1)
        sums = np.concatenate([[_U(0)], np.cumsum(table[raw[a:b]] * p[:n], dtype=_U)])
        parts[0].append(starts + a)
        parts[1].append(ends + a)
        parts[2].append(mix((sums[ends] - sums[starts]) * inv[starts]))
        for k, size in enumerate(heads):
            long = np.flatnonzero(ends - starts > size)
            at_ = starts[long]
            firsts[k].append(mix((sums[at_ + size] - sums[at_]) * inv[at_] + _U(size)))
            places[k].append(long + done)
        done += len(starts)
    starts, ends, hashes = (np.concatenate(x) for x in parts)
    return Words(raw, starts, ends, hashes, [np.concatenate(x) for x in firsts], [np.concatenate(x) for x in places], np.searchsorted(starts, at))


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about CHUNK_BYTES of the column each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return h.view(np.int64)
