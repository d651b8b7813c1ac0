"""Periodic runs of words, by uniting suffix classes along descending LCP.

Suffixes of a text are ordered by prefix doubling. Neighbours in that order are the edges of Kruskal's algorithm, the
longest common prefix (LCP) first: each step unites two classes of suffixes by union-find, whose positions are kept in
order. Two positions that become neighbours in a united class have just the LCP of that step; if their distance is
within it, the text between repeats, and if the word before the first does not continue the period, a run starts there.
Every run is found once, by its start and the start of its second period, with its least period: a smaller period
would have put a position between them.

Only suffixes whose LCP can make a run of the asked length and exponent are united, and only in texts that have two
such within the distance; the rest can't hold a run. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.words import Words, chunks, mix, words_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: A united class takes over a smaller one position by position up to this size, else by one merge.
SMALL = 8
#: Words of kept text are copied so many at a time.
COPIED = 200_000
_U = np.uint64


def _orders(classes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two are equal; equal ranks stand for equal words. ends: where each word's text ends."""
    n = len(classes)
    order = np.argsort(classes, kind="stable")
    same = np.concatenate([[False], classes[order][1:] == classes[order][:-1]])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank = np.empty(n, np.int32)
    rank[order] = first
    out, width = [rank], 1
    open_ = order[same | np.append(same[1:], False)]
    while len(open_):
        next_ = open_ + width
        second = np.where(next_ < ends[open_], rank[np.minimum(next_, n - 1)].astype(np.int64) + 1, 0)
        key = rank[open_].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, open_ = key[by], open_[by]
        old = rank[open_]
        place = np.arange(len(open_))
        same = np.concatenate([[False], key[1:] == key[:-1]])
        base = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(same, 0, place)) - base
        out.append(rank)
        open_ = open_[same | np.append(same[1:], False)]
        width *= 2
    return out


def _prefixes(a: np.ndarray, b: np.ndarray, orders: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of suffixes a and b (of one text)."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(orders) - 1, -1, -1):
        i, j = a + out, b + out
        inside = (i < ends[a]) & (j < ends[b])
        rank = orders[level]
        out += np.where(inside & (rank[np.where(inside, i, 0)] == rank[np.where(inside, j, 0)]), 1 << level, 0)
    return out


def _unite(positions: list[int], lcp: list[int], seeds: list[tuple[int, int, int]], min_length: int, exponent: int) -> None:
    """Kruskal over suffixes in their order; lcp[i] is that of i and i + 1. Adds (start, period, lcp) of each repetition long enough."""
    parent = list(range(len(positions)))
    held = [[p] for p in positions]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for edge in sorted(range(len(lcp)), key=lcp.__getitem__, reverse=True):
        size, a, b = lcp[edge], root(edge), root(edge + 1)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        large, small = held[a], held[b]
        last = -1
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            for i, j in ((large[at - 1] if at and large[at - 1] > last else -1, x), (x, large[at] if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]) else -1)):
                if i >= 0 and j >= 0 and size >= (exponent - 1) * (j - i) and size + j - i >= min_length:
                    seeds.append((i, j - i, size))
            last = x
        if len(small) <= SMALL:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        held[b] = []
        parent[b] = a


def runs_of(words: Words, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all texts' runs of at least min_length words and exponent (2 or more) periods, sorted by start, then period; starts count over all texts."""
    first = words.first
    sizes = np.diff(first)
    ends = np.repeat(first[1:], sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # A word of another text is another word.
    _, classes = np.unique(mix(words.hashes + text.astype(_U) * _U(0x9E3779B97F4A7C15)), return_inverse=True)
    least = min(max((exponent - 1) * d, min_length - d) for d in range(1, min_length + 1))
    none = np.empty((0, 3), np.int64)
    if len(classes) < 2:
        return none
    orders = _orders(classes, ends)
    # Suffixes that share their first words with another, up to a power of two within the least LCP.
    level = min(int(np.log2(least)), len(orders) - 1)
    by_rank = np.argsort(orders[-1], kind="stable")
    shared = orders[level][by_rank]
    twin = np.concatenate([[False], shared[1:] == shared[:-1]])
    line = by_rank[twin | np.append(twin[1:], False)]
    if len(line) < 2:
        return none
    lcp = np.where(orders[level][line[1:]] == orders[level][line[:-1]], _prefixes(line[:-1], line[1:], orders, ends), 0)
    del orders
    # Groups of suffixes that an LCP long enough joins; a seed needs two of one group within a distance.
    group = np.concatenate([[0], np.cumsum(lcp < least)])
    by_place = np.lexsort((line, group))
    gap = np.diff(line[by_place])
    gap[np.diff(group[by_place]) > 0] = 2**62 // exponent
    n = int(group[-1]) + 1
    closest, longest = np.full(n, 2**62 // exponent), np.zeros(n, np.int64)
    np.minimum.at(closest, group[by_place][1:], gap)
    np.maximum.at(longest, group[1:], np.where(lcp >= least, lcp, 0))
    wanted = np.flatnonzero((exponent - 1) * closest <= longest)
    edges = np.searchsorted(group, [wanted, wanted + 1]).T
    seeds: list[tuple[int, int, int]] = []
    for a, b in edges.tolist():
        _unite(line[a:b].tolist(), lcp[a : b - 1].tolist(), seeds, min_length, exponent)
    found = np.array(seeds, np.int64).reshape(-1, 3)
    start, period = found[:, 0], found[:, 1]
    begins = np.concatenate([first[:-1], [-1]])[np.searchsorted(first, start, side="right") - 1] == start
    before = np.maximum(start - 1, 0)
    found = found[begins | (classes[before] != classes[before + period])]
    found = np.stack([found[:, 0], found[:, 1] + found[:, 2], found[:, 1]], axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    taken = np.flatnonzero(kept)
    edges = np.searchsorted(taken, words.first)
    size = words.ends[taken] - words.starts[taken] + 1  # with a space before, but for a text's first
    heads = edges[:-1][np.diff(edges) > 0]
    lead = np.ones(len(taken), np.int64)
    lead[heads] = 0
    size -= 1 - lead
    places = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(places[-1], np.uint8)
    for a in range(0, len(taken), COPIED):
        b = min(a + COPIED, len(taken))
        at = words.starts[taken[a:b]] - lead[a:b]
        out[places[a] : places[b]] = words.data[np.repeat(at - places[a:b], size[a:b]) + np.arange(places[a], places[b])]
        out[places[a:b][lead[a:b] > 0]] = 32
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(places[edges].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs (text, others) with __n_words, __runs and __collapsed.

    __runs: an array of (start, length, period) of each run, in words from 0, sorted by start, then period. A run has its
    least period, at least min_length words and exponent periods, and no neighbouring word continues it. __collapsed: the
    words joined by single spaces, without those that any run repeats after its first period. Null, empty and blank
    texts have no words and no runs; rows and columns stay as they are. Nothing is shuffled.
    """
    at, names = docs.columns.index("text"), [*docs.columns, "__n_words", "__runs", "__collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column(at))
                found = runs_of(words, min_length, exponent)
                step = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(step, found[:, 0] + found[:, 2], 1)
                np.add.at(step, found[:, 0] + found[:, 1], -1)
                text = np.searchsorted(words.first, found[:, 0], side="right") - 1
                fields = [found[:, 0] - words.first[text], found[:, 1], found[:, 2]]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "length", "period"]))
                columns = [*part.columns, pa.array(np.diff(words.first), pa.int64()), lists, _joined(words, np.cumsum(step[:-1]) == 0)]
                yield pa.RecordBatch.from_arrays(columns, names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{types}, __n_words long, __runs array<struct<start:long,length:long,period:long>>, __collapsed string")
