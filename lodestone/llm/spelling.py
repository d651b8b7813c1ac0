"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes a word's vector of letter counts by 1 in at most one count upwards and
one downwards (an L1 distance of 1 or 2). Words of one length are the points of a tree; the words of that length and of
the length below it search it, each in the box of vectors that one edit can reach. The upper levels of each tree cut
the words into cells of bounded size, one task each: a word lies in one cell and asks in those alone that its box
meets. Within a cell the tree goes on; a node is left out if the box around its points is too far from a query's
vector. What the leaves leave over is compared letter by letter.

Only where cells are cut comes from a sample; which words are found near does not depend on it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import cut

#: Counts of a to z stand for themselves; other letters share the rest by code point, which only widens the boxes.
LETTERS = 96
#: A cell holds about so many points of 16 letters (fewer of longer words), a leaf so many.
CELL, LEAF = 12_000, 48
#: At most about so many words, by a hash, tell where cells are cut, and each cell is told by so many of them at least.
SAMPLE, TOLD = 400_000, 40
#: Candidates are compared so many letters at a time.
COMPARED = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


def letter_runs(text: Column) -> Column:
    """Maximal runs of A-Z, a-z and the letters from U+00C0 to U+00FF, A-Z lower-cased; null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))


def without(word: Column, at: Column) -> Column:
    """word without its code point number at (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors (words, LETTERS)."""
    slot = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % (LETTERS - 26)).astype(np.int64)
    flat = np.bincount((np.arange(len(codes))[:, None] * LETTERS + slot).ravel(), minlength=len(codes) * LETTERS)
    return np.minimum(flat, 2**15 - 1).astype(np.int16).reshape(len(codes), LETTERS)


def marks_of(counts: np.ndarray) -> np.ndarray:
    """Vectors as 128 bits, one per letter and level of its count, some shared: what one count exceeds another by is at least the number of bits it has alone."""
    out = np.zeros((len(counts), 128), bool)
    for level in range(1, min(6, int(counts.max(initial=0))) + 1):
        row, letter = np.nonzero(counts >= level)
        out[row, np.where((letter < 26) & (level < 4), letter + 26 * (level - 1), 78 + (letter + 26 * level) % 50)] = True
    return np.packbits(out, axis=1).view(_U)


def _bits(marks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks).sum(axis=-1, dtype=np.int16)


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that halve the points best: those with at most so many of it go left. None if all are equal."""
    best, found = 0, None
    for level in range(int(counts.max(initial=0))):
        left = (counts <= level).sum(axis=0)
        smaller = np.minimum(left, len(counts) - left)
        at = int(np.argmax(smaller))
        if smaller[at] > best:
            best, found = int(smaller[at]), (at, level)
            if 3 * best >= len(counts):
                break
    return found


@dataclass
class Node:
    """A k-d tree's node; a leaf has no children. points: of a leaf; box: bits that all of its points have, and that any has."""

    letter: int = 0
    level: int = 0
    left: Node | None = None
    right: Node | None = None
    cell: int = 0
    points: np.ndarray | None = None
    box: tuple[np.ndarray, np.ndarray] | None = None


def grow(counts: np.ndarray, leaf: float, points: np.ndarray | None = None, marks: np.ndarray | None = None) -> Node:
    """A tree of the vectors, halved until a leaf has at most so many points or they are all equal."""
    points = np.arange(len(counts)) if points is None else points
    own = counts[points]
    box = None if marks is None else (np.bitwise_and.reduce(marks[points], axis=0), np.bitwise_or.reduce(marks[points], axis=0))
    halves = _split(own) if len(points) > leaf else None
    if halves is None:
        return Node(points=points, box=box)
    letter, level = halves
    low = own[:, letter] <= level
    return Node(letter, level, grow(counts, leaf, points[low], marks), grow(counts, leaf, points[~low], marks), box=box)


def leaves(node: Node) -> Iterator[Node]:
    if node.left is None:
        yield node
    else:
        yield from leaves(node.left)
        yield from leaves(node.right)


def search(node: Node, counts: np.ndarray, up: int, down: int, marks: np.ndarray | None = None) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, queries) for each leaf that may hold a vector with up counts more and down counts fewer by 1 than a query's, at most."""
    todo = [(node, np.arange(len(counts)), np.full(len(counts), up, np.int8), np.full(len(counts), down, np.int8))]
    while todo:
        node, at, more, less = todo.pop()
        if node.box is not None and len(at):
            own = marks[at]
            near = (_bits(node.box[0] & ~own) <= up) & (_bits(own & ~node.box[1]) <= down)
            at, more, less = at[near], more[near], less[near]
        if not len(at):
            continue
        if node.left is None:
            yield node, at
            continue
        value = counts[at, node.letter]
        to_left = (value <= node.level) | ((value == node.level + 1) & (less > 0))
        to_right = (value > node.level) | ((value == node.level) & (more > 0))
        todo.append((node.left, at[to_left], more[to_left], less[to_left] - (value[to_left] > node.level)))
        todo.append((node.right, at[to_right], more[to_right] - (value[to_right] <= node.level), less[to_right]))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by exactly one replaced one, or (b one longer) by one inserted."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= n


def near_pairs(points: list[str], queries: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) numbers of all pairs one edit apart. points are of one length, queries of that or the length below."""
    codes, asked = codes_of(points), codes_of(queries)
    counts, wanted = counts_of(codes), counts_of(asked)
    marks, own = marks_of(counts), marks_of(wanted)
    up, down = 1, int(len(points[0]) == len(queries[0]))
    rows = max(1, COMPARED // codes.shape[1])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def compared() -> tuple[np.ndarray, np.ndarray]:
        q, p = (np.concatenate(x) for x in zip(*held, strict=True))
        ok = np.concatenate([one_edit(asked[q[i : i + rows]], codes[p[i : i + rows]]) for i in range(0, len(q), rows)])
        return q[ok], p[ok]

    for leaf, at in search(grow(counts, LEAF, marks=marks), wanted, up, down, own):
        for part in np.split(leaf.points, range(LEAF, len(leaf.points), LEAF)):  # a leaf of equal vectors may be large
            there = marks[part]
            for i in range(0, len(at), 8192):
                here = own[at[i : i + 8192]]
                close = (_bits(there[None] & ~here[:, None]) <= up) & (_bits(here[:, None] & ~there[None]) <= down)
                q, p = np.nonzero(close)
                if len(q):
                    held.append((at[i + q], part[p]))
                    size += len(q)
                if size > rows:
                    yield compared()
                    held, size = [], 0
    if held:
        yield compared()


def _cells(sampled: list[tuple[str, int]], share: float) -> dict[int, Node]:
    """By length, the tree whose leaves are cells, from a share of the words."""
    by_length = defaultdict(list)
    for word, length in sampled:
        by_length[length].append(word)
    out, n = {}, 0
    for length, words in sorted(by_length.items()):
        tree = grow(counts_of(codes_of(sorted(words))), max(TOLD, CELL * 16 / max(16, length) * share))
        for leaf in leaves(tree):
            leaf.points, leaf.cell, n = None, n, n + 1
        out[length] = tree
    return out


def _placed(words: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """(cell, role, word, n): role 0 as a point of its cell; 1 and 2 as a query of points of its length and of the next. Lengths without a tree have one cell."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = np.array(batch.column(0).to_pylist(), object)
            length = np.array([len(w) for w in all_], np.int64)
            cells, roles, rows = [], [], []
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                counts = counts_of(codes_of(list(all_[at])))
                for role, tree_of, up, down in ((0, size, 0, 0), (1, size, 1, 1), (2, size + 1, 1, 0)):
                    tree = shared.value.get(int(tree_of)) or Node(cell=-int(tree_of))
                    for leaf, who in search(tree, counts, up, down):
                        cells.append(np.full(len(who), leaf.cell, np.int64))
                        roles.append(np.full(len(who), role, np.int8))
                        rows.append(at[who])
            if rows:
                taken = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(roles)), *taken.columns], ["cell", "role", "word", "n"])

    return words.mapInArrow(run, "cell long, role byte, word string, n long")


def _found(table: pa.Table) -> pa.Table:
    """Of one cell: (word, n_near, form_n, form) of each word with near ones here, form the best of these."""
    role, n = table.column("role").to_numpy(), table.column("n").to_numpy()
    words = np.array(table.column("word").to_pylist(), object)
    of = [np.flatnonzero(role == r) for r in range(3)]
    place = pc.rank(table.column("word").combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)  # by code points, one number for a word in several roles
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for asked in (1, 2):
        if len(of[0]) and len(of[asked]):
            for q, p in near_pairs(list(words[of[0]]), list(words[of[asked]])):
                left.append(of[asked][q])
                right.append(of[0][p])
                if asked == 2:  # queries of the same length are found from both sides
                    left.append(of[0][p])
                    right.append(of[asked][q])
    a, b = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((place[b], -n[b], place[a]))
    first = np.flatnonzero(np.diff(place[a][order], prepend=-1))
    sizes = np.diff(np.append(first, len(order)))
    best = order[first]
    return pa.table({"word": pa.array(words[a[best]], pa.string()), "n_near": pa.array(sizes, pa.int64()), "form_n": pa.array(n[b[best]], pa.int64()), "form": pa.array(words[b[best]], pa.string())})


def group(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of words (word, n: how often it occurs), each word once.

    n_near counts the words one edit apart (0 without any); form is the one of largest n (ties: smallest in code-point
    order) if that is at least factor times the word's own, else null; root is where forms lead in the end, the word
    itself without one. Rows with a null or empty word, or a null n, are left out; rows of one word are summed;
    an empty table gives an empty one.
    """
    words = cut(words.filter("word <> ''").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum(F.col("n").cast("long")).alias("n")).filter("n IS NOT NULL"))
    total = words.count()
    share = min(1.0, SAMPLE / max(1, total))
    sampled = words.filter(F.xxhash64("word") <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))).select("word", F.length("word").alias("length"))
    trees = _cells([(r.word, r.length) for r in sampled.collect()], share)
    placed = _placed(words, trees)
    found = placed.groupBy("cell").applyInArrow(_found, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("x"), "form")).alias("b")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    has = F.col("b").isNotNull() & (-F.col("b.x") >= factor * F.col("n"))
    formed = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("b.form")).alias("form"), F.when(has, -F.col("b.x")).alias("form_n")))
    roots = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # forms grow by a factor each step, so chains are short, and each round halves them
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return formed.join(roots.drop("moved"), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
