"""MinHash near-duplicates: banded minima, signature and exact verification, connected components.

Texts with equal shingle sets become one node first. Bands of minima bring nodes into buckets; a bucket is never
expanded into its pairs. Instead each node of a bucket is compared with one leader of it, links found so far make
components, and a second round compares only nodes of different components. Of what remains (nodes that share a
bucket but no component), those drop out that can't link at all, as too few of their shingles occur in any other open
node. The others are compared in full inside the tasks, overlapping buckets together, in blocks of bounded size; what is
sent there are not their sets but how these differ from one set of the group, so near copies, which alone make large
groups, are small whatever their length, and no link between two components is missed that any band has brought
together.

A pair of similarity 0.85 misses all 20 bands of 6 minima with probability 8e-5, one of 0.9 with 3e-7; one of 0.8
misses all 24 bands of 5, which serve thresholds under 0.85, with 7e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import apart, beside, cut, small
from lodestone.llm.components import components
from lodestone.llm.words import chunks, mix, signed, words_of

SHINGLE = 5
#: One set of minima, cut into bands by the threshold (percent): 20 of 6 from 85 on, 24 of 5 below.
MINIMA = 120
LEADER_ROUNDS = 2
#: What the leaders leave is compared in blocks of about so many differing shingles (8 bytes each), COLUMNS at a time; a node counts as LEAST at least, which bounds a block's nodes (4,000).
BLOCK, COLUMNS, LEAST = 1_000_000, 2048, 250
#: A signature may lie this far below the threshold: five standard errors of 120 minima at 0.8.
SLACK = 0.19
_U = np.uint64
_RNG = np.random.default_rng(77)
_A = _RNG.integers(1, 2**64, MINIMA, dtype=_U) | _U(1)
_B = _RNG.integers(0, 2**64, MINIMA, dtype=_U)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z as a-z; a text of fewer words is one shingle, one of none has none."""
    words = words_of(column, fold=True)
    grams, whole = words.grams(size), words.text_hash()
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        yield np.unique(grams[a : b - size + 1]) if b - a >= size else whole[i : i + 1] if b > a else whole[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """One minimum per universal hash (a * x + b modulo 2**64), its upper 32 bits."""
    out = np.full(MINIMA, ~_U(0))
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[at : at + 2048, None] * _A + _B).min(axis=0), out=out)
    return (out >> _U(32)).astype(np.uint32)


def signatures(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of every row; set_a and set_b stand for the shingle set (128 bits), bands has a hash per band of so many minima."""
    n_bands = MINIMA // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n, a, b, bands = [], [], [], []
                for s in shingle_sets(part.column(1)):
                    n.append(len(s))
                    a.append(np.sum(mix(s), dtype=_U))
                    b.append(np.sum(mix(s ^ _U(0x5851F42D4C957F2D)), dtype=_U))
                    m = minima(s).astype(_U).reshape(n_bands, rows)
                    h = np.arange(n_bands, dtype=_U)
                    for column in m.T:
                        h = mix(h * _U(0x9E3779B97F4A7C15) + column)
                    bands.append(h)
                flat = signed(np.concatenate(bands)) if bands else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_bands, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(a, _U))), pa.array(signed(np.array(b, _U))), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, signature, shingles): minima as 4-byte binaries, the sorted set as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = list(shingle_sets(part.column(1)))
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([minima(s).tobytes() for s in sets], pa.binary()), lists], ["node", "signature", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "node long, signature binary, shingles array<long>")


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The sets of a column, as views of its values."""
    values, edges = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges - edges[0], edges[1:] - edges[0], strict=False)]


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least threshold percent; their signatures are compared first."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.array(same, float) >= threshold / 100 - SLACK))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_rows(batch.column(2)), _rows(batch.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def beside(pairs: DataFrame, what: str) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col(what).alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col(what).alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    likely = beside(pairs, "signature").mapInArrow(near, "a long, b long").distinct()
    return beside(likely, "shingles").mapInArrow(exact, "a long, b long").distinct()


def link(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Links join documents whose sets of 5-word shingles have 100 * intersection >= threshold * union; component_id is
    the least doc_id reachable. Null, empty and blank texts have no shingles and no links. Rows that share a doc_id
    count as one document, whatever their texts, and stay separate rows. A row without doc_id links with nothing:
    component_id is null and it is kept. An empty table gives an empty one.
    """
    rows = cut(signatures(docs, 6 if threshold >= 85 else 5))
    # A class per set; its node is the least doc_id that has it, so classes of one node are one document's.
    classes = cut(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    full = cut(banded.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select("bucket"))  # written out, so that AQE can split hot keys of the join
    buckets = full.count()
    members = cut(banded.join(small(full, buckets), "bucket").distinct())
    nodes = cut(members.select("node").distinct())
    ids = nodes.withColumnRenamed("node", "doc_id")
    sets = cut(_sets(docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")))
    named = cut(rows.drop("bands").join(classes.drop("bands"), ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    # Rows that share a doc_id hold all nodes of their classes together.
    spread = cut(named.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select("doc_id"))
    tied = named.join(small(spread), "doc_id").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = cut(components(_links(members, buckets, sets, threshold).union(tied)))
    out = named.join(small(found), "node", "left")
    own_id = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, F.lit(True)).alias("kept"))


def _open(members: DataFrame, buckets: int, labels: DataFrame | None) -> DataFrame:
    """(bucket, node, component) of the buckets that still hold more than one component. labels: (node, component) so far."""
    labelled = members.withColumn("component", F.col("node")) if labels is None else members.join(small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return cut(_mixed(labelled, buckets))


def _mixed(members: DataFrame, buckets: int) -> DataFrame:
    """The rows of members (bucket, component, others) whose bucket has more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return members.join(beside(mixed, "x", buckets).select("bucket"), "bucket")


def _links(members: DataFrame, buckets: int, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that connect all components of verified pairs within the buckets of members (bucket, node), so many counted."""
    labels = None
    for round_ in range(LEADER_ROUNDS):
        left = _open(members, buckets, labels)
        order: Column = F.struct(F.lit(0).cast("long").alias("h"), "node") if round_ == 0 else F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node")
        leaders = left.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "component")).alias("l")).select("bucket", F.col("l.o.node").alias("b"), F.col("l.component").alias("c"))
        met = left.join(beside(leaders, "b", buckets), "bucket").filter("component <> c").groupBy("node", "b").agg(F.count("*").alias("n"))
        # Each node meets the leader that it shares most buckets with.
        pairs = met.groupBy("node").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select(F.greatest("node", -F.col("m.b")).alias("a"), F.least("node", -F.col("m.b")).alias("b"))
        links = _verified(cut(pairs), sets, threshold)
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = components(links)
    labels = cut(labels)
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return known.union(_by_blocks(*_linkable(_open(members, buckets, labels), buckets, sets, threshold), buckets, threshold))


def _linkable(left: DataFrame, buckets: int, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of left (bucket, node, component), the nodes that may link, with n shingles; and their sets.

    A node that links has at least threshold percent of its shingles in common with one other open node, so one of
    which more shingles are its own alone can't. A count per shingle and one per node tell; nothing is approximate.
    """
    held = cut(left.select("node").distinct().join(sets.select("node", "shingles"), "node"))
    alone = held.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    owned = alone.groupBy("node").agg(F.count("*").alias("owned"))
    # Rows that share a node (a doc_id with several texts) are judged by the sum of their sets, and so dropped no sooner.
    sizes = held.groupBy("node").agg(F.sum(F.size("shingles")).alias("n"), F.min(F.size("shingles")).alias("least"))
    kept = cut(sizes.join(owned, "node", "left").filter(f"(n - coalesce(owned, 0)) * 100 >= least * {threshold}").select("node", "n"))
    return cut(_mixed(left.join(small(kept), "node"), buckets)), held


def _groups(left: DataFrame, buckets: int) -> DataFrame:
    """(key, node, component, n): the nodes of left (bucket, node, component, n) in groups, such that nodes that share a bucket share a group.

    A node's home is the least of its buckets, a bucket's group the least home of its nodes; so overlapping buckets are
    mostly one group, and most nodes are in few groups.
    """
    home = left.groupBy("node").agg(F.min("bucket").alias("home"))
    group = left.join(apart(home, "home"), "node").groupBy("bucket").agg(F.min("home").alias("key"))
    return left.join(beside(group, "key", buckets), "bucket").select("key", "node", "component", "n").distinct()


def _differences(nodes: DataFrame, sets: DataFrame, groups: int) -> DataFrame:
    """(key, node, component, n, apart) of nodes (key, node, component, n): n shingles, and apart those that only the node or only its group's smallest set has.

    Two nodes' differences from one set tell how far they are from each other: what one has alone is in just one of the
    differences. Near copies differ in few shingles, so a group of these is small, whatever its texts' length; at worst a
    difference is twice its set.
    """
    smallest = nodes.groupBy("key").agg(F.min(F.struct("n", "node")).alias("m")).select("key", F.col("m.node").alias("node"))
    reference = smallest.join(sets, "node").groupBy("key").agg(F.min("shingles").alias("reference"))  # a doc_id may have several sets
    joined = nodes.select("key", "node", "component").join(sets, "node").join(beside(reference, "reference", groups), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, reference = (_rows(batch.column(i)) for i in (3, 4))
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(own, reference, strict=True)]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in apart])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.empty(0, np.int64), *apart])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) for x in own], pa.int64()), lists], ["key", "node", "component", "n", "apart"])

    return joined.select("key", "node", "component", "shingles", "reference").mapInArrow(run, "key long, node long, component long, n long, apart array<long>")


def _by_blocks(left: DataFrame, sets: DataFrame, buckets: int, threshold: int) -> DataFrame:
    """Links that connect the components of left (bucket, node, component, n) as all verified pairs within its groups would.

    A group is dealt by hash into blocks by the size of its differences. A task gets two blocks and counts the
    differences that each two nodes share by matrix products, which gives their exact similarity; only a spanning forest
    of the links found leaves it. One rule holds for groups of all sizes; one of several blocks is sent once a block,
    but its differences only.
    """
    nodes = cut(_groups(left, buckets))
    far = cut(_differences(nodes, sets, buckets))
    blocks = far.groupBy("key").agg(F.sum(F.greatest(F.size("apart"), F.lit(LEAST)).cast("long")).alias("all")).select("key", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = far.join(beside(blocks, "blocks", buckets), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "apart")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, node, component, n = (table.column(c).to_numpy() for c in ("own", "node", "component", "n"))
        lists = table.column("apart").chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        _, code, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(size)), size)
        common = count[code] > 1  # what one node alone differs by is shared by none
        dense = np.cumsum(count > 1) - 1
        row, code = row[common], dense[code[common]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        width = int((count > 1).sum())
        shared = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, width, COLUMNS):
            part = slice(*np.searchsorted(code, [at, at + COLUMNS]))
            has = np.zeros((len(size), min(COLUMNS, width - at)), np.float32)
            has[row[part], code[part] - at] = 1
            shared += has[a] @ has[b].T
        near = np.zeros(shared.shape, bool)
        for k in range(0, len(a), 256):
            some = a[k : k + 256, None]
            differ = size[some] + size[b] - 2 * shared[k : k + 256].astype(np.int64)
            total = n[some] + n[b]
            near[k : k + 256] = (100 * (total - differ) >= threshold * (total + differ)) & (component[some] != component[b])
        x, y = _forest(near)
        x, y = node[a[x]], node[b[y]]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a matrix of links between rows and columns, as few as connect the same ones."""
    new = [near.any(axis=1), near.any(axis=0)]
    xs: list[int] = []
    ys: list[int] = []
    for start in np.flatnonzero(new[0]):
        todo = [(0, start)] if new[0][start] else []
        new[0][start] = False
        while todo:
            side, at = todo.pop()
            met = np.flatnonzero((near[:, at] if side else near[at]) & new[1 - side])
            new[1 - side][met] = False
            todo += [(1 - side, k) for k in met]
            xs += met.tolist() if side else [int(at)] * len(met)
            ys += [int(at)] * len(met) if side else met.tolist()
    return xs, ys
