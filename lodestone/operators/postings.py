"""An inverted index for BM25: postings in classes of impact, and exact top-k that leaves classes out by their bounds.

A posting is (term, class, id, tf, dl); the class tells how much it can add to a score, so what a query needs of a term
is a range of classes. Tables lie in Parquet by buckets of terms, sorted by term, class and id: a query opens its terms'
buckets alone, and filters on term and class reach the scan. A table of heads (per term and class: how many postings,
the largest tf, the least dl) gives document frequencies and bounds without reading postings; counts of heads and of
the collection are sums, so they are updated by what goes and comes.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import query_tokens
from lodestone.operators.ranking import B, K1, all_term_counts
from lodestone.plans.lineage import BROADCAST_ROWS, cut, folder, written

BUCKETS = 64
#: Postings of one file, which a task sorts.
FILE = 500_000
#: Classes of a term; their width is of the share of a posting's highest possible part.
CLASSES = 24
#: Documents of this length count as usual in classes; only how well classes sort depends on it.
USUAL = 500.0
#: Scores are compared with bounds up to so much, since sums in another order differ in the last bits.
SLACK = 1e-7
#: Postings of candidates left over are looked up by a list of ids up to so many, else by a join.
LISTED = 2_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, id_col: str, text_col: str = "text") -> dict[str, DataFrame]:
    """The tables of an index of docs (id, text): postings (bucket, term, class, id, tf, dl), heads (bucket, term, class, n, most, least), lengths (id, dl) and totals (n, dl). Null texts have no terms; ids must be unique."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = all_term_counts(texts, "id").select("id", F.col("dl").cast("int").alias("dl"), "term", F.col("tf").cast("int").alias("tf"))
    share = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / USUAL))
    postings = written(counts.select(_bucket(F.col("term")).alias("bucket"), "term", F.floor(share * CLASSES).cast("int").alias("class"), "id", "tf", "dl"))
    known = postings.groupBy("id").agg(F.max("dl").alias("dl"))
    lengths = texts.select("id").join(known, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"))
    return {"postings": postings, "heads": heads(postings), "lengths": lengths, "totals": totals(lengths)}


def heads(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term", "class").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"))


def totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("dl"))


def update(index: dict[str, DataFrame], gone: DataFrame, fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index without the documents of gone (id) and with those of fresh (an index of its own).

    Counts change by what goes and comes; bounds of classes that lose postings stay, which is safe, until they are empty.
    """
    leaving = index["postings"].join(gone, "id", "left_semi").groupBy("bucket", "term", "class").agg((-F.count("*")).alias("n"), F.lit(None).cast("int").alias("most"), F.lit(None).cast("int").alias("least"))
    both = index["heads"].unionByName(leaving).unionByName(fresh["heads"]).groupBy("bucket", "term", "class").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"))
    parted = totals(index["lengths"].join(gone, "id", "left_semi")).select((-F.col("n")).alias("n"), (-F.col("dl")).alias("dl"))
    sums = index["totals"].unionByName(parted).unionByName(fresh["totals"]).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    kept = {name: index[name].join(gone, "id", "left_anti").unionByName(fresh[name]) for name in ("postings", "lengths")}
    return kept | {"heads": both.filter("n > 0"), "totals": sums}


def write(index: dict[str, DataFrame], path: str | None = None) -> str:
    """Writes the tables, by default in a new folder beside the checkpoints; gives the path."""
    spark = index["postings"].sparkSession
    path = path or folder(spark, "postings")
    # A bucket is as many files as it has slices of about FILE postings, by a hash of id: so a task sorts as much at any size of the corpus, also of a term that is everywhere.
    slices = -(-index["postings"].count() // (BUCKETS * FILE)) or 1
    dealt = index["postings"].repartition(BUCKETS * slices, "bucket", F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(slices))).sortWithinPartitions("bucket", "term", "class", "id")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    index["heads"].repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "class").write.partitionBy("bucket").parquet(f"{path}/heads")
    index["lengths"].write.parquet(f"{path}/lengths")
    index["totals"].write.parquet(f"{path}/totals")
    return path


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    plain = {name: spark.read.parquet(f"{path}/{name}") for name in ("lengths", "totals")}
    kind = plain["lengths"].schema["id"].dataType.simpleString()
    schemas = {"postings": f"term string, class int, id {kind}, tf int, dl int, bucket int", "heads": "term string, class int, n long, most int, least int, bucket int"}  # empty tables have no files
    return plain | {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items()}


def _limits(known: dict[str, dict[int, tuple[int, float]]], k: int) -> dict[str, int]:
    """For each term the highest classes that have k postings together."""
    out = {}
    for term, classes in known.items():
        n = 0
        for c in sorted(classes, reverse=True):
            out[term], n = c, n + classes[c][0]
            if n >= k:
                break
    return out


def _cuts(known: dict[str, dict[int, tuple[int, float]]], least: float) -> tuple[dict[str, int], dict[str, float]]:
    """From which class on each term is read, and what a posting below can add: so that all that is left out, together, stays under the least score that counts. The classes that spare most reading for what they add go first."""
    order = {t: sorted(c) for t, c in known.items()}
    at, left = dict.fromkeys(known, 0), dict.fromkeys(known, 0.0)
    while True:
        steps = []
        for t, classes in order.items():
            if at[t] < len(classes):
                n, bound = known[t][classes[at[t]]]
                more = max(bound, left[t]) - left[t]
                if sum(left.values()) + more < least - SLACK:
                    steps.append((more / n, t, max(bound, left[t])))
        if not steps:
            return {t: order[t][at[t]] if at[t] < len(order[t]) else CLASSES + 1 for t in order}, left
        _, t, left[t] = min(steps)
        at[t] += 1


def top(index: dict[str, DataFrame], query: str, k: int) -> DataFrame:
    """(id, score) of the k best documents of a read() index by BM25, ties by id: the same as scoring all of them.

    First the highest classes of each term give a score that k documents reach at least. Classes that together stay
    under it are left out; of the documents found in the others, those whose score could still reach it are completed
    from the classes left out. Documents without any term fill up what is missing with 0. The driver sees heads of the
    query's terms (CLASSES each) and the collection's totals.
    """
    spark = index["postings"].sparkSession
    weight = Counter(query_tokens(query))
    nothing = index["lengths"].select("id", F.lit(0.0).alias("score"))
    n, length = index["totals"].select("n", "dl").first()
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in weight], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    own = lambda df: df.filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(weight)))
    found = own(index["heads"]).collect() if weight and n else []
    if not found:
        return nothing.orderBy("id").limit(k)
    df = Counter()
    for r in found:
        df[r.term] += r.n
    factor = {t: weight[t] * math.log((n - d + 0.5) / (d + 0.5) + 1.0) for t, d in df.items()}
    usual = max(length / n, 1.0)
    part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / usual))
    known: dict[str, dict[int, tuple[int, float]]] = defaultdict(dict)
    for r in found:
        known[r.term][r["class"]] = (r.n, factor[r.term] * part(r.most, r.least))

    def scored(rows: DataFrame) -> DataFrame:
        by_term = F.element_at(F.create_map(*[F.lit(x) for kv in factor.items() for x in kv]), F.col("term"))
        return rows.withColumn("part", by_term * part(F.col("tf"), F.col("dl")))

    def of_classes(low: dict[str, int], high: dict[str, int] | None = None) -> DataFrame:
        wanted = F.lit(False)
        for t, c in low.items():
            wanted = wanted | ((F.col("term") == t) & (F.col("class") >= c) & (F.col("class") < (high[t] if high else CLASSES + 1)))
        return scored(own(index["postings"]).filter(wanted))

    best = of_classes(_limits(known, k)).groupBy("id").agg(F.sum("part").alias("part")).orderBy(F.desc("part")).limit(k)
    reached, least = best.agg(F.count("*"), F.min("part")).first()
    cuts, left = _cuts(known, least if reached == k else 0.0)
    missing = sum((F.when(F.array_contains("terms", t), 0.0).otherwise(x) for t, x in left.items() if x), F.lit(0.0))
    seen = of_classes(cuts).groupBy("id").agg(F.sum("part").alias("part"), F.collect_set("term").alias("terms"))
    open_ = cut(seen.filter(F.col("part") + missing >= (least if reached == k else 0.0) - SLACK).select("id", "part"))
    rest = {t: c for t, c in cuts.items() if left[t]}
    if rest:
        skipped = of_classes(dict.fromkeys(rest, -1), rest)
        count = open_.count()
        if count <= LISTED:
            ids = [r.id for r in open_.select("id").collect()]
            skipped = skipped.filter(F.col("id").isin(ids))
        else:
            skipped = skipped.join(F.broadcast(open_.select("id")) if count <= BROADCAST_ROWS else open_.select("id"), "id", "left_semi")
        open_ = open_.unionByName(skipped.select("id", "part"))
    scores = open_.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.round("score", 9).desc(), "id").limit(k)
    if reached < k:
        scores = cut(scores)
        scores = scores.union(nothing.join(F.broadcast(scores.select("id")), "id", "left_anti").orderBy("id").limit(k))
    return scores.orderBy(F.round("score", 9).desc(), "id").limit(k)
