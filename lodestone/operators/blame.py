"""Line authorship: summaries, carried-forward metadata, joined changes, token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.lineage import cut


def summary(blame: DataFrame, top: int = 5) -> DataFrame:
    """(what, value, lines, first_ts, last_ts) of blame (author, rev, ts): the most frequent authors and revisions, and a row of the whole span. Null and empty names don't count."""
    parts = []
    for what in ("author", "rev"):
        counts = blame.filter(F.coalesce(F.col(what), F.lit("")) != "").groupBy(F.col(what).alias("value")).agg(F.count("*").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        parts.append(counts.orderBy(F.desc("lines"), "value").limit(top).select(F.lit(what).alias("what"), "*"))
    span = blame.agg(F.lit("all").alias("what"), F.lit("").alias("value"), F.count("*").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return parts[0].union(parts[1]).union(span)


def carry_forward(lines: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Fills what a revision's first line told into its later lines."""
    seen = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})


def with_changes(blame: DataFrame, changes: DataFrame) -> DataFrame:
    """Blame lines (rev, author, ts) with the author and time of changes (rev, author, ts) where those are known."""
    known = changes.select("rev", F.col("author").alias("__author"), F.col("ts").alias("__ts"))
    joined = blame.join(known, "rev", "left")
    return joined.withColumn("author", F.coalesce("__author", "author")).withColumn("ts", F.coalesce("__ts", "ts")).drop("__author", "__ts")


def crossing(calls: DataFrame, key: str, order: list[str], tokens: str, limit: float) -> DataFrame:
    """The call of each key at which its running token total first exceeds the limit."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = calls.withColumn("total", F.sum(tokens).over(run)).filter(F.col("total") > limit)
    return total.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def run_totals(calls: DataFrame, order: list[str], values: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """calls with total_<value> for each value, summed from the run's first call to this one by order, and, given limits, crossed_<value>: whether it is the first call whose total exceeds the limit.

    No window holds all calls: they are dealt by ranges of the order, summed within these, and a row for each range is
    summed up and joined back. Calls that are equal in the order stay together and count in no particular order; null
    values add nothing, nulls in the order come first.
    """
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(calls.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    sums = placed.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])
    before = sums.select("__part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(before), "__part")
    for v in values:
        total = F.col(f"__{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))
        out = out.withColumn(f"total_{v}", total)
        if limits and v in limits:
            out = out.withColumn(f"crossed_{v}", (total > limits[v]) & (total - F.coalesce(F.col(v), F.lit(0)) <= limits[v]))
    return out.drop("__part", *[f"__{v}" for v in values])


SHA = r"^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$"


def parse_porcelain(lines: DataFrame) -> DataFrame:
    """(file_path, line_no, rev, author, ts, summary) from porcelain lines (file_path, pos, line).

    A block runs from its revision line to its tab line. What a revision tells once holds for its later blocks of the
    same file; the mail address stands in where no author is named.
    """
    run = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.col("line").startswith("\t").cast("int")).over(before), F.lit(0))
    marked = lines.withColumn("block", closed).withColumn("any", F.sum(F.col("line").rlike(SHA).cast("int")).over(run)).filter("any > 0")

    def value(field: str):
        return F.max(F.when(F.col("line").startswith(f"{field} "), F.substring("line", len(field) + 2, 1 << 30)))

    header = F.col("line").rlike(SHA)
    blocks = marked.groupBy("file_path", "block").agg(
        F.min_by(F.regexp_extract("line", SHA, 1), F.when(header, F.col("pos"))).alias("rev"),
        F.min_by(F.regexp_extract("line", SHA, 2), F.when(header, F.col("pos"))).cast("int").alias("line_no"),
        F.coalesce(value("author"), F.regexp_replace(value("author-mail"), "^<|>$", "")).alias("author"),
        F.timestamp_seconds(F.expr("try_cast(max(CASE WHEN line LIKE 'author-time %' THEN substring(line, 13) END) AS bigint)")).alias("ts"),
        value("summary").alias("summary"),
        F.max(F.col("line").startswith("\t")).alias("whole"),
    )
    told = blocks.filter("whole AND rev IS NOT NULL").withColumn("key", F.concat_ws(" ", "rev", "file_path"))
    filled = carry_forward(told, "key", ["block"], ["author", "ts", "summary"])
    return filled.select("file_path", "line_no", "rev", F.coalesce("author", F.lit("")).alias("author"), "ts", F.coalesce("summary", F.lit("")).alias("summary"))


def parse_annotate(lines: DataFrame, start_line: int, end_line: int) -> DataFrame:
    """(file_path, line_no, rev) from "change: text" lines (file_path, pos, line), numbered from 1 and sliced; path headers don't count."""
    pattern = r"^(\d+):"
    told = lines.filter(F.col("line").rlike(pattern) & ~(F.col("line").startswith("//") & F.col("line").contains("#")))
    numbered = told.withColumn("line_no", F.row_number().over(Window.partitionBy("file_path").orderBy("pos")))
    return numbered.filter(F.col("line_no").between(start_line, end_line)).select("file_path", "line_no", F.regexp_extract("line", pattern, 1).alias("rev"))


def parse_changes(lines: DataFrame) -> DataFrame:
    """(rev, author, ts, summary) from tagged description lines (output_id, pos, line), "... field value"; without output_id all are one command's output.

    Lines are numbered into changes by a running count per output; one output describes the few changes that were
    asked for. A change that several outputs describe counts as the last of them has it.
    """
    if "output_id" not in lines.columns:
        lines = lines.withColumn("output_id", F.lit(0))
    run = Window.partitionBy("output_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("n", F.sum(F.col("line").startswith("... change ").cast("int")).over(run)).filter("n > 0")
    value = lambda field: F.max(F.when(F.col("line").startswith(f"... {field} "), F.trim(F.substring("line", len(field) + 6, 1 << 30))))
    per = marked.groupBy("output_id", "n").agg(value("change").alias("rev"), value("user").alias("author"), F.timestamp_seconds(F.expr("try_cast(max(CASE WHEN line LIKE '... time %' THEN trim(substring(line, 10)) END) AS bigint)")).alias("ts"), value("desc").alias("summary"))
    return per.groupBy("rev").agg(*[F.max_by(c, F.struct("output_id", "n")).alias(c) for c in ("author", "ts", "summary")])
