"""WARC: resolving not-modified revisits.

A revisit record tells that a server answered "not modified": it has new headers but no payload. It is joined to the
latest earlier full response of the same canonical URL; if the validators agree, that response's payload is taken and
the headers that a 304 may renew are merged. Records are cut into blocks by quantiles of their time, and those of one
time (or of none) by quantiles of record_id, be it a number or a string; each (URL, block) carries only its last full response to the later blocks, so no URL's
records meet in one task, however they are spread over time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cluster import cut, partitions

#: Header fields that a 304 may renew (RFC 9111: all but those that describe the stored payload's form).
RENEWED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning"]
#: Query parameters that don't change what a page shows.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
MIN_BLOCKS = 16


def canonical(url: Column) -> Column:
    """Scheme and a leading www. or m. dropped, host lower-cased, no fragment, no tracking parameters, the others sorted, no trailing slash or default port; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def parsed(records: DataFrame) -> DataFrame:
    """records (record: text of one WARC record) with record_id, url, at, kind, etag, last_modified, digest and headers.

    Header blocks end with an empty line; names are lower-cased, repeated headers joined by ", ", folded lines belong to
    the header before. etag, last_modified and headers are those of the HTTP response inside. kind is "response",
    "revisit" or null for any other record; what a record lacks is null.
    """
    parts = F.split(F.col("record"), "\r?\n\r?\n", 3)
    out = records.withColumn("__warc", _fields(F.get(parts, F.lit(0)))).withColumn("__http", _fields(F.get(parts, F.lit(1))))
    kind = F.lower(F.col("__warc")["warc-type"])
    out = out.withColumns({
        "record_id": F.col("__warc")["warc-record-id"],
        "url": F.btrim(F.col("__warc")["warc-target-uri"], F.lit("<>")),
        "at": F.try_to_timestamp(F.col("__warc")["warc-date"]),
        "kind": F.when(kind.isin("response", "revisit"), kind),
        "etag": F.col("__http")["etag"],
        "last_modified": F.col("__http")["last-modified"],
        "digest": F.col("__warc")["warc-payload-digest"],
        "headers": F.col("__http"),
    })
    return out.drop("__warc", "__http")


def _fields(block: Column) -> Column:
    """Header lines after the first as a map."""
    lines = F.split(F.regexp_replace(block, "\r?\n[ \t]+", " "), "\r?\n")
    pairs = F.transform(F.filter(lines, lambda x, i: (i > 0) & x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.lit(1 << 30))).alias("v")))
    names = F.array_distinct(pairs["k"])
    values = F.transform(names, lambda name: F.array_join(F.filter(pairs, lambda p: p["k"] == name)["v"], ", "))
    return F.map_from_arrays(F.coalesce(names, F.array().cast("array<string>")), F.coalesce(values, F.array().cast("array<string>")))


#: Stands for a null time: before all others.
NO_TIME = -1e300


def _blocks(keyed: DataFrame, blocks: int) -> DataFrame:
    """keyed (at, record_id) with block (range, part), which rises with at, then record_id: about so many blocks of like size."""
    spark = keyed.sparkSession
    time = F.coalesce(F.col("at").cast("double"), F.lit(NO_TIME))
    cuts = keyed.agg(F.percentile_approx(time, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] or [0.0]
    often = {c: k for c, k in Counter(cuts).items() if k > 1}
    edges = sorted({*cuts, *(float(np.nextafter(c, np.inf)) for c in often)})
    out = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="__time", outputCol="__range").transform(keyed.withColumn("__time", time))
    part = F.lit(0)
    if often:
        parts = max(often.values())
        held = F.broadcast(spark.createDataFrame([(float(edges.index(c) + 1),) for c in often], "__range double"))
        if dict(keyed.dtypes)["record_id"] == "string":
            # Six bytes after what all record_ids of the range begin with, as a number: in order, and exact.
            out = out.withColumn("__hex", F.hex(F.col("record_id").cast("binary")))
            ends = out.join(held, "__range").groupBy("__range").agg(F.min("__hex").alias("__low"), F.max("__hex").alias("__high"))
            same = F.expr("aggregate(sequence(1, length(__low)), 0, (n, i) -> IF(n = i - 1 AND substr(__low, i, 1) = substr(__high, i, 1), i, n))")
            out = out.join(F.broadcast(ends.select("__range", same.alias("__same"))), "__range", "left")  # a row per range at most
            order = F.conv(F.rpad(F.substring("__hex", F.coalesce("__same", F.lit(0)) + 1, F.lit(12)), 12, "0"), 16, 10).cast("double")
        else:
            order = F.col("record_id").cast("double")
        out = out.withColumn("__order", order)
        quantiles = out.join(held, "__range").groupBy("__range").agg(F.percentile_approx("__order", [k / parts for k in range(1, parts)], 20 * parts).alias("__edges"))
        out = out.join(F.broadcast(quantiles), "__range", "left")
        part = F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col("__order"))), F.lit(0))
    return out.withColumn("block", F.struct("__range", part.cast("int").alias("part"))).drop("__time", "__range", "__hex", "__same", "__order", "__edges")


def resolve(records: DataFrame, renewed: list[str] = RENEWED) -> DataFrame:
    """Every revisit of records with what it resolves to.

    records: record_id (long or string), url string, at (orderable as a number), kind "response" or "revisit", etag, last_modified,
    digest string (null: unknown) and headers map<string,string> with lower-case names. Returns record_id, url_key,
    source_id (the latest response with the same canonical URL before it by at, then record_id), status and headers.
    status: "resolved"; "no_response" if there is none (also for a null URL); "changed" if a validator that both sides
    give differs; "unproven" if they share none; a weak ETag counts as the strong one. headers of a resolved revisit are
    the response's, with the revisit's where a 304 may renew them; else the revisit's own. Rows with the same url, at
    and record_id go by their digest. Null at comes first. Empty in, empty out.
    """
    spark = records.sparkSession
    keyed = records.withColumn("url_key", canonical(F.col("url")))
    lost = keyed.filter((F.col("kind") == "revisit") & F.col("url_key").isNull())
    keyed = _blocks(keyed.filter("url_key IS NOT NULL"), max(MIN_BLOCKS, 4 * partitions(spark)))
    when = F.struct(F.coalesce(F.col("at").cast("double"), F.lit(NO_TIME)), "record_id", F.coalesce("digest", F.lit("")))
    # What a later revisit needs; null on revisits.
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    keyed = keyed.withColumn("full", full)
    last = keyed.filter("kind = 'response'").groupBy("url_key", "block").agg(F.max_by("full", when).alias("last"))
    asked = keyed.filter("kind = 'revisit'").select("url_key", "block").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    steps = last.union(asked).groupBy("url_key", "block").agg(F.first("last", ignorenulls=True).alias("last"))  # a row per URL and block
    before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(steps.select("url_key", "block", F.last("last", ignorenulls=True).over(before).alias("carried")))
    inside = Window.partitionBy("url_key", "block").orderBy(F.col("at").asc_nulls_first(), "record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.last("full", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    joined = near.join(carried, ["url_key", "block"], "left").withColumn("source", F.coalesce("near", "carried")).drop("near", "carried", "full", "block")
    out = joined.unionByName(lost.withColumn("source", F.lit(None).cast(joined.schema["source"].dataType)))
    return out.select("record_id", "url_key", F.col("source.record_id").alias("source_id"), _status().alias("status"), _merged(renewed).alias("headers"))


def _status() -> Column:
    plain = lambda c, name: F.regexp_replace(c, "^W/", "") if name == "etag" else c
    same = [plain(F.col(c), c) == plain(F.col(f"source.{c}"), c) for c in ("etag", "last_modified", "digest")]
    differs = F.coalesce(same[0] == F.lit(False), F.lit(False)) | F.coalesce(same[1] == F.lit(False), F.lit(False)) | F.coalesce(same[2] == F.lit(False), F.lit(False))
    return F.when(F.col("source").isNull(), "no_response").when(differs, "changed").when(F.coalesce(*same).isNull(), "unproven").otherwise("resolved")


def _merged(renewed: list[str]) -> Column:
    own, stored = F.coalesce(F.col("headers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.col("source.headers")
    new = F.map_filter(own, lambda k, v: k.isin(renewed))
    kept = F.map_filter(F.coalesce(stored, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(_status() == "resolved", F.map_concat(kept, new)).otherwise(own)
