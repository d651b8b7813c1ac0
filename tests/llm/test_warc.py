import random

import duckdb
import pytest

from lodestone.llm import queries, warc

SCHEMA = "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def brute(rows, keys):
    out = []
    order = lambda r: (r[2] is not None, r[2] or 0, r[0])
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [s for s in rows if s[3] == "response" and keys[r[1]] is not None and keys[s[1]] == keys[r[1]] and order(s) < order(r)]
        source = max(before, key=order, default=None)
        same = [None if source is None or r[i] is None or source[i] is None else r[i].removeprefix("W/") == source[i].removeprefix("W/") for i in (4, 5, 6)]
        status = "no_response" if source is None else "changed" if False in same else "resolved" if True in same else "unproven"
        own = r[7] or {}
        headers = own if status != "resolved" else {**(source[7] or {}), **{k: v for k, v in own.items() if k in warc.RENEWED}}
        out.append((r[0], keys[r[1]], source and source[0], status, headers))
    return sorted(out, key=str)


@pytest.mark.parametrize("times", [range(60), [None] * 300 + [7], [5, 5, 5, 6, None]])
def test_by_brute_force(spark, times):
    """Times that are spread, mostly missing, or mostly the same: the latter are cut by record_id."""
    rng = random.Random(4)
    forms = ["http://www.a.org/x/", "https://A.org/x?utm_source=q", "a.org/x#f", "http://b.org:80/?b=2&a=1", "http://b.org/?a=1&b=2&ref=z", "http://c.org", None, ""]
    one = lambda *c: rng.choice([None, *c])
    rows = []
    for i in range(600):
        url = "http://www.a.org/x/" if rng.random() < 0.3 else rng.choice(forms)
        headers = one({"date": str(i), "content-type": "t", "etag": "n"}, {"server": "s", "vary": str(i)}, {})
        rows.append((i, url, one(*times), rng.choice(["response", "revisit", "revisit"]), one("e", "f", "W/e"), one("m"), one("d"), headers))
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {r.url: r.k for r in df.select("url", warc.canonical(df.url).alias("k")).distinct().collect()}
    assert keys["http://www.a.org/x/"] == keys["https://A.org/x?utm_source=q"] == keys["a.org/x#f"] == "a.org/x"
    assert keys["http://b.org:80/?b=2&a=1"] == keys["http://b.org/?a=1&b=2&ref=z"]
    got = sorted(((r.record_id, r.url_key, r.source_id, r.status, dict(r.headers)) for r in warc.resolve(df).collect()), key=str)
    assert got == brute(rows, keys)
    assert warc.resolve(df.limit(0)).count() == 0


def test_sql_agrees(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = con.sql(queries.ORACLES["op5_revisit_resolution"]).df()
    got = queries.op5_revisit_resolution(spark, data).toPandas()
    columns = ["record_id", "url_key", "source_id", "status", "headers"]
    assert sorted(got[columns].fillna(-1).values.tolist()) == sorted(want[columns].fillna(-1).values.tolist())
    assert set(got.status) == {"resolved", "changed", "unproven"} and {r % 3 for r in got.source_id} == {0, 1}


RECORDS = [
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nWARC-Target-URI: <http://a.org/x>\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nWARC-Payload-Digest: sha1:AB\r\n\r\nHTTP/1.1 200 OK\r\nETag: \"v1\"\r\nServer: s\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n  two\r\n\r\n<html>\r\n\r\nETag: no header</html>",
    "WARC/1.1\nWARC-Type: revisit\nWARC-Record-ID: <urn:2>\nWARC-Target-URI: http://www.a.org/x/\nWARC-Date: 2024-02-02T03:04:05Z\n\nHTTP/1.1 304 Not Modified\nETag: W/\"v1\"\nDate: today\n\n",
    "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:3>\r\n\r\nsoftware: x",
    "", None, "no record",
]


def test_parsed_records(spark):
    df = warc.parsed(spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "n int, record string"))
    got = {r.n: r for r in df.collect()}
    assert len(got) == len(RECORDS)
    first = got[0]
    assert (first.record_id, first.url, first.kind, first.etag, first.digest, first.last_modified) == ("<urn:1>", "http://a.org/x", "response", '"v1"', "sha1:AB", None)
    assert first.headers == {"etag": '"v1"', "server": "s", "set-cookie": "a=1, b=2", "x-long": "one two"} and first["at"].year == 2024
    assert [got[i].kind for i in range(6)] == ["response", "revisit", None, None, None, None]
    out = warc.resolve(df.filter("kind IS NOT NULL")).collect()
    assert [(r.record_id, r.source_id, r.status) for r in out] == [("<urn:2>", "<urn:1>", "resolved")]
    assert out[0].headers["date"] == "today" and out[0].headers["server"] == "s" and out[0].headers["etag"] == 'W/"v1"'


def test_one_url_at_one_time_is_many_blocks(spark):
    """20,000 records without a time, by numbers and by strings that begin alike: no block holds much of them, blocks rise with the order."""
    from pyspark.sql import functions as F

    base = spark.range(20_000).select("id", F.lit(None).cast("timestamp").alias("at"))
    named = {"number": F.col("id") * 7, "uuid": F.concat(F.lit("<urn:uuid:"), F.md5(F.col("id").cast("string")), F.lit(">")), "counted": F.concat(F.lit("record-"), "id")}
    for name, record_id in named.items():
        out = warc._blocks(base.select("at", record_id.alias("record_id")), 16)
        assert out.columns == ["at", "record_id", "block"]
        blocks = out.groupBy("block").agg(F.count("*").alias("n"), F.min("record_id").alias("low"), F.max("record_id").alias("high")).orderBy("block").collect()
        assert len(blocks) >= 10 and max(b.n for b in blocks) < 2_700, name
        assert all(a.high < b.low for a, b in zip(blocks, blocks[1:], strict=False)), name
