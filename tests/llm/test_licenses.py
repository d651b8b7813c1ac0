import random
import re

import pyarrow as pa
import pytest

from lodestone.llm import licenses, queries
from tests.llm.helpers import odd

DATA = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates, threshold=0.8):
    """Names whose shingles any window of the grid contains: no minima."""
    out = set()
    for t in licenses.prepare(templates):
        w, name = tokens(text), tokens(templates[t.name])
        k = t.k
        want = {tuple(name[i : i + k]) for i in range(len(name) - k + 1)}
        have = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for i in range(0, len(have), t.stride):
            if len(want & set(have[i : i + t.window])) >= threshold * len(want):
                out.add(t.name)
    return out


def test_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op8_license_scan(spark, DATA).collect()
    assert len(rows) == len(texts) and sum(r.n_matches for r in rows) > 10
    for r in rows:
        assert set(filter(None, r.licenses.split(","))) == brute(texts[r.doc_id], licenses.TEMPLATES)


def test_edited_notices():
    rng = random.Random(8)
    texts = []
    for i in range(150):
        name = rng.choice(list(licenses.TEMPLATES))
        w = licenses.TEMPLATES[name].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        noise = [f"n{rng.randrange(99)}" for _ in range(rng.randrange(80))]
        texts.append(" ".join([*noise, *w, *noise]))
    got = [set() for _ in texts]
    for i, name, first, n, c in licenses.find(pa.array(texts), licenses.classes(licenses.prepare(licenses.TEMPLATES))):
        got[i].add(name)
        assert 0.8 <= c <= 1 and n > 0 and first >= 0
    assert got == [brute(t, licenses.TEMPLATES) for t in texts]


def test_odd_rows(spark):
    docs = odd(spark)
    out = licenses.scan(docs)
    assert out.columns == [*docs.columns, "__matches"] and out.count() == docs.count()
    assert all(r["__matches"] == [] for r in out.collect())
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.find(pa.array(["All rights reserved."]), licenses.classes(licenses.prepare({"x": "All rights reserved", "y": "!!"}))) == [(0, "x", 0, 3, 1.0)]


def test_full_texts_amid_prose(spark):
    """Long templates with a changed word in twenty and prose around them; places and sizes are those of the notice."""
    rng = random.Random(9)
    names = [n for n in licenses.TEMPLATES if n.startswith("full/")]
    docs = []
    for i in range(60):
        name = names[i % len(names)]
        w = licenses.TEMPLATES[name].split()
        for at in range(10, len(w), 60):
            w[at] = "changed"
        before = [f"n{rng.randrange(99)}" for _ in range(rng.randrange(300))]
        docs.append((i, " ".join([*before, *w, "and", "more", *before]), name, len(before)))
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string, name string, n long")).collect()
    for r in rows:
        hit = [m for m in r["__matches"] if m.license == r.name]
        assert len(hit) == 1 and hit[0].first_word == r.n and 0.8 <= hit[0].containment < 1
        assert {m.license for m in r["__matches"]} == brute(r.text, licenses.TEMPLATES)


def test_templates_of_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("b", "z z z"), ("b", "a a a"), ("c", None), (None, "x")], "name string, text string")
    assert licenses.from_table(table) == {"b": "a a a"}
    assert licenses.from_table(table.limit(0)) == {} and licenses.find(pa.array(["a a a"]), licenses.classes(licenses.prepare({}))) == []
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 3)
    with pytest.raises(ValueError):
        licenses.from_table(table)
