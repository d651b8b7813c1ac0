import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing, queries
from tests.llm.helpers import odd

DATA = "/root/testdata/sf0.001"


def test_query_by_the_tokenizers_library(spark):
    rows = queries.op9_best_fit_packing(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert by_doc.keys() == ids.keys()
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids[d])
        assert [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        assert all(r.length == 2048 for r in parts[1:]) and (len(parts) == 1 or len(ids[d]) > 2048)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_special_token_text_and_odd_rows(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd(spark).union(spark.createDataFrame([(20, "a<|endoftext|>b", "z", "", "")]))
    got = packing.pieces(docs, keep_ids=True).collect()
    text = {(r.doc_id, len(r.text or "")): r.text for r in docs.collect()}
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id or 0, r.piece)):
        whole[r.doc_id] += r.ids
    for (d, _), x in text.items():
        want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert whole[d] == want * (2 if d == 4 else 1)
    packed = packing.pack(packing.pieces(docs)).collect()
    assert len(packed) == len(got)
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_plan_keeps_every_capacity():
    rng = np.random.default_rng(1)
    lengths = {int(v): int(n) for v, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 500, 300), strict=True)}
    for score in ("residual", "dot"):
        for rules in ({}, {"max_documents": 4}, {"max_attention": 2.5e6, "max_documents": 9}):
            bins = packing.plan(lengths, score=score, **rules)
            seen = defaultdict(int)
            for b in bins:
                assert b.count > 0
                assert sum(l * n for l, n in b.holds) <= 2048
                assert sum(n for _, n in b.holds) <= rules.get("max_documents", 2048)
                if len(b.holds) > 1 or b.holds[0][1] > 1:
                    assert sum(l * l * n for l, n in b.holds) <= rules.get("max_attention", 2048**2)
                for l, n in b.holds:
                    seen[l] += n * b.count
            assert seen == lengths


def test_ids_by_both_libraries_on_odd_characters():
    """Seeded texts over many scripts, runs of spaces, digits, contractions, emoji, controls and broken surroundings of them."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing._encoder(None)
    rng = random.Random(11)
    pieces = ["'s", "'LL", "I'm", "don't", " ", "  ", "\n", "\r\n", "\t", "\x00", "\x1f", "\x7f", " ", " ", "‍", "　", "007", "3.14", "1,000", "é", "é", "ß", "ſ", "İ", "ñ", "я", "Ж", "汉", "字", "かな", "한글", "العربية", "हिन्दी", "ไทย", "👍", "👩‍👩‍👧", "🇩🇪", "—", "…", "﻿", "�", "<|endoftext|>", "<|", "|>", "_", "__init__", "https://a.b/c?d=e", "#", "$$", "٣", "²", "Ⅷ", "a", "B", "word", "Word", "WORD"]
    letters = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x370, 0x400), *range(0x400, 0x460), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640))]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(rng.randrange(30)))
        assert encoder.encode_to_numpy(text, allowed_special="all").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
