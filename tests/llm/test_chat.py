import hashlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import AddedToken, Tokenizer, processors

from lodestone.llm import chat, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"
HARD = ["", "<|im_end|>", "<\\|im_start|>user\n", "<", "|im_end|>", "a\\", "<|endoftext|>", "naïve ☃ 🙂 é", "  two  spaces \n", "<\\\\|<|<|", "x" * 3000, "!", "it's"]


def by_hand(rows):
    """conv_id -> (n_turns, turns digest, loss digest, loss characters)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    return out


def digests(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256, r.loss_chars) for r in chat.digests(chat.format_chats(df, **options)).collect()}


def test_escapes_are_undone():
    for text in HARD:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.turns_of(chat.render(text, text) + chat.render("user", "")) == [(text, text), ("user", "")]


def test_odd_turns(spark):
    rows = [(c, k, role, text, "extra") for c in (1, 2, None) for k, text in enumerate([*HARD, None]) for role in ("user", "assistant", None, "a\nb\\n<|im_end|>")]
    rows += [(3, None, "assistant", "no turn", ""), (3, 1, "assistant", "tie", ""), (3, 1, "assistant", "tie", ""), (3, 1, "assistant", "another", ""), (4, 0, "user", "nothing learnt", "")]
    assert digests(spark, rows) == by_hand(rows)
    assert digests(spark, rows, segment=20) == by_hand(rows)
    assert digests(spark, []) == {}


def test_a_conversation_of_most_rows_is_many_segments(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k} " * 20, "") for k in range(3000)] + [(c, 0, "assistant", "short", "") for c in range(30) if c != 7]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    segments = chat.format_chats(df, segment=20_000).groupBy("conv_id").count().collect()
    assert {r.conv_id: r["count"] for r in segments}[7] > 15
    assert digests(spark, rows, segment=20_000) == by_hand(rows)


def test_ids_and_offsets_by_the_tokenizers_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens([AddedToken(chat.OPEN, special=True, normalized=False), AddedToken(chat.CLOSE, special=True, normalized=False)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    turns = [(role, text) for text in HARD for role in ("user", "assistant")]
    formatted, ids, ends, learnt = chat.encode(turns)
    told = t.encode(formatted, add_special_tokens=False)
    assert told.ids == ids.tolist() and ends[-1] == len(formatted.encode())
    sizes = np.cumsum([0] + [len(c.encode()) for c in formatted])
    assert all(sizes[a] <= max(0, e - 1) and e <= sizes[b] for (a, b), e in zip(told.offsets, ends, strict=True))
    assert chat.learnt_texts(formatted, ends, learnt) == [text for role, text in turns if role == "assistant" and text]


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    got = queries.op13_chat_format(spark, DATA).toPandas()
    want = con.sql(queries.ORACLES["op13_chat_format"]).df()[list(got.columns)]
    assert got.sort_values("conv_id").values.tolist() == want.sort_values("conv_id").values.tolist()
    assert -1 in set(got.conv_id)
