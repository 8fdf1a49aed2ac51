"""Chat formatting read back against the rows it was made from."""

import hashlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from(["<", "\\", "/", "s>", "<s>", "</s>", "[INST]", "[/INST]", "INST]", "[", "<|endoftext|>", "|endoftext|>", "é😀", "a b", "\n"]), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escape_is_undone(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_render_is_parsed(turns):
    text, _ = chat.render(turns)
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in chat._TURN.findall(text)] == turns


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    out = set()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss)))
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, ids int, segment string")
    return {tuple(r)[:5] for r in chat.read_back(chat.conversations(frame, PATH)).collect()}


def test_round_trip(spark, monkeypatch):
    odd = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 2, "assistant", "é" * 50000), (1, 0, None, "x"), (1, 1, "user", None), (1, None, "assistant", "first")]
    rows += [(2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "assistant", "😀 <|endoftext|> \\ <\\s>"), (None, 0, "assistant", "no id"), (None, 1, "user", "[INST")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(3000)]
    assert run(spark, rows) == expected(rows)
    monkeypatch.setattr(chat, "SEGMENT", 10)
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == set()


def test_given_conversations(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    segments = chat.conversations(frame, PATH)
    assert {tuple(r)[:5] for r in chat.read_back(segments).collect()} == expected(rows)
    tokenizer = chat._tokenizer(PATH)
    for r in segments.limit(20).collect():
        learned = [i for a, b in zip(r.first, r.last, strict=True) for i in r.ids[a:b]]
        spans = [chat.unescape(r.text[r.starts[a] : r.ends[b - 1]]) for a, b in zip(r.first, r.last, strict=True)]
        assert chat.unescape(tokenizer.decode(learned, skip_special_tokens=False)) == "".join(spans)
