"""Ids against the tokenizer, and packing against its rules."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing
from factloom.llm import words as W
from factloom.llm.bpe import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)



def ids_of(texts):
    out = []
    for _, _, data, offsets in W.chunks(pa.array(texts, pa.string())):
        flat, edges = encoder(PATH).encode(data, offsets)
        out += [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sdtmrevl1a.é\xa0!<|>"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_ids(texts):
    assert ids_of(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ["it's  we'll\n\n 'sx ''s", "<|endoftext|>", "͸ x"]
    assert ids_of(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, length=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    want = {d: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    for r in rows:
        pieces[r.id].append((r.start, r.length))
        sequences[r.sequence].append((r.place, r.length))
        ids = want[r.id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.n_tokens == len(want[r.id])
        assert r.crc == zlib.crc32(np.array(ids, "<u4").tobytes())
    copies = defaultdict(int)
    for d, _ in docs:
        copies[d] += 1
    assert pieces.keys() == want.keys()
    for d, found in pieces.items():
        cover = np.zeros(len(want[d]), int)
        for a, n in found:
            cover[a : a + n] += 1
        assert (cover == copies[d]).all()
    padding = 0
    for found in sequences.values():
        at = 0
        for place, n in sorted(found):
            assert place == at
            at += n
        assert at <= length
        padding += length - at
    return padding, length * len(sequences)


def test_packs_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    padding, total = check(packing.pack(docs.repartition(5), PATH).collect(), rows)
    assert padding <= 1024 + 0.01 * total


def test_many_tasks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    rows = [(i, "word " * (i * 37 % 900)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "x" * 20000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, length int")
    for parts in (1, 20):
        padding, total = check(packing.pack(docs.repartition(parts), PATH).collect(), rows)
        assert padding <= 1024 + 0.01 * total
    assert packing.pack(docs.limit(0), PATH).count() == 0
    kept = packing.pack(docs.where("doc_id = 5"), PATH, keep_ids=True).collect()
    assert b"".join(r.ids for r in sorted(kept, key=lambda r: r.start)) == np.array([*LIBRARY.encode(rows[5][1], add_special_tokens=False).ids, 0], "<u4").tobytes()
