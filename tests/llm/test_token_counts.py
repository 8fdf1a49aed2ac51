"""Token counts against the forward scores of each word alone."""

import re

import public_tokenizers

from factloom.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text, cache={}):  # noqa: B006
    scores, byte = T.pieces(PATH).scores, T.pieces(PATH).byte
    total = 0
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        if word not in cache:
            body = (T.BLANK + word).encode()
            best = [(0, 0)]
            for i in range(1, len(body) + 1):
                options = [(best[i - 1][0] + byte, best[i - 1][1] - 1)]
                for j in range(max(0, i - 48), i):
                    try:
                        piece = body[j:i].decode()
                    except UnicodeDecodeError:
                        continue
                    if piece in scores:
                        options.append((best[j][0] + scores[piece], best[j][1] - 1))
                best.append(max(options))
            cache[word] = -best[-1][1]
        total += cache[word]
    return total


def test_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = T.count(docs, PATH).collect()
    assert len(got) == len(text)
    for r in got[:60]:
        assert r.n_tokens == brute(text[r.id])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "\U0001f600 日本語 ▁▁ a\xa0b"), (6, "ab" * 3000), (None, "the the the"), (4, "word"), (8, "x" * 30000 + " y"), (9, " ".join(f"w{i}" for i in range(500)))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int")
    got = sorted((str(r.id), r.n_words, r.n_tokens) for r in T.count(docs, PATH).collect())
    assert got == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), brute(t)) for i, t in rows)
    assert T.count(docs.limit(0), PATH).count() == 0
