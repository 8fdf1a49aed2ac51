"""Secret scans against Python's own matching and a plain sum."""

import hashlib
import random
import re

from factloom.llm import secret_scan as S

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_of(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def added_of(text, model, base):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text or ""):
        codes = [ord(c) - 43 for c in m[0]]
        total = sum(model[a * 80 + b] for a, b in zip(codes[:-1], codes[1:], strict=True))
        if total > S.THRESHOLD and not any(a < m.end() and b > m.start() for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(rows, texts, model):
    for r in rows:
        base = base_of(texts[r.id])
        assert r.base == listed(base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.spans == listed(base + added_of(texts[r.id], model, base))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, n_chars long, base string, id int")


ODD = [
    (1, None), (2, ""), (3, "é😀 Password = 'abc123' token:'x' TOKEN=short"), (4, "password: token: abcdefgh secret=token=abcdef"), (5, "a" * 24 + "g" + "0" * 23),
    (6, "AKIAAKIA" + "Z" * 13 + " AKIA1234567890ABCDE"), (7, "ſecret=abcdefg toKen=abcdefg api_key\"  :  \"abc.def/ghi"), (8, "token=" + "f" * 40 + "," + "deadbeef" * 4),
    (9, " ".join(["secret=abcdef", "é"] * 700)), (10, "x" * 200000), (None, "passwd=123456"), (12, "line\npassword=\nabcdefgh \U0001f600AKIA" + "A1" * 9),
]


def test_base_and_positions(spark):
    texts = dict(ODD)
    check(S.findings(frame(spark, ODD), [0] * 6400).collect(), texts, [0] * 6400)


def test_model_on_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = S.train(S.labelled_tokens(docs))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    check(S.findings(docs, model).collect(), texts, model)
    rng = random.Random(1)
    tokens = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(60)]
    words = sorted({w for t in texts.values() for w in re.findall("[A-Za-z]{16,}", t or "")})[:200]
    rows = frame(spark, [(i, f"und {t} der") for i, t in enumerate(tokens + words)])
    hit = {r.id: r.n_random for r in S.findings(rows, model).collect()}
    assert sum(hit[i] for i in range(60)) >= 57 and sum(hit[i] for i in range(60, len(hit))) <= 2


def test_without_labels(spark):
    docs = frame(spark, [])
    assert S.train(S.labelled_tokens(docs)) == [0] * 6400
    assert S.findings(docs).count() == 0


def test_redact(spark):
    rows = [*ODD, (20, "é token=" + "ab" * 20 + " z"), (21, "nothing here")]
    out = S.redact(frame(spark, rows), [0] * 6400)
    assert out.columns == ["doc_id", "text", "n_chars", "base", "id"]
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        want, at = "", 0
        for a, _, b in base_of(text):
            if a >= at:
                want += text[at:a] + "[secret]"
            at = max(at, b)
        assert r.text == (None if text is None else want + text[at:])
        assert r.n_chars == (None if text is None else len(r.text))


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
