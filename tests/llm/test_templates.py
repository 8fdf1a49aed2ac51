"""Template decontamination: planted leaks are found, clean texts are left alone, and hashes agree with plain strings."""

import random
import re

from factloom.llm import templates

SENTENCE = "A baker sells 12 loaves to Anna for 3 dollars each and then Anna gives 5 loaves to Peter who walks 7 km home before the evening."
OTHER = "A baker sells 40 loaves to Maria for 9 euros each and then Maria gives 8 loaves to Simon who walks 2 miles home before the evening."
RIVER = "Every river bends twice before the old stone bridge near the market, and the mill stands on its far bank."
MIXED = "A baker sells 40 loaves to Maria for 9 euros each and then Kate gives 8 loaves to Kate who walks 2 miles home before the evening."


def plain(text):
    """The template of a text, word by word."""
    out, opens, number = [], True, False
    text = text or ""
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        word = m[0]
        core = "".join(c for c in word if c.isascii() and c.isalnum() or ord(c) > 127)
        opens = opens or "\n" in text[last : m.start()]  # noqa: F821
        if core:
            low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in core)
            if core[0].isdigit() and core[0].isascii():
                out.append("<1>")
            elif (core[0].isascii() and core[0].isupper() or "À" <= core[0] <= "Þ" and core[0] != "×") and not opens and sum("A" <= c <= "Z" for c in core) < 2:
                out.append("<2>")
            elif number and low in templates.UNITS:
                out.append("<3>")
            else:
                out.append(low)
            number = out[-1] == "<1>"
            opens = word[-1] in ".!?:;"
        last = m.end()
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, key int, window string"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int"),
    )


def found(spark, docs, items):
    return sorted(((r.id, r.item_id, r.n_covered, r.n_changed) for r in templates.leaks(*frames(spark, docs, items)).collect()), key=str)


def test_slots_and_verbatim(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    docs = [(1, f"{noise(50)} {SENTENCE} {noise(9)}"), (2, f"{noise(20)}. {OTHER}"), (3, noise(300)), (4, None), (5, ""), (6, f"{noise(5)} {MIXED.upper()}"), (7, SENTENCE[:30]), (9, f"{noise(30)} {RIVER.upper()}"), (None, SENTENCE)]
    docs += [(8, "very " * 30000), docs[0]]
    items = [(10, SENTENCE), (11, "What is 2 plus 3"), (12, None), (13, ""), (14, "7"), (15, RIVER)]
    got = found(spark, docs, items)
    assert {r[:2] for r in got} == {(1, 10), (2, 10), (9, 15), (None, 10)}
    assert {r[0]: r[3] > 0 for r in got} == {1: False, 2: True, 9: False, None: False}
    assert found(spark, [(20, "we ask: What is 4 plus 9 here")], items)[0][:2] == (20, 11)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_inconsistent_slots(spark):
    a = "then he saw Anna near the old mill and told Anna about the new plan for the whole town tomorrow"
    b = "then he saw Kate near the old mill and told Maria about the new plan for the whole town tomorrow"
    assert found(spark, [(1, a.replace("Anna", "Paul"))], [(5, a)]) != []
    assert found(spark, [(1, b)], [(5, a)]) == []


def test_copies_in_capitals_and_items_rich_in_slots(spark):
    dense = "Add 3 kg 250 g and 4 kg 750 g then subtract 2 kg 100 g"
    other = "Add 7 kg 150 g and 9 kg 350 g then subtract 5 kg 900 g"
    chance = "We took 5 kg 250 g and 4 kg 950 g of it, sold 2 kg 100 g"
    items = [(1, SENTENCE), (2, dense), (3, "Does Anna like Peter")]
    docs = [(1, f"so: {SENTENCE.upper()}"), (2, SENTENCE.replace(" ", "\n")), (3, f"so {dense}"), (4, f"so {other.lower()}"), (5, chance), (6, "DOES ANNA LIKE PETER")]
    assert {r[:2] for r in found(spark, docs, items)} == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 3)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        words = plain(text)
        for i, item in items:
            theirs = plain(item)
            size = min(8, len(theirs))
            if not size:
                continue
            index = {}
            for j in range(len(theirs) - size + 1):
                index.setdefault(tuple(theirs[j : j + size]), []).append(j)
            hit = set()
            for j in range(len(words) - size + 1):
                window = tuple(words[j : j + size])
                if sum(x[0] != "<" for x in window) >= min(5, (size + 1) // 2):
                    for k in index.get(window, ()):
                        hit.update(range(k, k + size))
            if hit and len(hit) >= 0.35 * len(theirs):
                out.add((d, i))
    return out


def test_given_documents(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.id, r.item_id) for r in templates.leaks(docs, benchmark).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert want and got == want


def test_lookup_is_only_a_filter(spark, sf_dir, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(str, templates.leaks(docs, benchmark).collect()))
    monkeypatch.setattr(templates, "LOOKUP", 0)
    assert sorted(map(str, templates.leaks(docs, benchmark).collect())) == one


def test_decontaminate_keeps_columns(spark):
    docs, items = frames(spark, [(1, SENTENCE), (2, "clean text"), (3, None)], [(1, SENTENCE)])
    out = templates.decontaminate(docs, items)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
