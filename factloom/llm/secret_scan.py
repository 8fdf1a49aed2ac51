"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

All of it is built-in columns. A model holds, for each pair of neighbouring characters, how much likelier it is in random
strings than in ordinary identifiers and words, in hundredths of a nat. Both chains are counted from labelled tokens; a
long token is a secret if its sum is above ``THRESHOLD``. Base patterns stay as they are; the model adds spans that
overlap none of theirs.

Positions are code points, end exclusive: the lengths of the pieces between matches and of the matches are added up.

Defined cases: null text is empty and has no span; ties in start are in the order of ``KINDS``; repeated rows give equal
rows; without labelled tokens every ratio is 0 and only base spans are found; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import configure

# The base patterns and the least length of what they match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the model judges.
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
#: Hundredths of a nat that a token's sum must exceed: e^12 to 1 against an ordinary word.
THRESHOLD = 1200
#: Documents that the labelled sample takes about, chosen by a hash of their text, when the corpus has more.
SAMPLE = 20_000
#: Codes of the characters in tokens, and their number.
_LOW, _HIGH, _SYMBOLS = 43, 122, 66
_WIDTH = _HIGH - _LOW + 1
_BLOCK = 256


def labelled_tokens(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(token, random) from a bounded sample of documents.

    Random: what base patterns catch, and digests of the texts in two alphabets. Ordinary: the other words.
    """
    n = max(1, docs.count())
    some = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    text = F.col("text")
    digest = F.sha2("text", 256)
    caught = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), 2), F.regexp_extract_all("text", F.lit(ACCESS), 0), F.regexp_extract_all("text", F.lit(HEX), 0),
        F.array(digest, F.base64(F.unhex(digest))),
    )
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    ordinary = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]{4,}"), 0)
    both = F.array(F.struct(caught.alias("tokens"), F.lit(True).alias("random")), F.struct(ordinary.alias("tokens"), F.lit(False).alias("random")))
    return some.select(F.explode(both).alias("x")).select(F.explode("x.tokens").alias("token"), "x.random")


def _codes(token: Column) -> Column:
    """The codes of a token's characters, from 0; others than the tokens' alphabet are left out."""
    return F.transform(F.filter(F.transform(F.split(token, ""), F.ascii), lambda c: (c >= _LOW) & (c <= _HIGH)), lambda c: c - _LOW)


def _pairs(codes: Column) -> Column:
    """Index of each pair of neighbours in a model, from 0."""
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * _WIDTH + b)


def train(tokens: DataFrame) -> list[int]:
    """The ratio of every pair of characters. What comes to the driver are the counts of at most 2 * 80 * 80 pairs."""
    counts = tokens.select("random", F.explode(_pairs(_codes(F.col("token")))).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    chains = {True: {}, False: {}}
    totals = {True: [0] * _WIDTH, False: [0] * _WIDTH}
    for r in counts:
        chains[r.random][r.pair] = r.n
        totals[r.random][r.pair // _WIDTH] += r.n
    if not chains[True] or not chains[False]:
        return [0] * (_WIDTH * _WIDTH)

    def log(random: bool, pair: int) -> float:
        return math.log((chains[random].get(pair, 0) + 0.5) / (totals[random][pair // _WIDTH] + 0.5 * _SYMBOLS))

    return [round(100 * (log(True, p) - log(False, p))) for p in range(_WIDTH * _WIDTH)]


def score(token: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a token, in hundredths of a nat."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    return F.aggregate(_pairs(_codes(token)), F.lit(0).cast("long"), lambda total, pair: total + F.element_at(ratios, pair + 1))


def _places(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, value) of every match. Lengths are added up in blocks, so many matches stay affordable."""
    between = F.split(text, pattern, -1)
    gaps = F.transform(between, F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: g + F.length(m))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    return F.transform(
        F.array(F.struct(gaps.alias("gaps"), steps.alias("steps"), matches.alias("values"))),
        lambda x: F.transform(
            F.array(F.transform(F.sequence(F.lit(0), F.floor((F.size(x.steps) - 1) / _BLOCK).cast("int")), lambda b: add(F.slice(x.steps, b * _BLOCK + 1, _BLOCK)))),
            lambda sums: F.transform(
                x["values"],
                lambda value, i: F.struct(
                    (add(F.slice(sums, F.lit(1), F.floor(i / _BLOCK).cast("int"))) + add(F.slice(x.steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + F.element_at(x.gaps, i + 1)).alias("start"),
                    F.lit(kind).alias("kind"), value.alias("value"),
                ),
            ),
        )[0],
    )[0]


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of a pattern's matches; texts without one (that ``keep`` accepts) are searched once and no more."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    wanted = F.size(matches) > 0 if keep is None else F.exists(matches, keep)
    spans = F.transform(_places(text, matches, pattern, kind), lambda s: F.struct(s.start, s.kind, (s.start + F.length(s["value"])).alias("end"), s["value"].alias("value")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(wanted, spans if keep is None else F.filter(spans, lambda s: keep(s["value"]))).otherwise(none)


def scan(docs: DataFrame, model: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (start, kind, end, value), in order of start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_found(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2)))
    random = _found(text, TOKEN, 3, lambda token: score(token, model) > threshold)
    out = docs.withColumns({"base": base, "added": random})
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b.start < a.end) & (b.end > a.start)))
    return out.withColumn("added", apart)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")


def findings(docs: DataFrame, model: list[int] | None = None) -> DataFrame:
    """A row per document: id, the number of spans of each base kind, base and all spans as text."""
    configure(docs.sparkSession)
    model = train(labelled_tokens(docs)) if model is None else model
    rows = scan(docs.select(F.col("doc_id").alias("id"), "text"), model)
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return rows.select(
        "id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("added").cast("long").alias("n_random"),
        listed(F.col("base")).alias("base"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, model: list[int] | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with each run of overlapping spans replaced by a mark, in the columns of ``docs``; n_chars follows."""
    configure(docs.sparkSession)
    model = train(labelled_tokens(docs)) if model is None else model
    names = docs.columns
    rows = scan(docs.select(*[F.col(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names)]), model)
    merged = F.aggregate(
        F.array_sort(F.concat("base", "added")), F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s.start < F.coalesce(F.try_element_at(done, F.lit(-1)).end, F.lit(0))),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1)).start.alias("start"), F.greatest(F.try_element_at(done, F.lit(-1)).end, s.end).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(s.start.alias("start"), s.end.alias("end"))))),
    )
    rows = rows.withColumn("merged", merged)
    before = lambda i: F.coalesce(F.try_element_at("merged", i).end, F.lit(0))
    pieces = F.transform("merged", lambda s, i: F.concat(F.substr(F.col("text"), F.when(i > 0, before(F.greatest(i, F.lit(1)))).otherwise(0) + 1, s.start - F.when(i > 0, before(F.greatest(i, F.lit(1)))).otherwise(0)), F.lit(mark)))
    rest = F.substr(F.col("text"), F.try_element_at("merged", F.lit(-1)).end + 1)
    clean = F.when(F.size("merged") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    out = rows.withColumn("text", clean).select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
