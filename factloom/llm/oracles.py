"""The same answers in SQL for DuckDB, where SQL can say them."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _words(text: str) -> str:
    """The words of a text, as a list."""
    return f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT body, max(page_id) AS keeper, count(*) AS c FROM p GROUP BY body),
r AS (SELECT p.*, g.keeper, p.n >= 1000 AND g.c > 1 AND p.page_id IS DISTINCT FROM g.keeper AS again FROM p JOIN g ON g.body = p.body)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN keeper END AS refers_to FROM r"""


def _escaped(text: str) -> str:
    return f"regexp_replace({text}, '([<\\[])(\\\\*)(/?s>|/?INST\\]|\\|endoftext\\|>)', '\\1\\\\\\2\\3', 'g')"


OP3 = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST][/INST]</s>') + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN 'all ' || len(w) || ' ' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.least, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS window_hash FROM (SELECT k, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35) x),
again AS (SELECT window_hash FROM s GROUP BY window_hash HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, unnest(generate_series(i, i + 34)) AS i FROM s WHERE window_hash IN (SELECT window_hash FROM again)),
kept AS (SELECT x.k, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x
  LEFT JOIN gone g ON g.k = x.k AND g.i = x.i WHERE g.k IS NULL GROUP BY x.k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT k, count(*) AS n FROM gone GROUP BY k) c ON c.k = d.k LEFT JOIN kept k ON k.k = d.k"""

OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) x WHERE k <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def _field(name: str, value: str | None = None) -> str:
    value = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


def _fold(k: int, level: str) -> str:
    """Step k of a proof: the digest one level up, where the tree has another level."""
    at = "CAST(f.at % 8 AS INTEGER)"
    return f"""
g{k} AS (SELECT tree, idx // 8 AS up, max(size) AS size, list(digest ORDER BY idx) AS kids FROM {level} GROUP BY tree, idx // 8),
f{k + 1} AS (SELECT f.doc_id, f.leaf, f.own, f.tree, f.at // 8 AS at, CASE WHEN g.size = 1 THEN f.digest ELSE sha256(array_to_string(g.kids[:{at}] || [f.digest] || g.kids[{at} + 2:], '')) END AS digest,
  CASE WHEN g.size = 1 THEN f.proof ELSE f.proof || array_to_string(g.kids[:{at}] || g.kids[{at} + 2:], '') END AS proof
  FROM f{k} f JOIN g{k} g ON g.tree = f.tree AND g.up = f.at // 8),"""


def _level(name: str, below: str) -> str:
    return f"""
{name} AS (SELECT tree, idx // 8 AS idx, CASE WHEN max(size) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest, (max(size) + 7) // 8 AS size
  FROM {below} GROUP BY tree, idx // 8),"""


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || [CAST((ascii(substr(d, CAST(i // 8 + 1 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT) for i in range(8 * length(d))],
    lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)))"""
_HEIGHT, _TOP_HEIGHT = 7, 3

OP13 = f"""
WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS d FROM documents),
h AS (SELECT doc_id, lang, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
  sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text", f"CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE text END")}) AS own FROM d),
l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents) x),
l0 AS (SELECT h.*, l.tree, row_number() OVER (PARTITION BY l.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest, count(*) OVER (PARTITION BY l.tree) AS size FROM h JOIN l ON h.lang IS NOT DISTINCT FROM l.lang),
f0 AS (SELECT doc_id, leaf, own, tree, idx AS at, own AS digest, '' AS proof FROM l0),
{"".join(_fold(k, f"l{k}") + _level(f"l{k + 1}", f"l{k}") for k in range(_HEIGHT))}
t0 AS (SELECT 0 AS tree, tree AS idx, digest, count(*) OVER () AS size FROM l{_HEIGHT}),
r0 AS (SELECT doc_id, leaf, own, 0 AS tree, tree AS lang_tree, tree AS at, digest, proof FROM f{_HEIGHT}),
{"".join(_fold(k, f"t{k}").replace(f"f{k + 1} AS", f"r{k + 1} AS").replace(f"f{k} f", f"r{k} f").replace(f"g{k} ", f"u{k} ").replace("f.tree,", "f.tree, f.lang_tree,", 1) + _level(f"t{k + 1}", f"t{k}") for k in range(_TOP_HEIGHT))}
root AS (SELECT digest AS root FROM t{_TOP_HEIGHT})
SELECT r.doc_id, r.leaf, s.digest AS subroot, root.root, sha256(r.proof) AS proof_sha256, r.digest AS folded_root, r.digest = root.root AS verified
FROM r{_TOP_HEIGHT} r JOIN l{_HEIGHT} s ON s.tree = r.lang_tree, root"""

ORACLES = {"op2_warc": OP2, "op3_chat_format": OP3, "op8_ngram_jaccard": OP8, "op9_substring_dedup": OP9, "op11_hard_negatives": OP11, "op13_merkle_manifest": OP13}
