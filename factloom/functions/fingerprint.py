"""The tokens of a source text outside function bodies, one pass per text. A small helper that Spark calls on Arrow batches."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa

# Comments, raw and plain strings, characters, lifetimes, words, and single signs. Possessive, so long strings need no stack.
# Words and blanks are ASCII; the mark of a word's edge in front of a raw string knows all letters. Words that can't begin a
# string and signs come first, as most tokens are such. Blanks behind a token go with it.
CODE_TOKEN = re.compile(
    r"""([ac-qs-zA-Z0-9_]\w*+|[^\s\w/"']|//[^\n]*+|/\*.*?\*/|(?u:\b)b?r(?P<hashes>#*+)".*?"(?P=hashes)|b?"[^"\\]*+(?:\\.[^"\\]*+)*+"|b?'(?:\\(?:u\{[^}]*+\}|x..|.)|[^'\\\n])'|'\w++|\w++|[^\s\w])\s*+""",
    re.ASCII | re.DOTALL,
)
# Words that open an item inside a body; those in the second list only before one of these.
ITEM_WORDS = {"fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "type", "extern", "pub", "const", "macro_rules"}
ITEM_PREFIXES = {"unsafe": {"fn", "impl", "trait", "extern"}, "async": {"fn", "unsafe"}}
#: All other tokens change nothing but whether a statement may start.
_TELLING = {"{", "}", ";", "(", ")", "[", "]", *ITEM_WORDS, *ITEM_PREFIXES}
_NAME = re.compile(r"[A-Za-z_]")


def body_cuts(tokens: list[str]) -> list[tuple[int, int]]:
    """Ranges of tokens in function bodies, without the items declared there and without bodies of constant functions."""
    cuts: list[tuple[int, int]] = []
    pairs: list[int] = []  # for each open brace the brackets open before it
    inside: list[int] = []  # open function bodies (their brace depth) and items inside bodies (minus their depth, from -1)
    brackets = since = 0  # since: where what is left out began
    head = 0  # 1 in the header of a function, 2 of a constant one
    const = start = False  # whether this header began with const; whether a statement may start
    last = len(tokens) - 1
    for i, t in enumerate(tokens):
        if t not in _TELLING:
            start = False
            continue
        follows = tokens[i + 1] if i < last else ""
        depth, top = len(pairs), inside[-1] if inside else 0
        body = top > 0
        item = body and start and ((t in ITEM_WORDS and not (t == "const" and follows == "{")) or follows in ITEM_PREFIXES.get(t, ()))
        outside = not body or item
        opens, closes, ends = t == "{", t == "}", t == ";" and brackets == 0
        enters = outside and opens and head == 1
        leaves = body and closes and depth == top
        # The item that ends here: its own closing brace, or the end of its statement.
        below = (inside[-2] if len(inside) > 1 else 0) if leaves else top
        done = below < 0 and ((closes and depth == -below) or (ends and depth + 1 == -below))
        if (leaves or item) and i > since:
            cuts.append((since, i))
        drop = leaves + done
        if enters or (done and len(inside) > drop):
            since = i + 1
        if item:
            inside.append(-depth - 1)
        elif enters:
            inside.append(depth + 1)
        elif drop:
            del inside[-drop:]
        if outside and t == "fn" and _NAME.match(follows):
            head = 2 if const else 1
        elif opens or closes or ends:
            head = 0
        const = not (opens or closes or ends) and ((const and not item) or (outside and t == "const"))
        if opens:
            pairs.append(brackets)
            brackets = 0
        elif closes and depth:
            brackets = pairs.pop()
        elif t in "([":
            brackets += 1
        elif t in ")]":
            brackets = max(brackets - 1, 0)
        start = opens or closes or t == ";"
    return cuts


def fingerprint(text: str) -> str:
    """SHA-256 of the tokens outside bodies, with a null character between them."""
    tokens = [t for m in CODE_TOKEN.finditer(text) if not (t := m[1]).startswith(("//", "/*"))]
    kept, at = [], 0
    for begin, end in body_cuts(tokens) if "{" in text else ():
        kept += tokens[at:begin]
        at = end
    return hashlib.sha256("\0".join(kept + tokens[at:]).encode()).hexdigest()


def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint of each text, given as UTF-8 bytes; null for null."""
    return pa.array([fingerprint(x.as_py().decode("utf-8", "replace")) if x.is_valid else None for x in texts], pa.string())
