"""The declaration fingerprint on a small source of our own: which edits other files can see."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.plans import load_catalog

QUERIES = load_catalog()[0]

TANK = """\
//! Rain tanks and their valves.
use garden::{hose::Hose, Litres};

/// A tank in the yard.
#[derive(Clone)]
pub struct Tank {
    level: Litres,
}

impl Tank {
    pub fn drain(&mut self, by: Litres) -> Result<Litres, Dry> {
        let left = self.level - by;
        if left < LOW { warn!("low: {}", left); return Err(Dry); }
        self.level = left;
        Ok(left)
    }
}

const LOW: Litres = Litres(4);
"""
# What is replaced, and by what, with a name for the edit. No other file can tell.
UNSEEN = {
    "another sum": ("self.level - by", "self.level.minus(by) + Litres(0)"),
    "a longer warning": ('"low: {}"', '"only } left: {{}}"'),
    "a remark in a body": ("Ok(left)", "// all is well\n        Ok(left)"),
    "a block remark": ("Ok(left)", "/* brace } in it */ Ok(left)"),
    "doc text": ("A tank in the yard.", "A tank beside the shed."),
    "spread over lines": ("by: Litres) ->", "by: Litres)\n        ->"),
    "a closure": ("Ok(left)", "let tell = |n: u8| { n + 1 }; tell(1); Ok(left)"),
    "a character": ("Ok(left)", "let c = '{'; Ok(left)"),
    "a raw string": ("Ok(left)", 'let s = r##"} fn "# {"##; Ok(left)'),
    "a lifetime in a loop label": ("Ok(left)", "'outer: loop { break 'outer; } Ok(left)"),
}
# These other files can see.
SEEN = {
    "field type": ("level: Litres,", "level: u64,"),
    "new field": ("level: Litres,", "level: Litres, lid: bool,"),
    "no longer public": ("pub struct", "struct"),
    "argument by value": ("&mut self", "self"),
    "other error": ("Dry>", "Leak>"),
    "derived more": ("(Clone)", "(Clone, Debug)"),
    "constant": ("Litres(4)", "Litres(5)"),
    "import": ("hose::Hose", "hose::Reel"),
    "helper in a body": ("Ok(left)", "fn half(n: u8) -> u8 { n / 2 } Ok(left)"),
    "import in a body": ("Ok(left)", "use garden::pump; Ok(left)"),
    "another method": ("const LOW", "impl Tank { fn lid(&self) {} }\nconst LOW"),
}


@pytest.mark.parametrize("edits,same", [(UNSEEN, True), (SEEN, False)])
def test_edits(spark, edits, same):
    assert all(TANK.count(old) >= 1 for old, _ in edits.values())
    rows = spark.createDataFrame([(name, TANK, TANK.replace(old, new)) for name, (old, new) in edits.items()], "edit string,a string,b string")
    found = rows.select("edit", (C.structure_fingerprint(F.col("a")) == C.structure_fingerprint(F.col("b"))).alias("same")).collect()
    assert [r.edit for r in found if r.same != same] == []


def test_a_helper_counts_by_its_head_alone(spark):
    inner = lambda body: TANK.replace("Ok(left)", f"fn half(n: u8) -> u8 {{ {body} }} Ok(left)")
    rows = spark.createDataFrame([(inner("n / 2"), inner("n >> 1"), inner("n / 2").replace("n: u8", "n: u16"))], "a string,b string,c string")
    got = rows.select(*[C.structure_fingerprint(F.col(x)).alias(x) for x in "abc"]).first()
    assert got.a == got.b != got.c


def test_odd_texts(spark):
    """Null, empty and unclosed texts; letters beyond ASCII in front of a raw string; deep nesting."""
    deep = "fn a() " + "{" * 3000 + "x" + "}" * 3000
    texts = [None, "", "fn a() { b(", 'fn a() { ér"}" }', 'fn a() { r"}" }', "fn a() { '\U0001f600' }", deep]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", C.structure_fingerprint(F.col("t")).alias("p"))
    got = dict(rows.collect())
    plain = lambda *tokens: hashlib.sha256("\0".join(tokens).encode()).hexdigest()
    head = ["fn", "a", "(", ")", "{"]
    assert got == {0: None, 1: plain(), 2: plain(*head, "b", "("), **dict.fromkeys(range(3, 7), plain(*head, "}"))}


def test_a_source_is_hashed_once_per_text(spark, sf_dir):
    """The hash of the unedited source is not taken again for each of its edits."""
    plan = QUERIES["structure_fingerprint"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("ArrowEvalPython")
