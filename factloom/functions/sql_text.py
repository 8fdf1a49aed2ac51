"""What SQL text touches and creates. Each statement stays one row and nothing is shuffled.

The work is staged in columns: words, then the few positions of keywords, then what they name. Later stages only look at
those positions, so a long text is walked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions.columns import table_name

c = F.col
KEYWORDS = ["from", "join", "into", "update", "skip", "create"]


def sql_words(sql: Column) -> Column:
    """array<struct<word, line>>: the words with their 1-based lines, ``--`` comments cut."""
    per_line = F.transform(
        F.split(sql, "\n"),
        lambda text, n: F.transform(
            F.filter(F.split(F.regexp_replace(text, "--.*$", ""), r"[\s\p{Z}(),;]+"), lambda w: w != ""),
            lambda w: F.struct(w.alias("word"), (n + 1).cast("bigint").alias("line")),
        ),
    )
    return F.flatten(per_line)


def with_keywords(df: DataFrame, sql: str) -> DataFrame:
    """``df`` with ``_words`` and ``_hits``: the words of a text and, for each keyword in it, what stands around it."""
    words = df.withColumn("_words", sql_words(c(sql)))
    places = F.filter(
        F.transform("_words", lambda w, n: F.struct(F.lower(w["word"]).alias("key"), n.alias("n"), w["line"].alias("line"))),
        lambda p: p["key"].isin(KEYWORDS),
    )
    near = lambda n: F.get("_words", n)["word"]
    hits = F.transform(
        "_places",
        lambda p: F.struct(
            p["key"].alias("key"), p["n"].alias("n"), p["line"].alias("line"),
            F.when(p["n"] > 0, F.lower(near(p["n"] - 1))).otherwise("").alias("before"), near(p["n"] + 1).alias("next"),
        ),
    )
    return words.withColumn("_places", places).withColumn("_hits", hits).drop("_places")


def _locked() -> Column:
    return F.exists("_hits", lambda h: (h["key"] == "skip") & (F.coalesce(F.lower(h["next"]), F.lit("")) == "locked"))


def skips_locked(df: DataFrame, sql: str, name: str = "locked") -> DataFrame:
    """``df`` with whether ``skip`` is followed by ``locked`` anywhere in a text."""
    return with_keywords(df, sql).withColumn(name, _locked()).drop("_words", "_hits")


def sql_touches(df: DataFrame, sql: str) -> DataFrame:
    """``df`` without the text, one row per table it touches: (…, table, access, inserts, dequeues); a write beats a read."""
    rest = [n for n in df.columns if n != sql]

    def use(h: Column) -> Column:
        writes = ((h["key"] == "from") & (h["before"] == "delete")) | (h["key"] == "into") | ((h["key"] == "update") & (h["before"] != "for"))
        reads = h["key"].isin("from", "join") & ~writes
        return F.struct(
            F.when(reads | writes, table_name(h["next"])).alias("table"), writes.alias("writes"), (h["key"] == "into").alias("inserts")
        )

    found = F.filter(
        F.transform(F.filter("_hits", lambda h: h["next"].isNotNull()), use),
        lambda u: u["table"].isNotNull() & ~u["table"].isin(fixed.NOT_TABLES),
    )
    tables = F.array_distinct(F.transform("_found", lambda u: u["table"]))
    touched = F.transform(
        tables,
        lambda t: F.struct(
            t.alias("table"),
            F.when(F.exists("_found", lambda u: (u["table"] == t) & u["writes"]), "write").otherwise("read").alias("access"),
            F.exists("_found", lambda u: (u["table"] == t) & u["inserts"]).alias("inserts"),
        ),
    )
    staged = with_keywords(df, sql).select(*rest, found.alias("_found"), _locked().alias("dequeues"))
    return staged.select(*rest, "dequeues", F.inline(touched)).select(*rest, "table", "access", "inserts", "dequeues")


def created_tables(df: DataFrame, sql: str) -> DataFrame:
    """``df`` without the text, one row per ``CREATE TABLE [IF NOT EXISTS] name``: (…, table, line)."""
    rest = [n for n in df.columns if n != sql]
    starts = F.filter(
        "_hits",
        lambda h: (h["key"] == "create") & (F.lower(F.coalesce(h["next"], F.lit(""))) == "table") & (h["n"] + 2 < F.size("_words")),
    )

    def made(h: Column) -> Column:
        after = F.slice("_words", h["n"] + 3, F.size("_words"))
        name = F.get(F.filter(after, lambda w: ~F.lower(w["word"]).isin("if", "not", "exists")), F.lit(0))
        return F.struct(table_name(name["word"]).alias("table"), h["line"].alias("line"))

    named = F.filter(F.transform(starts, made), lambda m: m["table"].isNotNull())
    return with_keywords(df, sql).select(*rest, F.inline(named))
