"""Dependency rules on the link graph: which links break a rule, which allow covers them, and the counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators.ordered import KEYS
from factloom.operators.placement import place_files
from factloom.session import materialize

EXTERNALS = "externals"


def far_ends(
    links: DataFrame,
    items: DataFrame,
    externals: DataFrame,
    ports: DataFrame,
    placed_files: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The links whose far end counts, with target, target_item, target_area and target_side.

    An item ends in its placement; a table, an I/O external and a driven I/O port end in the externals;
    other ends drop out. One side of each join is made of rows unique by (keys, target kind, id).
    """
    end = lambda d, kind, target, item, area, side: d.select(
        *keys, F.lit(kind).alias("target_kind"), F.col("id").alias("target_id"), target.alias("target"),
        item.alias("target_item"), area.alias("target_area"), side.alias("target_side"),
    )
    none = F.lit(None).cast("string")
    item_ends = end(
        items.join(placed_files, [*keys, "file"]), "item",
        C.site_of(F.col("id"), F.col("file"), F.col("module")), F.col("id"), F.col("area"), F.col("side"),
    )
    outside = lambda d, kind: end(d, kind, F.col("id"), none, F.lit(EXTERNALS), F.lit(EXTERNALS))
    ends = (
        item_ends
        .unionByName(outside(externals.filter(C.is_io(F.col("kind"))), "external"))
        .unionByName(outside(ports.filter((F.col("side") == "driven") & C.is_io(F.col("kind"))), "port"))
    )
    tables = links.filter(F.col("target_kind") == "table")
    known = links.filter(F.col("target_kind") != "table").join(ends, [*keys, "target_kind", "target_id"])
    tabled = tables.select(
        *tables.columns, F.concat(F.lit("table:"), F.col("target_id")).alias("target"), none.alias("target_item"),
        F.lit(EXTERNALS).alias("target_area"), F.lit(EXTERNALS).alias("target_side"),
    )
    return known.select(*tabled.columns).unionByName(tabled)


def rule_links(
    items: DataFrame,
    links: DataFrame,
    externals: DataFrame,
    ports: DataFrame,
    areas: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The links a rule can read: no test links, from a known placed item outside test code, into another area."""
    # Read at both ends of the links; written once, its real size decides whether it is broadcast.
    placed = materialize(place_files(items, areas, keys), "placed")
    near = (
        items.filter(C.non_test(F.col("cfg")))
        .join(placed, [*keys, "file"])
        .select(
            *keys, F.col("id").alias("from"), F.col("area").alias("from_area"), F.col("side").alias("from_side"),
            C.site_of(F.col("id"), F.col("file"), F.col("module")).alias("site"),
        )
    )
    ended = far_ends(links.filter(F.col("kind") != "tests"), items, externals, ports, placed, keys)
    return ended.join(near, [*keys, "from"]).filter(F.col("target_area") != F.col("from_area"))


def rule_verdicts(areas: DataFrame, rules: DataFrame) -> DataFrame:
    """Per pair of places of a repo the rules broken by a link between them, with the target that is hit.

    (repo, from_area, from_side, target_area, target_side, rule_ord, rule, level): policy rows only, so a link
    later meets its verdicts by one equi lookup instead of being compared with every rule.
    rules (repo, ord, subject, must_not, targets, level).
    """
    places = areas.select("repo", F.col("name").alias("area"), "side").distinct()
    outside = places.select("repo").distinct().select(
        "repo", F.lit(EXTERNALS).alias("area"), F.lit(EXTERNALS).alias("side")
    )
    ends = places.unionByName(outside).select(
        "repo", F.col("area").alias("target_area"), F.col("side").alias("target_side")
    )
    pairs = places.select("repo", F.col("area").alias("from_area"), F.col("side").alias("from_side")).join(ends, "repo")
    named = rules.filter(F.col("must_not") == "depend-on").select(
        "repo", F.col("ord").alias("rule_ord"), F.col("subject").alias("_subject"), "must_not", "level",
        F.posexplode("targets").alias("_pos", "_end"),
    )
    spots = ["repo", "from_area", "from_side", "target_area", "target_side"]
    return (
        pairs.filter(F.col("from_area") != F.col("target_area"))
        .withColumn("_subject", F.explode(F.array_distinct(F.array_compact(F.array("from_area", "from_side")))))
        .withColumn("_end", F.explode(F.array_distinct(F.array_compact(F.array("target_area", "target_side")))))
        .join(named, ["repo", "_subject", "_end"])
        .groupBy(*spots, "rule_ord")
        .agg(F.min_by(F.struct("_subject", "must_not", "_end", "level"), "_pos").alias("r"))
        .select(
            *spots, "rule_ord",
            C.rule_text(F.col("r._subject"), F.col("r.must_not"), F.col("r._end")).alias("rule"),
            F.col("r.level").alias("_level"),
        )
    )


def broken_rules(linked: DataFrame, areas: DataFrame, rules: DataFrame, allows: DataFrame) -> DataFrame:
    """Findings: one per rule-link and rule it breaks, with the allow that covers it."""
    # Policy rows only. Written first, so that Spark sees how few they are and need not shuffle the links for them.
    verdicts = materialize(rule_verdicts(areas, rules), "verdicts")
    same = lambda c: linked[c].eqNullSafe(verdicts[c])
    on = (
        (linked["repo"] == verdicts["repo"])
        & (linked["from_area"] == verdicts["from_area"]) & (linked["target_area"] == verdicts["target_area"])
        & same("from_side") & same("target_side")
    )
    hits = linked.join(verdicts, on).select(
        *[linked[c] for c in linked.columns], "rule_ord", "rule", F.lit("core").alias("origin"),
        C.confidence_level(linked["confidence"], F.col("_level")).alias("level"),
    )
    return cover_allows(hits, allows)


def cover_allows(findings: DataFrame, allows: DataFrame) -> DataFrame:
    """Findings with ``allowed_by`` and ``allowed_reason`` of the first allow that covers them.

    An allow covers a finding of the same rule at its site, item id or ``file:line``, whose target it leaves
    open, equals, or is a parent of. The three forms of a site are three equi lookups on (repo, rule, site);
    a finding stays one row throughout.
    """
    listed = allows.groupBy("repo", "rule", "site").agg(
        F.collect_list(F.struct("ord", "target", "by", "reason")).alias("allows")
    )
    out = findings.withColumn("_place", F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string")))
    for name, spot in (("_a1", "site"), ("_a2", "from"), ("_a3", "_place")):
        side = listed.select("repo", "rule", F.col("site").alias(spot), F.col("allows").alias(name))
        out = out.join(side, ["repo", "rule", spot], "left")
    none = F.array().cast(listed.schema["allows"].dataType)
    met = F.concat(*[F.coalesce(F.col(n), none) for n in ("_a1", "_a2", "_a3")])
    fits = lambda a: (
        a["target"].isNull() | F.coalesce(a["target"] == F.col("target_item"), F.lit(False))
        | C.covers(a["target"], F.col("target"))
    )
    first = F.array_min(F.filter(met, fits))
    return out.withColumn("_first", first).select(
        *findings.columns, F.col("_first.by").alias("allowed_by"), F.col("_first.reason").alias("allowed_reason")
    )


def check_rules(
    items: DataFrame,
    links: DataFrame,
    externals: DataFrame,
    ports: DataFrame,
    areas: DataFrame,
    rules: DataFrame,
    allows: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every finding of the dependency rules, allowed ones included."""
    linked = rule_links(items, links, externals, ports, areas, keys)
    return broken_rules(linked, areas, rules, allows)


def blocks() -> Column:
    return (F.col("level") == "block") & F.col("allowed_by").isNull()


def summarize_findings(findings: DataFrame, repos: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per repo the findings that block, warn and are allowed, and the exit code; repos without any get zeros."""
    counts = findings.groupBy(*keys).agg(
        F.count_if(blocks()).alias("blocking"),
        F.count_if(F.col("allowed_by").isNull() & (F.col("level") != "block")).alias("warnings"),
        F.count_if(F.col("allowed_by").isNotNull()).alias("allowed"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return repos.select(*keys).distinct().join(counts, list(keys), "left").select(
        *keys, zero("blocking"), zero("warnings"), zero("allowed"),
        (F.coalesce("blocking", F.lit(0)) > 0).cast("int").alias("exit_code"),
    )


def sort_findings(findings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """By site, target, rule, witness and kind within each repo: one range-partitioned sort."""
    return findings.orderBy(*keys, "site", "target", "rule", "file", "line", "kind")


def links_between(linked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of rule-links by areas and kind, ``rank`` being the kind's place in the schema."""
    return (
        linked.groupBy(*keys, "from_area", "target_area", "kind")
        .agg(F.count(F.lit(1)).alias("links"))
        .withColumn("rank", C.kind_rank(F.col("kind")).cast("bigint"))
    )


def items_per_area(items: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, area, items) of every area, areas without items included; test code does not count."""
    placed = place_files(items, areas, keys)
    counts = (
        items.filter(C.non_test(F.col("cfg"))).join(placed, [*keys, "file"])
        .groupBy(*keys, "area").agg(F.count(F.lit(1)).alias("_n"))
    )
    named = areas.select("repo", F.col("name").alias("area")).distinct()
    return (
        items.select(*keys).distinct().join(named, "repo").join(counts, [*keys, "area"], "left")
        .select(*keys, "area", F.coalesce("_n", F.lit(0)).cast("bigint").alias("items"))
    )


def unplaced_files(items: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct files of non-test items outside every area."""
    files = items.filter(C.non_test(F.col("cfg"))).select(*keys, "file").distinct()
    return files.join(place_files(files, areas, keys), [*keys, "file"], "left_anti")


def area_reach(areas: DataFrame, rules: DataFrame) -> DataFrame:
    """From each area to each other area and the externals of its repo: the first rule that forbids it, or none.

    A self join of a repo's few areas (equi on repo); rules are met by name at both ends.
    """
    flat = areas.groupBy("repo", "name").agg(F.min_by("side", "ord").alias("side"))
    outer = flat.select("repo").distinct().select("repo", F.lit(EXTERNALS).alias("name"), F.lit(EXTERNALS).alias("side"))
    ends = flat.unionByName(outer).select("repo", F.col("name").alias("to"), F.col("side").alias("to_side"))
    pairs = flat.select("repo", F.col("name").alias("from"), F.col("side").alias("from_side")).join(ends, "repo").filter(
        F.col("from") != F.col("to")
    )
    named = rules.filter(F.col("must_not") == "depend-on").select(
        "repo", "ord", F.col("subject").alias("_s"), F.explode("targets").alias("_t")
    )
    met = (
        pairs.withColumn("_s", F.explode(F.array_compact(F.array("from", "from_side"))))
        .withColumn("_t", F.explode(F.array_compact(F.array("to", "to_side"))))
        .join(named, ["repo", "_s", "_t"], "left")
        .groupBy("repo", "from", "to")
        .agg(F.min("ord").alias("forbidden_by"))
    )
    return met.withColumn("may", F.col("forbidden_by").isNull())


def area_listing(areas: DataFrame) -> DataFrame:
    """Areas by column, order and name; areas without a side or an order come last."""
    rank = F.lit(None).cast("int")
    for side, n in fixed.COLUMN_RANKS.items():
        rank = F.when(F.col("side") == side, n).otherwise(rank)
    listed = areas.groupBy("repo", "name").agg(
        F.min_by("side", "ord").alias("side"), F.min("area_order").alias("area_order")
    )
    return listed.withColumn("rank", rank).orderBy(
        "repo", F.asc_nulls_last("rank"), F.asc_nulls_last("area_order"), "name"
    )
