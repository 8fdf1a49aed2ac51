"""Areas proposed for repos that have none: module groups, their sides, the split, names and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators.ordered import KEYS
from factloom.session import materialize


def source_roots(items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The folder a repo's modules live in: where the first root item's lib.rs is, else main.rs, else ``src/``."""
    at_root = F.when(F.col("module") == "", F.col("file"))
    folder = lambda name: F.when(at_root.endswith(name), F.regexp_replace(at_root, name.replace(".", r"\.") + "$", ""))
    first = lambda name: F.min_by(folder(name), F.when(folder(name).isNotNull(), F.col("pos")))
    return items.groupBy(*keys).agg(F.coalesce(first("lib.rs"), first("main.rs"), F.lit("src/")).alias("root"))


def module_members(items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Items with the top module they belong to and, when deeper, the child module: (keys, id, file, module, child, base…)."""
    root = F.col("root")
    rest = F.substring(F.col("file"), F.length(root) + 1, F.length("file"))
    parts = F.split(F.col("module"), "::")
    top, sub = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    under = F.substring(rest, F.length(top) + 1, F.length(rest))
    in_top = (rest == F.concat(top, F.lit(".rs"))) | rest.startswith(F.concat(top, F.lit("/")))
    in_sub = (under == F.concat(F.lit("/"), sub, F.lit(".rs"))) | under.startswith(F.concat(F.lit("/"), sub, F.lit("/")))
    return (
        items.filter(C.non_test(F.col("cfg")) & (F.col("module") != ""))
        .join(source_roots(items, keys), list(keys))
        .filter(F.col("file").startswith(root) & in_top)
        .select(*keys, "id", "file", "root", top.alias("top"), F.when(in_sub, sub).alias("child"))
    )


def module_groups(
    items: DataFrame, entries: DataFrame, links: DataFrame, externals: DataFrame, ports: DataFrame,
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """What the sides rule reads, per top module (child null) and per child module.

    First table: (keys, top, child, has_file, has_dir, holds_entry, touches_io). Second: (keys, top, child, trait),
    the unit's traits each group implements. Items are grouped once, by child; tops are summed from that.
    """
    members = module_members(items, keys)
    entry_ids = (
        entries.select(*keys, F.col("item").alias("id"))
        .unionByName(route_ends(links, keys).withColumnRenamed("node", "id"))
        .distinct().withColumn("_entry", F.lit(True))
    )
    io_ends = (
        externals.filter(C.is_io(F.col("kind"))).select(*keys, F.lit("external").alias("target_kind"), F.col("id").alias("target_id"))
        .unionByName(
            ports.filter((F.col("side") == "driven") & C.is_io(F.col("kind")))
            .select(*keys, F.lit("port").alias("target_kind"), F.col("id").alias("target_id"))
        )
    )
    touching = (
        links.join(io_ends, [*keys, "target_kind", "target_id"], "left_semi").select(*keys, F.col("from").alias("id"))
        .unionByName(links.filter(F.col("target_kind") == "table").select(*keys, F.col("from").alias("id")))
        .distinct().withColumn("_io", F.lit(True))
    )
    flagged = members.join(entry_ids, [*keys, "id"], "left").join(touching, [*keys, "id"], "left")
    base = F.concat("root", "top", F.coalesce(F.concat(F.lit("/"), "child"), F.lit("")))
    # A child's folder is in its top's folder and its file too, so tops need their own tests of the file.
    top_base = F.concat("root", "top")
    any_of = lambda col: F.coalesce(F.bool_or(col), F.lit(False))
    fine = flagged.groupBy(*keys, "root", "top", "child").agg(
        any_of(F.col("file") == F.concat(base, F.lit(".rs"))).alias("has_file"),
        any_of(F.col("file").startswith(F.concat(base, F.lit("/")))).alias("has_dir"),
        any_of(F.col("file") == F.concat(top_base, F.lit(".rs"))).alias("_top_file"),
        any_of(F.col("file").startswith(F.concat(top_base, F.lit("/")))).alias("_top_dir"),
        any_of("_entry").alias("holds_entry"), any_of("_io").alias("touches_io"),
    )
    flags = ["holds_entry", "touches_io"]
    tops = fine.groupBy(*keys, "root", "top").agg(
        F.bool_or("_top_file").alias("has_file"), F.bool_or("_top_dir").alias("has_dir"),
        *[F.bool_or(f).alias(f) for f in flags],
    ).withColumn("child", F.lit(None).cast("string"))
    cols = [*keys, "root", "top", "child", "has_file", "has_dir", *flags]
    groups = fine.filter(F.col("child").isNotNull()).select(*cols).unionByName(tops.select(*cols))
    traits = items.filter(F.col("kind") == "trait").select(*keys, F.col("id").alias("target_id"))
    made = (
        links.filter((F.col("kind") == "implements") & (F.col("target_kind") == "item"))
        .join(traits, [*keys, "target_id"], "left_semi")
        .select(*keys, F.col("from").alias("id"), F.col("target_id").alias("trait")).distinct()
        .join(members.select(*keys, "id", "top", "child"), [*keys, "id"])
    )
    by_child = made.filter(F.col("child").isNotNull()).select(*keys, "top", "child", "trait").distinct()
    by_top = made.select(*keys, "top", F.lit(None).cast("string").alias("child"), "trait").distinct()
    # A few rows per repo, read by every later step: written once.
    return materialize(groups, "module-groups"), materialize(by_child.unionByName(by_top), "module-traits")


def route_ends(links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both ends of the routes links between items: (keys, node)."""
    routes = links.filter((F.col("kind") == "routes") & (F.col("target_kind") == "item"))
    return (
        routes.select(*keys, F.explode(F.array("from", "target_id")).alias("node")).distinct()
    )


def io_traits(groups: DataFrame, implements: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Traits implemented by an I/O-touching module, at the finest grain: children where a module has any."""
    parents = groups.filter(F.col("child").isNotNull()).select(*keys, "top").distinct()
    leaves = groups.filter("touches_io").filter(F.col("child").isNotNull()).select(*keys, "top", "child").unionByName(
        groups.filter("touches_io").filter(F.col("child").isNull()).join(parents, [*keys, "top"], "left_anti")
        .select(*keys, "top", "child")
    )
    same = ["top", "child"]
    a, b = implements.alias("a"), leaves.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "top"]] + [F.col("a.child").eqNullSafe(F.col("b.child"))]
    return a.join(b, on, "left_semi").select(*keys, "trait").distinct()


def module_sides(groups: DataFrame, implements: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Groups with ``side``: an entry makes it driving, I/O or a trait I/O modules implement driven, else domain."""
    shared = (
        implements.join(io_traits(groups, implements, keys), [*keys, "trait"], "left_semi")
        .select(*keys, "top", F.coalesce("child", F.lit("")).alias("_child")).distinct().withColumn("_shared", F.lit(True))
    )
    side = (
        F.when(F.col("holds_entry"), "driving")
        .when(F.col("touches_io") | F.col("_shared").isNotNull(), "driven").otherwise("domain")
    )
    return (
        groups.withColumn("_child", F.coalesce("child", F.lit("")))
        .join(shared, [*keys, "top", "_child"], "left")
        .withColumn("side", side).drop("_child", "_shared")
    )


def column_rules(
    items: DataFrame, entries: DataFrame, overrides: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, rule): hexagon when a non-test item is an entry, else layers; an override wins."""
    plain = items.filter(C.non_test(F.col("cfg"))).select(*keys, F.col("id").alias("item"))
    with_entry = entries.join(plain, [*keys, "item"], "left_semi").select(*keys).distinct().withColumn("_e", F.lit(True))
    out = items.select(*keys).distinct().join(with_entry, list(keys), "left")
    found = F.when(F.col("_e"), "hexagon").otherwise("layers")
    if overrides is not None:
        out = out.join(overrides.select("repo", "rule"), "repo", "left")
        found = F.coalesce("rule", found)
    return out.select(*keys, found.alias("rule"))


def propose_areas(
    items: DataFrame, entries: DataFrame, links: DataFrame, externals: DataFrame, ports: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """(keys, area, side, area_order, paths, rule): one area per top module, or one per child where a module's
    children mix driving and driven. A child whose name is taken is prefixed with its parent's.

    A child's bare name is free unless it is a top module's that is still whole at that point of the name order,
    or an earlier split module has a child of that name.
    """
    groups, implements = module_groups(items, entries, links, externals, ports, keys)
    rules = column_rules(items, entries, keys=keys)
    sided = materialize(module_sides(groups, implements, keys).join(rules, list(keys)), "module-sides")
    hexagon = F.col("rule") == "hexagon"
    kids = sided.filter(F.col("child").isNotNull())
    mixed = (
        kids.filter(hexagon).groupBy(*keys, "top")
        .agg(F.bool_or(F.col("side") == "driving").alias("a"), F.bool_or(F.col("side") == "driven").alias("b"))
        .filter("a and b").select(*keys, "top")
    )
    tops = sided.filter(F.col("child").isNull())
    whole = tops.join(mixed, [*keys, "top"], "left_anti").withColumn("area", F.col("top"))
    split = kids.join(mixed, [*keys, "top"], "left_semi")
    names = tops.select(*keys, F.col("top").alias("child"), F.lit(True).alias("_is_top"))
    cut = mixed.select(*keys, F.col("top").alias("child"), F.lit(True).alias("_is_cut"))
    marked = split.join(names, [*keys, "child"], "left").join(cut, [*keys, "child"], "left")
    free = F.col("_is_top").isNull() | (F.col("_is_cut").isNotNull() & (F.col("top") >= F.col("child")))
    first = marked.filter(free).groupBy(*keys, "child").agg(F.min("top").alias("_first"))
    named = marked.join(first, [*keys, "child"], "left").withColumn(
        "area", F.when(F.col("top") == F.col("_first"), F.col("child")).otherwise(F.concat("top", F.lit("::"), "child"))
    )
    cols = [*keys, "root", "top", "child", "has_file", "has_dir", "side", "rule", "area"]
    both = whole.select(*cols).unionByName(named.select(*cols))
    base = F.concat("root", "top", F.coalesce(F.concat(F.lit("/"), "child"), F.lit("")))
    paths = F.array_compact(
        F.array(
            F.when(F.col("has_file"), F.concat(base, F.lit(".rs"))), F.when(F.col("has_dir"), F.concat(base, F.lit("/**")))
        )
    )
    side = F.when(hexagon, F.col("side"))
    return area_order(both.select(*keys, "area", side.alias("side"), paths.alias("paths"), "rule"), keys)


def area_order(areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Areas with ``area_order``: the rank of the name, by bytes, within its side; a repo's areas are few."""
    ranks = Window.partitionBy(*keys, "side").orderBy("area")
    return areas.withColumn("area_order", F.row_number().over(ranks))
