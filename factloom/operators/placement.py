"""Which area and side files, items and sites sit in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators.ordered import KEYS

OUTSIDE = "outside every area"


def place_files(files: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, file, area, side) of the files some area claims: the first area with a matching glob.

    files (keys, file); areas (repo, ord, name, side, glob), one row per glob. A glob is found by its literal
    start: the folder before its first wildcard, or the whole path if it has none. Each distinct file looks up
    its ancestors there, so its regexes are those of globs that begin like it; only globs that start with a
    wildcard meet every file of their repo. The join on (repo, folder) is Spark's choice by the policy's size,
    and a shuffled one has a hot repo's files spread over its folders.
    """
    globs = areas.select(
        "repo", "ord", F.col("name").alias("area"), "side", C.glob_folder(F.col("glob")).alias("_folder"),
        C.glob_regex(F.col("glob")).alias("_re"),
    )
    spots = files.select(*keys, "file").distinct().withColumn("_folder", F.explode(F.array_distinct(C.ancestors(F.col("file")))))
    hits = spots.join(globs, ["repo", "_folder"]).filter(F.rlike("file", F.col("_re")))
    return (
        hits.groupBy(*keys, "file").agg(F.min_by(F.struct("area", "side"), "ord").alias("p")).select(*keys, "file", "p.*")
    )


def place_items(items: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The items some area claims, with ``area`` and ``side``."""
    return items.join(place_files(items, areas, keys), [*keys, "file"])


def unplaced_items(items: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Items no area claims."""
    return items.join(place_files(items, areas, keys), [*keys, "file"], "left_anti")


def resolve_sites(
    sites: DataFrame, items: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Where a site sits: an item id, else an area name, else a file path.

    sites (keys, site) → (keys, site, area, side, position), position being the text form.
    """
    wanted = sites.select(*keys, "site").distinct()
    by_item = wanted.join(items.select(*keys, F.col("id").alias("site"), "file"), [*keys, "site"])
    files = by_item.select(*keys, "file").unionByName(wanted.select(*keys, F.col("site").alias("file")))
    placed = place_files(files, areas, keys)
    item_place = by_item.join(placed, [*keys, "file"], "left").select(
        *keys, "site", F.lit(True).alias("_is_item"), F.struct("area", "side").alias("_item")
    )
    named = (
        areas.groupBy("repo", "name").agg(F.min_by("side", "ord").alias("side"))
        .select("repo", F.col("name").alias("site"), F.struct(F.col("name").alias("area"), "side").alias("_area"))
    )
    file_place = placed.select(*keys, F.col("file").alias("site"), F.struct("area", "side").alias("_file"))
    place = F.when(F.col("_is_item"), F.col("_item")).otherwise(F.coalesce("_area", "_file"))
    return (
        wanted.join(item_place, [*keys, "site"], "left")
        .join(named, ["repo", "site"], "left")
        .join(file_place, [*keys, "site"], "left")
        .withColumn("_place", place)
        .select(
            *keys, "site", F.col("_place.area").alias("area"), F.col("_place.side").alias("side"),
            position_text(F.col("_place.area"), F.col("_place.side")).alias("position"),
        )
    )


def position_text(area: Column, side: Column) -> Column:
    return F.when(area.isNull(), OUTSIDE).otherwise(
        F.concat(F.lit("area `"), area, F.lit("` ("), F.coalesce(side, F.lit("no side")), F.lit(")"))
    )


def package_of_file(
    files: DataFrame, owners: DataFrame, packages: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The package id that names a file: its owners joined by commas in order, else the innermost package
    whose directory holds it, else the unit.

    files (keys, path); owners (keys, path, pos, package); packages (keys, package, dir). → (keys, path, package)
    """
    owned = (
        owners.groupBy(*keys, "path")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "package"))).alias("o"))
        .select(*keys, "path", F.array_join(F.transform("o", lambda x: x["package"]), ",").alias("_owned"))
    )
    return (
        files.select(*keys, "path").distinct()
        .join(innermost(files, packages.select(*keys, "dir", "package"), keys), [*keys, "path"], "left")
        .join(owned, [*keys, "path"], "left")
        .select(*keys, "path", F.coalesce("_owned", "package", F.lit("unit")).alias("package"))
    )


def innermost(files: DataFrame, dirs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The deepest directory holding each path: ancestors exploded, an equi join, the longest kept.

    files (keys, path); dirs (keys, dir, …) → (keys, path, dir, …)
    """
    rest = [c for c in dirs.columns if c not in [*keys, "dir"]]
    up = files.select(*keys, "path").distinct().withColumn("dir", F.explode(F.array_distinct(C.ancestors(F.col("path")))))
    return (
        up.join(dirs, [*keys, "dir"])
        .groupBy(*keys, "path")
        .agg(F.max_by(F.struct("dir", *rest), F.length("dir")).alias("d"))
        .select(*keys, "path", "d.*")
    )
