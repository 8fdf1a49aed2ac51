"""Snapshots: what changed between two, what must be computed again, and how files become facts again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import graph
from factloom.operators.ordered import KEYS
from factloom.session import materialize


def changed_files(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Paths added, removed or changed: one grouping over both lists; a path listed twice in one list counts."""
    both = before.select(*keys, "path", "file_hash").unionAll(after.select(*keys, "path", "file_hash"))
    return (
        both.groupBy(*keys, "path")
        .agg(F.min("file_hash").alias("_lo"), F.max("file_hash").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_lo") != F.col("_hi")) | (F.col("_n") != 2))
        .select(*keys, "path")
    )


def symmetric_difference(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Paths whose (path, hash) is in only one of the two lists."""
    side = lambda d, n: d.select(*keys, "path", "file_hash").distinct().withColumn("_side", F.lit(n))
    return (
        side(before, 1).unionByName(side(after, 2))
        .groupBy(*keys, "path", "file_hash").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == 1).select(*keys, "path").distinct()
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, copies counted, with ``side``; no rows when the tables are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def assert_same(a: DataFrame, b: DataFrame) -> None:
    """Raise unless two tables hold the same rows: the check of a refresh against a run from scratch."""
    odd = differences(a, b).first()
    if odd is not None:
        raise AssertionError(f"only on the {odd['side']}: {odd}")


def assemble_tree(
    tree_files: DataFrame, file_facts: DataFrame, table: str, assembled: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One table of a tree's facts: its files' deltas by facts key, and the facts derived across files.

    tree_files (keys, path, facts_key); file_facts (facts_key, <table> array); assembled (keys, <table> array).
    """
    found = tree_files.select(*keys, "facts_key").join(file_facts.select("facts_key", table), "facts_key")
    rows = found.select(*keys, F.inline(table))
    if assembled is not None:
        rows = rows.unionByName(assembled.select(*keys, F.inline(table)), allowMissingColumns=True)
    return rows


def missing_file_facts(tree_files: DataFrame, file_facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Files of a tree no delta is kept for, by path."""
    return (
        tree_files.join(file_facts.select("facts_key"), "facts_key", "left_anti")
        .select(*keys, "path", "facts_key").orderBy(*keys, "path")
    )


def item_flags(items: DataFrame, entries: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Items with ``entry`` set where an entry names them, ``reexported`` where a re-exports link ends on them."""
    named = entries.select(*keys, F.col("item").alias("id")).distinct().withColumn("_entry", F.lit(True))
    shown = (
        links.filter((F.col("kind") == "re-exports") & (F.col("target_kind") == "item"))
        .select(*keys, F.col("target_id").alias("id")).distinct().withColumn("_shown", F.lit(True))
    )
    flagged = items.join(named, [*keys, "id"], "left").join(shown, [*keys, "id"], "left")
    off = F.lit(False)
    return (
        flagged.withColumn("entry", F.coalesce("entry", off) | F.coalesce("_entry", off))
        .withColumn("reexported", F.coalesce("reexported", off) | F.coalesce("_shown", off))
        .drop("_entry", "_shown").select(*items.columns)
    )


def worktree_state_hash(files: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SHA-256 over the sorted ``path NUL hash NL`` lines of each tree.

    The hash of one byte stream has to be taken in order, so a tree is one task's stream; the rows pass through
    in batches and only the running digest is kept. The sort before it spills.
    """
    keys = list(keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, running = None, None
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                if key != at:
                    if at is not None:
                        yield pd.DataFrame([[*at, running.hexdigest()]], columns=[*keys, "state_hash"])
                    at, running = key, hashlib.sha256()
                lines = (f"{path}\0{digest}\n" for path, digest in zip(rows["path"], rows["file_hash"]))
                running.update("".join(lines).encode())
        if at is not None:
            yield pd.DataFrame([[*at, running.hexdigest()]], columns=[*keys, "state_hash"])

    ordered = (
        files.select(*keys, "path", "file_hash").repartition(*keys).sortWithinPartitions(*keys, "path")
    )
    return ordered.mapInPandas(stream, ",".join(f"{k} string" for k in [*keys, "state_hash"]))


def tree_ids(files: DataFrame, bits: int = 160, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, dir, id): the object id of every directory, the root being the empty path.

    files (keys, path, mode, id). Directories are hashed from the deepest level up, one grouping per level; a
    level's rows are entries of that level only.
    """
    spark = files.sparkSession
    up = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    depth = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    leaves = materialize(
        files.select(
            *keys, up(F.col("path")).alias("dir"), last(F.col("path")).alias("name"), last(F.col("path")).alias("_by"),
            "mode", "id",
        ).withColumn("_depth", depth(F.col("dir"))),
        "tree-leaves",
    )
    deepest = leaves.agg(F.max("_depth")).first()[0]
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        entries = leaves.filter(F.col("_depth") == level).drop("_depth")
        if below is not None:
            subs = below.filter(F.col("dir") != "").select(
                *keys, up(F.col("dir")).alias("_up"), last(F.col("dir")).alias("name"), "id"
            ).select(
                *keys, F.col("_up").alias("dir"), "name", F.concat("name", F.lit("/")).alias("_by"),
                F.lit("40000").alias("mode"), "id",
            )
            entries = entries.unionByName(subs)
        record = F.concat(F.hex(F.encode(F.concat("mode", F.lit(" "), "name", F.lit("\0")), "UTF-8")), F.upper("id"))
        body = F.unhex(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_by", record.alias("rec")))), lambda e: e["rec"]), ""
            )
        )
        head = F.encode(F.concat(F.lit("tree "), F.octet_length("_body").cast("string"), F.lit("\0")), "UTF-8")
        whole = F.concat(head, F.col("_body"))
        done = entries.groupBy(*keys, "dir").agg(body.alias("_body")).select(
            *keys, "dir", (F.sha1(whole) if bits == 160 else F.sha2(whole, 256)).alias("id")
        )
        below = materialize(done, f"tree-level-{level}")
        levels.append(below)
    out = levels[0] if levels else spark.createDataFrame([], ",".join(f"{k} string" for k in [*keys, "dir", "id"]))
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def package_ids(
    packages: DataFrame, deps: DataFrame, trees: DataFrame, locks: DataFrame, out_dirs: DataFrame,
    header: str = "package 1", keys: Sequence[str] = KEYS,
) -> DataFrame:
    """SHA-256 naming each package by its own tree, its dependencies' trees, build output, lock and analyzer inputs.

    packages (keys, package, dir); deps (keys, name, dep); trees (keys, dir, id); locks (keys, lock, analyzer);
    out_dirs (keys, dir, out). Dev-dependencies do not count.
    """
    treed = packages.join(trees, [*keys, "dir"], "left").select(
        *keys, "package", "dir", F.coalesce("id", F.lit("-")).alias("tree")
    )
    known = packages.select(*keys, F.col("package").alias("to"))
    edges = (
        deps.select(*keys, F.col("name").alias("from"), F.col("dep").alias("to"))
        .join(known, [*keys, "to"], "left_semi").join(known.withColumnRenamed("to", "from"), [*keys, "from"], "left_semi")
    )
    pairs = graph.closure(edges, packages.select(*keys, F.col("package").alias("node")), keys, label="package-ids")
    each = (
        pairs.join(treed.select(*keys, F.col("package").alias("node"), "dir", F.col("tree").alias("_tree")), [*keys, "node"])
        .join(out_dirs.select(*keys, "dir", "out"), [*keys, "dir"], "left")
    )
    # A package depends on many others at most: the lists below hold package names of one repo.
    other = F.col("node") != F.col("start")
    lines = each.groupBy(*keys, F.col("start").alias("package")).agg(
        F.array_sort(F.collect_list(F.when(other, F.concat(F.lit("dep "), "node", F.lit(" "), "_tree", F.lit("\n"))))).alias("_deps"),
        F.array_sort(F.collect_list(F.concat(F.lit("out_dir "), "node", F.lit(" "), "out", F.lit("\n")))).alias("_outs"),
    )
    text = F.concat(
        F.lit(f"{header}\ntree "), "tree", F.lit("\n"), F.array_join("_deps", ""), F.array_join("_outs", ""),
        F.lit("lock "), F.coalesce("lock", F.lit("-")), F.lit("\n"), "analyzer",
    )
    return (
        treed.join(lines, [*keys, "package"]).join(locks, list(keys)).select(*keys, "package", F.sha2(text, 256).alias("id"))
    )


# ---------------------------------------------------------------- incremental refresh


def recompute_scope(
    before: DataFrame, after: DataFrame, deltas: DataFrame, owners: DataFrame, packages: DataFrame,
    deps: DataFrame, dev_deps: DataFrame, unit: DataFrame,
) -> DataFrame:
    """(repo, path, scope) for each file of the new snapshot: what a refresh must compute again.

    ``unit``: everything (first run, a source added or removed, a delta gone, a changed declaration nobody owns);
    ``package``: the file is owned by a package a changed declaration reaches; ``file``: it changed itself;
    ``carry``: its delta is kept.

    before (repo, path, file_hash, facts_key, fingerprint); after (repo, path, file_hash, fingerprint);
    deltas (facts_key); owners (repo, path, package) of the last run; packages and unit (repo, name);
    deps and dev_deps (repo, name, dep).
    """
    keys = ["repo"]
    kept = deltas.select("facts_key").distinct().withColumn("_kept", F.lit(True))
    old = before.select(
        "repo", "path", F.col("file_hash").alias("_hash"), "facts_key", F.col("fingerprint").alias("_print")
    ).join(kept, "facts_key", "left")
    owned = owners.select("repo", "path").distinct().withColumn("_owned", F.lit(True))
    both = (
        old.join(after.select("repo", "path", "file_hash", "fingerprint"), ["repo", "path"], "full")
        .join(owned, ["repo", "path"], "left")
    )
    source = F.col("path").endswith(".rs")
    was, now = F.col("_hash").isNotNull(), F.col("file_hash").isNotNull()
    changed = was & now & (F.col("_hash") != F.col("file_hash"))
    redeclared = changed & F.col("_print").isNotNull() & ~F.col("_print").eqNullSafe(F.col("fingerprint"))
    whole = (
        (source & (was != now)) | (was & now & ~changed & F.col("_kept").isNull())
        | (redeclared & F.col("_owned").isNull())
    )
    marked = materialize(
        both.select("repo", "path", was.alias("_was"), now.alias("_now"), changed.alias("_changed"),
                    redeclared.alias("_redeclared"), whole.alias("_whole")),
        "scope",
    )
    repos = marked.groupBy("repo").agg((F.bool_or("_whole") | ~F.bool_or("_was")).alias("_unit"))
    declared = (
        marked.filter("_redeclared").select("repo", "path").join(owners, ["repo", "path"])
        .select("repo", F.col("package").alias("name")).distinct()
    )
    reached = graph.dependents(packages, deps, dev_deps, declared, keys).join(unit.select("repo", "name"), ["repo", "name"], "left_semi")
    walked = (
        owners.join(reached.withColumnRenamed("name", "package"), ["repo", "package"], "left_semi")
        .select("repo", "path").distinct().withColumn("_walked", F.lit(True))
    )
    scope = (
        F.when(F.col("_unit"), "unit").when(F.col("_walked"), "package")
        .when(F.col("_changed") | ~F.col("_was"), "file").otherwise("carry")
    )
    return (
        marked.filter("_now").join(repos, "repo").join(walked, ["repo", "path"], "left")
        .select("repo", "path", scope.alias("scope"))
    )


def carry_forward(
    before: DataFrame, after: DataFrame, scope: DataFrame, file_facts: DataFrame, recomputed: DataFrame
) -> DataFrame:
    """The new snapshot's deltas: carried ones under their new keys, and the recomputed ones.

    before and after (repo, path, facts_key); file_facts (facts_key, …); recomputed as file_facts, new keys.
    """
    carried = scope.filter(F.col("scope") == "carry").select("repo", "path")
    keys = (
        after.select("repo", "path", F.col("facts_key").alias("_new"))
        .join(carried, ["repo", "path"], "left_semi")
        .join(before.select("repo", "path", "facts_key"), ["repo", "path"])
        .select("facts_key", "_new").distinct()
    )
    moved = file_facts.join(keys, "facts_key").withColumn("facts_key", F.col("_new")).select(*file_facts.columns)
    fresh = recomputed.join(
        after.join(carried, ["repo", "path"], "left_anti").select("facts_key").distinct(), "facts_key", "left_semi"
    )
    return moved.unionByName(fresh.select(*file_facts.columns))


def retired_trees(trees: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Trees to drop after pointers moved: worktree states somebody was on and nobody is now.

    trees (repo, tree_key); before and after (repo, worktree, tree_key).
    """
    left = before.select("repo", "tree_key").distinct().join(after, ["repo", "tree_key"], "left_anti")
    return trees.join(left.filter(F.col("tree_key").startswith("worktree:")), ["repo", "tree_key"], "left_semi")


def prune_file_facts(file_facts: DataFrame, tree_files: DataFrame) -> DataFrame:
    """The deltas some tree still names."""
    return file_facts.join(tree_files.select("facts_key").distinct(), "facts_key", "left_semi")


def pruned_count(file_facts: DataFrame, tree_files: DataFrame) -> DataFrame:
    """How many deltas pruning drops, as one row."""
    gone = file_facts.join(tree_files.select("facts_key").distinct(), "facts_key", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("pruned"))


def view_cache_current(cache: DataFrame, branches: DataFrame) -> DataFrame:
    """Cached views with ``current``: the branch is still on the tree the view was computed at."""
    heads = branches.select("repo", "branch", F.col("tree_key").alias("_head"))
    return cache.join(heads, ["repo", "branch"], "left").withColumn(
        "current", F.col("tree_key").eqNullSafe(F.col("_head"))
    ).drop("_head")


def split_facts(
    items: DataFrame, links: DataFrame, others: dict[str, DataFrame], keys: Sequence[str] = KEYS
) -> dict[str, DataFrame]:
    """Facts by the file whose delta holds them: items by file, links by their from item's file, the rest by
    witness file. Each table comes back with ``delta_file``."""
    homes = items.select(*keys, F.col("id").alias("from"), F.col("file").alias("delta_file"))
    out = {
        "items": items.withColumn("delta_file", F.col("file")),
        "links": links.join(homes, [*keys, "from"]),
    }
    for name, table in others.items():
        out[name] = table.withColumn("delta_file", F.col("file"))
    return out


def join_split(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables put together again."""
    return {name: part.drop("delta_file") for name, part in parts.items()}
