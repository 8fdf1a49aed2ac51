"""Readers and writers of fact documents, per-file deltas and snapshot tables."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom import schemas
from factloom.fixed import DOT_FOLDERS, TOP_DOT_FOLDERS
from factloom.functions import columns as C
from factloom.operators.ordered import KEYS, last_by
from factloom.sources.versions import Log

FORMAT_VERSION = 1


def read_facts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Fact documents, one row each, keyed by repo and tree_key; absent arrays are null.

    One document per file, or one per line with ``lines`` (that form splits across tasks). A document that is
    not JSON of the declared shape fails the read, as does another schema version.
    """
    docs = (
        spark.read.schema(schemas.FACTS).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    )
    version = F.coalesce(F.col("schema_version"), F.lit(-1))
    checked = F.when(version == FORMAT_VERSION, version).otherwise(
        F.raise_error(F.concat(F.lit("unknown schema version "), version.cast("string"))).cast("int")
    )
    return docs.select(
        F.col("repo.name").alias("repo"), C.tree_key(F.lit("commit"), F.col("repo.commit")).alias("tree_key"),
        checked.alias("schema_version"), F.col("repo.unit").alias("unit"), "analyzer", *schemas.ARRAYS,
    )


def unknown_fields(spark: SparkSession, path: str) -> DataFrame:
    """(repo, field) of top-level fields no schema names, in documents given one per line."""
    known = [f.split(" ")[0] for f in ("schema_version", "repo", "analyzer", *schemas.ARRAYS)]
    fields = F.json_object_keys("value")
    return (
        spark.read.text(path)
        .select(F.get_json_object("value", "$.repo.name").alias("repo"), F.explode(fields).alias("field"))
        .filter(~F.col("field").isin(known))
    )


def flat(docs: DataFrame, table: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One array of the documents as a flat table, with ``pos`` and the keys in front."""
    exploded = docs.select(*keys, F.posexplode(table).alias("pos", "_e"))
    return exploded.select(*keys, F.col("pos").cast("bigint").alias("pos"), *_fields(table, F.col("_e")))


def _fields(table: str, element: Column) -> list[Column]:
    out = []
    for name, path in schemas.FLAT[table].items():
        value = element
        for part in path.split("."):
            value = value[part]
        out.append((F.coalesce(value, F.lit(False)) if name in schemas.BOOLEANS else value).alias(name))
    if table == "links":
        to = element["to"]
        out.append(
            F.when(to["item"].isNotNull(), "item").when(to["port"].isNotNull(), "port")
            .when(to["external"].isNotNull(), "external").when(to["table"].isNotNull(), "table").alias("target_kind")
        )
        out.append(F.coalesce(to["item"], to["port"], to["external"], to["table"]).alias("target_id"))
    return out


def nested_item() -> Column:
    """A flat item row as the struct of a document."""
    none = F.lit(None).cast("string")
    c = F.col
    return F.struct(
        c("id"), c("kind"), c("name"), c("file"),
        F.struct(c("line"), c("col"), c("end_line"), F.lit(1).cast("bigint").alias("end_col")).alias("span"),
        c("crate"), c("module"), none.alias("parent"), c("visibility"), F.when(c("reexported"), True).alias("reexported"),
        F.struct(
            F.when(c("entry"), True).alias("entry"), F.lit(None).cast("boolean").alias("unsafe"),
            F.lit(None).cast("boolean").alias("drop"), F.lit(None).cast("boolean").alias("generated"), c("cfg"),
        ).alias("flags"),
        none.alias("scope"),
    )


def nested_link() -> Column:
    none = F.lit(None).cast("string")
    c = F.col
    target = lambda kind: F.when(c("target_kind") == kind, c("target_id")).alias(kind)
    return F.struct(
        c("from"), F.struct(target("item"), target("port"), target("external"), target("table")).alias("to"),
        c("member"), c("kind"), c("confidence"),
        F.struct(
            F.lit("span").alias("kind"), c("file"), c("line"), F.lit(None).cast("bigint").alias("col"),
            none.alias("tool"), none.alias("output_sha256"),
        ).alias("witness"),
        F.struct(
            C.link_origin(c("kind")).alias("origin"), none.alias("access"),
            F.when(C.is_compile_time(c("kind")), True).alias("compile_time"), F.lit(None).cast("boolean").alias("unsafe"),
        ).alias("flags"),
        none.alias("reason"),
    )


def write_canonical_facts(tables: dict[str, DataFrame], path: str, keys: Sequence[str] = KEYS, compression: str = "none") -> None:
    """Write facts so that equal facts give equal lines in equal order, empty values left out.

    tables: array name → (keys, sort key columns "_k1" …, "element"). Each repo snapshot becomes a folder of JSON
    lines ``{"table":…,"element":…}`` sorted by table and key. A document is never held whole: the sort is range
    partitioned, and a large snapshot is several files read in name order.
    """
    rows = None
    for n, name in enumerate(sorted(tables)):
        part = tables[name].select(
            *keys, F.lit(n).alias("_n"), F.col("sort_key").cast("array<string>").alias("_key"),
            F.to_json(F.struct(F.lit(name).alias("table"), F.col("element")), {"ignoreNullFields": "true"}).alias("value"),
        )
        rows = part if rows is None else rows.unionByName(part)
    ordered = rows.repartitionByRange(*keys, "_n", "_key").sortWithinPartitions(*keys, "_n", "_key")
    ordered.select(*keys, "value").write.partitionBy(*keys).mode("overwrite").option("compression", compression).text(path)


def read_canonical(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The elements of one table of canonical fact lines, as JSON text."""
    lines = spark.read.schema("value string,repo string,tree_key string").text(path)
    return lines.filter(F.get_json_object("value", "$.table") == table).select(
        "repo", "tree_key", F.get_json_object("value", "$.element").alias("element")
    )


def read_file_facts(deltas: DataFrame) -> DataFrame:
    """Per-file deltas held as JSON text under a facts key, with their arrays parsed; bad text fails."""
    parsed = F.from_json("facts", schemas.FILE_FACTS, {"mode": "FAILFAST"})
    return deltas.select(*[c for c in deltas.columns if c != "facts"], parsed.alias("_f")).select(
        *[c for c in deltas.columns if c not in ("facts", "path", "file_hash", "degraded")], "_f.*"
    )


def _write_files(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """A file per row; names are by partition and place, so a task that runs again writes the same files."""
    system, root = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    part, made, n = TaskContext.get().partitionId(), set(), 0
    for batch in batches:
        for folder, content in zip(*(batch.column(c).to_pylist() for c in ("folder", "content")), strict=True):
            if folder not in made:
                system.create_dir(f"{root}/{folder}", recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{root}/{folder}/part-{part:05d}-{n}.txt") as out:
                out.write(content)
            n += 1
    yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})


def write_files(rows: DataFrame, path: str) -> int:
    """Write (folder, content) as one file a row under a folder that ``pyarrow.fs`` reads; returns their number.

    The tasks make the files themselves: a sink moves each one on the driver when it commits, and asks the shell for its mode.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    uri = system.makeQualified(folder).toString()
    content = F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary"))
    written = rows.select("folder", content.alias("content")).mapInArrow(partial(_write_files, uri=uri), "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def _dot_roots(spark: SparkSession, path: str) -> list[str]:
    """The dot folders that a scan enters. Spark's listing goes into none, so they are roots of their own."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    deepest = listed.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    globs = [f"{path}/{d}" for d in TOP_DOT_FOLDERS] + [f"{path}/{'*/' * n}{d}" for d in DOT_FOLDERS for n in range(deepest)]
    return [str(s.getPath()) for g in globs for s in system.globStatus(hadoop(g)) or []]


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, file_hash) of the files under a folder.

    Left out are folders named ``target`` and dot folders at any level, but for those that ``fixed`` names.
    """
    path = path.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load([path, *_dot_roots(spark, path)])
        .select(F.col("path").alias("_full"), "content")
    )
    rel = F.regexp_replace("_full", r"^.*?" + re.escape(path) + "/+", "")
    dirs = F.filter(F.split(F.regexp_replace(rel, r"/?[^/]*$", ""), "/"), lambda d: d != "")
    shown = lambda d, i: ~d.startswith(".") | d.isin(*DOT_FOLDERS) | ((i == 0) & d.isin(*TOP_DOT_FOLDERS))
    left_out = F.exists(F.transform(dirs, lambda d, i: (d == "target") | ~shown(d, i)), lambda out: out)
    return files.filter(~left_out).select(rel.alias("path"), "content", F.sha2("content", 256).alias("file_hash"))


def read_lock_packages(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Package names of lock texts with the line that declares each first: (keys, key, name, line)."""
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("_n", "_line"))
    named = lines.select(
        *keys, F.regexp_extract("_line", r'^name = "([^"]*)"', 1).alias("name"), (F.col("_n") + 1).cast("bigint").alias("line")
    ).filter(F.col("name") != "")
    return (
        named.groupBy(*keys, F.replace("name", F.lit("-"), F.lit("_")).alias("key"))
        .agg(F.min_by("name", "line").alias("name"), F.min("line").alias("line"))
    )


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Recorded sizes, one JSON object per file."""
    return spark.read.schema(schemas.SIZES).option("multiLine", True).option("mode", "FAILFAST").json(path)


# ---------------------------------------------------------------- snapshot tables


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions ``df`` has rows for; a large partition is spread over several writers."""
    (
        df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by).parquet(path)
    )


def read_tree_tables(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A snapshot table; filters on its partition columns (tree_key, branch …) prune folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def strangers(deltas: DataFrame, files: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Deltas whose path is no file of their tree."""
    return deltas.join(files, [*keys, "path"], "left_anti")


TREE_TABLES = ("tree_files", "tree_commits", "file_facts")


def tree_log(spark: SparkSession, path: str) -> Log:
    """The commits of a snapshot store; an entry is the version that a put wrote."""
    return Log(spark, f"{path}/log")


def put_tree(
    files: DataFrame, deltas: DataFrame, commits: DataFrame, path: str, keys: Sequence[str] = KEYS,
    trees: DataFrame | None = None, after: int | None = None,
) -> int:
    """Replace whole trees: files, commits in order, deltas. Refuses a delta of a file outside its tree.

    deltas (keys, facts_key, path, …), commits (keys, ord, hash, …). The trees are those of files and commits, and those
    of ``trees`` (keys), which may be left empty. All are replaced at once, by the entry of the log that is made last: a
    put that stops before leaves every old tree whole, and a tree keeps no row of what it replaced. Of puts at the same
    time the later entry holds; with ``after``, the number of the last entry the caller has seen, a put fails with
    ``Conflict`` if there is a newer one. Returns the entry's number.
    """
    spark = files.sparkSession
    keys = list(keys)
    stranger = strangers(deltas, files, keys).select(*keys, "path").first()
    if stranger is not None:
        raise ValueError(f"delta for {stranger['path']}, which is not a file of {stranger[len(keys) - 1]}")
    version = uuid.uuid4().hex
    named = files.select(*keys).unionByName(commits.select(*keys))
    if trees is not None:
        named = named.unionByName(trees.select(*keys))
    for table, rows in zip(TREE_TABLES, (files, commits, deltas), strict=True):
        rows.hint("rebalance", *keys).write.partitionBy(*keys).parquet(f"{path}/{table}/version={version}")
    named.distinct().write.parquet(f"{path}/trees/version={version}")
    return tree_log(spark, path).append(version, after)


def current_trees(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, at: int | None = None) -> DataFrame:
    """(keys, version) of each tree as of the last entry of the log, or of entry ``at``."""
    keys = list(keys)
    entries = {n: v for n, v in tree_log(spark, path).entries().items() if at is None or n <= at}
    schema = ",".join(f"`{k}` string" for k in keys)
    if not entries:
        return spark.createDataFrame([], f"{schema},version string")
    order = spark.createDataFrame([(v, n) for n, v in entries.items()], "version string,_n bigint")
    # Only folders of versions in the log are read.
    named = spark.read.option("basePath", f"{path}/trees").schema(f"{schema},version string").parquet(*[f"{path}/trees/version={v}" for v in entries.values()])
    return last_by(named.join(F.broadcast(order), "version"), keys, ["_n"]).select(*keys, "version")


def read_trees(spark: SparkSession, path: str, table: str, schema: str, keys: Sequence[str] = KEYS, at: int | None = None) -> DataFrame:
    """The rows of the current trees of a table, with columns ``schema`` (the keys among them)."""
    now = current_trees(spark, path, keys, at)
    columns = [f.name for f in StructType.fromDDL(schema).fields]
    try:
        rows = spark.read.schema(f"{schema},version string").parquet(f"{path}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.join(now, [*keys, "version"]).select(*columns)


def compact_trees(spark: SparkSession, path: str, schemas_of: dict[str, str], keys: Sequence[str] = KEYS) -> int:
    """Write the current trees as one version, so that all others can be pruned. Fails with ``Conflict``, and changes nothing,
    if a put came in between."""
    last = (tree_log(spark, path).numbers() or [-1])[-1]
    tables = [read_trees(spark, path, t, schemas_of[t], keys, last) for t in TREE_TABLES]
    return put_tree(tables[0], tables[2], tables[1], path, keys, current_trees(spark, path, keys, last), last)


def prune_trees(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, older_ms: int = 86_400_000) -> list[str]:
    """Remove versions that no tree is on, and those of puts that never came to their entry; returns them.

    Younger versions than ``older_ms`` stay, for a put may be on its way to its entry, or a reader in the old one. A
    version's tables go before its entry: a prune that stops half-way leaves an entry of which no tree is current.
    """
    log = tree_log(spark, path)
    entries = log.entries()
    # One row per version that is still in use, not per tree.
    used = {r.version for r in current_trees(spark, path, keys).select("version").distinct().collect()}
    newest = time.time() * 1000 - older_ms
    stale = set()
    for table in (*TREE_TABLES, "trees"):
        stale |= {v for v, changed in log.folders(f"{path}/{table}", "version=").items() if changed < newest}
    stale -= used | {v for n, v in entries.items() if n == max(entries)}
    for version in sorted(stale):
        for table in TREE_TABLES:
            log.drop(f"{path}/{table}/version={version}")
    for n, version in entries.items():
        if version in stale:
            log.remove(n)
    for version in sorted(stale):
        log.drop(f"{path}/trees/version={version}")
    return sorted(stale)


def upsert(old: DataFrame, new: DataFrame, pk: Sequence[str], version: str) -> DataFrame:
    """Rows by primary key, the highest version winning: insert or replace."""
    return last_by(old.unionByName(new), pk, [version])


def delete_by_key(old: DataFrame, gone: DataFrame, pk: Sequence[str]) -> DataFrame:
    return old.join(gone, list(pk), "left_anti")
