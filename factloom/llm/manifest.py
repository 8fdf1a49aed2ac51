"""Merkle manifest of documents: trees of SHA-256 per language, their root, and proofs climbed by a recursive query.

A leaf hashes a row's fields with their lengths. Leaves of a language ascend by id; every 8 neighbours become the hash of
their hex digests in that order, level by level, until one node remains. The languages' nodes, in order of the language,
form a tree of the same kind, whose last node is the root.

``build`` writes the levels: a *run* is an inner node with its children's digests and the link to its parent. ``climb`` is a
recursive query: a leaf's row joins its run, appends the run's other digests, and puts its own, maybe tampered, digest in
place to get the digest one level up. It appends rows rather than growing one: a proof is the rows of its leaf in order of
level, so that a round holds the digests of that round alone.

Leaves are numbered by range partitions of (language, id) and the partitions' counts, so a language with most of the rows
is many tasks. A run holds 8 digests at most. The recursion takes as many rounds as the tree is high.

Defined cases: null fields are written as ``-``, an empty string as ``0:``; null languages come first, as do null ids, whose
rows are never tampered with; rows with one id in one language are in order of their digests, so repeated rows are leaves
of their own with equal digests; an empty table gives an empty one; a single row is leaf, subroot and root, with the digest
of nothing as its proof; further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import configure, materialize

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the languages' roots.
TOP = -1


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of values with their lengths in bytes before them."""
    shown = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x), F.lit(":"), x), F.lit("-")) for x in shown]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """(doc_id, lang, leaf, changed): the digest of each row, and with ``tamper`` for its text where ``tampered`` holds."""
    changed = [F.when(tampered, tamper).otherwise(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"), leaf_digest(changed).alias("changed"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``idx``, from 0 for each language in order of id and digest, ``tree``, the language's own number, and
    ``last``, the tree's last index."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaf-digests")
    # The row number deals out repeated rows, which are equal in all else.
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    # The number's upper bits are the partition, the lower ones the row in it; writing it makes it last.
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("part", F.shiftright("at", 33)).drop("row"), "leaves")
    counts = ranged.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    starts = starts.withColumn("last", F.sum("n").over(Window.partitionBy("lang")) - 1)
    numbers = counts.select("lang").distinct().withColumn("tree", (F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1).cast("long"))
    starts = starts.join(numbers.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    starts = starts.select(F.col("lang").alias("l"), F.col("part").alias("p"), "start", "tree", "last")
    joined = ranged.join(starts, (F.col("part") == F.col("p")) & F.col("lang").eqNullSafe(F.col("l")))
    return joined.select("doc_id", "lang", "leaf", "changed", "tree", (F.col("start") + F.col("at")).alias("idx"), "last")


def _height() -> Column:
    """Levels above the leaves of a tree: three bits of its last index for each."""
    return F.when(F.col("last") > 0, F.ceil(F.length(F.bin("last")) / 3).cast("int")).otherwise(0)


def levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The written runs (tree, level, idx, children, digest, height) of each level above (tree, idx, digest, last), and
    (tree, height, digest) of each tree's last node."""
    runs: list[DataFrame] = []
    # Nodes carry what is the same in their tree, so that no join is on the tree.
    nodes = nodes.select("tree", "idx", "digest", "last", _height().alias("height"))
    last = nodes.where("last = 0").select("tree", "height", "digest")
    while True:
        more = nodes.where("last > 0").select("tree", "height", F.floor(F.col("last") / FAN).alias("last"), F.floor(F.col("idx") / FAN).alias("idx"), F.struct("idx", "digest").alias("child"))
        grouped = more.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("child")).alias("c"), F.first("last").alias("last"), F.first("height").alias("height"))
        children = grouped.select("tree", F.lit(len(runs) + 1).alias("level"), "idx", F.array_join("c.digest", "").alias("children"), "last", "height")
        built = materialize(children.withColumn("digest", F.sha2("children", 256)), "runs")
        if built.isEmpty():
            return runs, last
        runs.append(built)
        nodes = built.select("tree", "idx", "digest", "last", "height")
        last = last.unionByName(nodes.where("last = 0").select("tree", "height", "digest"))


class Manifest:
    """The written trees of ``leaves`` (tree, idx, digest, last and others).

    ``leaves`` and ``runs`` have the link to their parent: its tree, level and index, and the place among its children; the
    link of a language's last node is to the tree of languages, the root has none. ``subroots`` has each tree's last digest.
    """

    def __init__(self, leaves: DataFrame):
        runs, last = levels(leaves)
        last = materialize(last, "subroots")
        n = last.count()
        upper, top = levels(last.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(n - 1).cast("long").alias("last")))
        self.subroots = last.select("tree", F.col("digest").alias("subroot"))
        root = top.first()
        self.root = root.digest if root else None
        # The languages' tree has no parents above its last node; one language's last node is the root itself.
        single = root is None or root.height == 0
        self.leaves = self._linked(leaves.withColumn("level", F.lit(0)).withColumn("height", _height()), single)
        both = [self._linked(x, single) for x in upper + runs]
        columns = ("tree", "level", "idx", "children", "parent_tree", "parent_level", "parent_idx", "place")
        spark = leaves.sparkSession
        self.runs = spark.createDataFrame([], RUNS)
        if both:
            rows = both[0].select(*columns)
            for x in both[1:]:
                rows = rows.unionByName(x.select(*columns))
            self.runs = materialize(rows.withColumn("children", F.unhex("children")), "linked-runs")

    @staticmethod
    def _linked(nodes: DataFrame, single: bool) -> DataFrame:
        ended = F.col("level") == F.col("height")
        out = (F.col("tree") == TOP) | F.lit(single)
        in_tree = F.when(~ended, F.col("tree"))
        up = [
            F.when(ended & ~out, F.lit(TOP).cast("long")).otherwise(in_tree), F.when(ended & ~out, F.lit(1)).when(~ended, F.col("level") + 1),
            F.when(ended & ~out, F.floor(F.col("tree") / FAN)).when(~ended, F.floor(F.col("idx") / FAN)),
            F.when(ended & ~out, F.col("tree") % FAN).when(~ended, F.col("idx") % FAN).cast("int"),
        ]
        return nodes.select("*", *[c.alias(n) for c, n in zip(up, ("parent_tree", "parent_level", "parent_idx", "place"), strict=True)])


RUNS = "tree long, level int, idx long, children binary, parent_tree long, parent_level int, parent_idx long, place int"

#: A row of the climb: the digest one level up, and the digests beside the one below it. The first row of a leaf has its own columns.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree AS of_tree, idx AS of_idx, doc_id, digest AS leaf, 0 AS round, parent_tree, parent_level, parent_idx, place,
    unhex(changed) AS folded, CAST('' AS BINARY) AS siblings FROM {leaves}
  UNION ALL
  SELECT c.of_tree, c.of_idx, CAST(NULL AS BIGINT), CAST(NULL AS STRING), c.round + 1, r.parent_tree, r.parent_level, r.parent_idx, r.place,
    unhex(sha2(lower(hex(concat(substr(r.children, 1, 32 * c.place), c.folded, substr(r.children, 32 * c.place + 33)))), 256)),
    concat(substr(r.children, 1, 32 * c.place), substr(r.children, 32 * c.place + 33))
  FROM climb c JOIN {runs} r ON c.parent_tree = r.tree AND c.parent_level = r.level AND c.parent_idx = r.idx)
SELECT * FROM climb"""


def climb(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Rows of each leaf's way to the root, one a level."""
    # Rows of a recursion have no bound but the tree's height for each leaf.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(CLIMB, leaves=manifest.leaves, runs=manifest.runs)


def verify(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of each row: the manifest is of the given rows, the
    climb of rows whose text is ``tamper`` where ``tampered`` holds. A proof is the digest of its siblings' hex digests."""
    spark = configure(docs.sparkSession)
    rows = placed(leaves(docs, tampered, tamper)).withColumnRenamed("leaf", "digest")
    manifest = Manifest(rows)
    steps = climb(spark, manifest)
    whole = steps.groupBy("of_tree", "of_idx").agg(
        F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"), F.max_by("folded", "round").alias("folded"),
        F.array_sort(F.collect_list(F.struct("round", "siblings"))).alias("steps"),
    )
    folded = F.lower(F.hex("folded"))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.lower(F.hex(s["siblings"]))), ""), 256)
    root = F.lit(manifest.root).cast("string")
    return whole.join(manifest.subroots, F.col("of_tree") == F.col("tree")).select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof.alias("proof"), folded.alias("folded_root"), (folded == root).alias("verified")
    )
