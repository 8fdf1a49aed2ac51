"""Facts that span files, from what each file notes: entries, tables, externals, wiring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators.ordered import KEYS, first_by, numbered
from factloom.session import materialize

NOT_WALKED = 2**32 - 1


def walk_positions(notes: DataFrame, walk: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Notes with ``walk_pos``: the place in the walk of the visit they were made in; files not walked sort last.

    notes (keys, path, visit, …), visits counted from 0; walk (keys, pos, path).
    """
    visits = numbered(walk, [*keys, "path"], ["pos"], F.floor(F.col("pos") / 1_000_000), "_nth").select(
        *keys, "path", (F.col("_nth") - 1).alias("visit"), F.col("pos").alias("_pos")
    )
    return notes.join(visits, [*keys, "path", "visit"], "left").withColumn(
        "walk_pos", F.coalesce("_pos", F.lit(NOT_WALKED)).cast("bigint")
    ).drop("_pos")


def first_claims(mains: DataFrame, routes: DataFrame, workers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One entry per item: main, then routes in walk order, then workers; the first claim wins.

    mains (keys, item, file, line); routes (keys, phase, walk_pos, seq, item, framework, file, line);
    workers (keys, target, file, line, in_main).
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    cols = lambda d, rank, kind, framework, confidence, order: d.select(
        *keys, "item", F.lit(kind).alias("kind"), framework.alias("framework"), confidence.alias("confidence"), "file", "line",
        F.struct(F.lit(rank).alias("rank"), *[o.cast("bigint").alias(f"o{n}") for n, o in enumerate(order)]).alias("_order"),
    )
    claims = (
        cols(mains, 0, "main", none, F.lit("resolved"), [zero, zero, zero])
        .unionByName(cols(routes, 1, "framework", F.col("framework"), F.lit("guessed"), [F.col("phase"), F.col("walk_pos"), F.col("seq")]))
        .unionByName(
            cols(workers.withColumnRenamed("target", "item"), 2, "spawned-worker", none,
                 F.when(F.col("in_main"), "resolved").otherwise("guessed"), [zero, zero, zero])
        )
    )
    return first_by(claims, [*keys, "item"], ["_order"]).drop("_order")


def route_ports(routes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One driving http port per route name: the first registration in walk order."""
    return first_by(
        routes.select(*keys, F.concat(F.lit("port:http:"), "name").alias("id"), "name", "file", "line", "phase", "walk_pos", "seq"),
        [*keys, "id"], ["phase", "walk_pos", "seq"],
    ).select(*keys, "id", "name", F.lit("http").alias("kind"), F.lit("driving").alias("side"), F.lit("unresolved").alias("section"), "file", "line")


def queue_tables(created: DataFrame, sql: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Created tables with ``queue``: whether some function dequeues from them.

    created (keys, name, file, line); sql (keys, owner, table, inserts, dequeues).
    """
    dequeued = sql.filter("dequeues").select(*keys, F.col("table").alias("name")).distinct().withColumn("_q", F.lit(True))
    return created.join(dequeued, [*keys, "name"], "left").select(
        *keys, "name", "file", "line", F.coalesce("_q", F.lit(False)).alias("queue"))


def queue_users(created: DataFrame, sql: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, name, role, owner): who inserts into and who dequeues from the queue tables, each once.

    Rows and not lists: a table every function writes to stays spread out.
    """
    queues = queue_tables(created, sql, keys).filter("queue").select(*keys, "name").distinct()
    roles = F.array_compact(F.array(F.when(F.col("inserts"), "inserter"), F.when(F.col("dequeues"), "dequeuer")))
    uses = sql.select(*keys, F.col("table").alias("name"), "owner", F.explode(roles).alias("role"))
    return uses.join(queues, [*keys, "name"], "left_semi").select(*keys, "name", "role", "owner").distinct()


def queue_inserters(sql: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Queues links of functions that insert into a table someone dequeues: where a reads link to the table exists and
    no queues link yet; the witness is the reads link's."""
    dequeued = sql.filter("dequeues").select(*keys, "table").distinct()
    inserters = sql.filter("inserts").join(dequeued, [*keys, "table"], "left_semi").select(
        *keys, F.col("owner").alias("from"), F.col("table").alias("target_id")
    ).distinct()
    plain = links.filter((F.col("target_kind") == "table") & F.col("member").isNull())
    reads = first_by(
        plain.filter(F.col("kind") == "reads").select(*keys, "from", "target_id", "file", "line"),
        [*keys, "from", "target_id"], ["file", "line"],
    )
    queued = plain.filter(F.col("kind") == "queues").select(*keys, "from", "target_id").distinct()
    return (
        reads.join(inserters, [*keys, "from", "target_id"], "left_semi")
        .join(queued, [*keys, "from", "target_id"], "left_anti")
        .select(*keys, "from", F.lit("table").alias("target_kind"), "target_id", F.lit("queues").alias("kind"),
                F.lit("guessed").alias("confidence"), F.lit("write").alias("access"), "file", "line")
    )


def touched_surface(touched: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per external package the sorted union of the paths touched in any file: (keys, package, paths).

    touched (keys, package, paths): one array per file; distinct paths are found before they are listed.
    """
    each = touched.select(*keys, "package", F.explode("paths").alias("path")).distinct()
    return each.groupBy(*keys, "package").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def sql_externals(
    sql: DataFrame, created: DataFrame, drivers: DataFrame, manifests: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One database external and port per repo that touches a table, or creates one and depends on the driver.

    sql (keys, table); created (keys, file, line); drivers (keys, pos, file, line, features): the driver dependency of
    unit packages in order; manifests (keys, file): every repo's main manifest.
    """
    tables = sql.select(*keys, "table").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("table")).alias("touched"))
    made = created.groupBy(*keys).agg(F.min(F.struct("file", "line")).alias("_made"))
    driver = drivers.groupBy(*keys).agg(F.min_by(F.struct("file", "line", "features"), "pos").alias("_driver"))
    dialect = F.coalesce(*[F.when(F.array_contains("_driver.features", d), d) for d in fixed.DIALECTS], F.lit("sql"))
    place = F.coalesce(
        F.when(F.col("_driver").isNotNull(), F.struct(F.col("_driver.file").alias("file"), F.col("_driver.line").cast("bigint").alias("line"))),
        F.when(F.col("_made").isNotNull(), F.struct(F.col("_made.file").alias("file"), F.col("_made.line").cast("bigint").alias("line"))),
        F.struct(F.col("_manifest").alias("file"), F.lit(1).cast("bigint").alias("line")),
    )
    return (
        manifests.select(*keys, F.col("file").alias("_manifest"))
        .join(tables, list(keys), "left").join(made, list(keys), "left").join(driver, list(keys), "left")
        .filter(F.col("touched").isNotNull() | (F.col("_made").isNotNull() & F.col("_driver").isNotNull()))
        .select(*keys, dialect.alias("name"), "touched", place.alias("_p"))
        .select(*keys, F.concat(F.lit("external:sql:"), "name").alias("id"), F.concat(F.lit("port:sql:"), "name").alias("port"),
                "name", F.coalesce("touched", F.array().cast("array<string>")).alias("touched"), F.col("_p.file").alias("file"),
                F.col("_p.line").alias("line"))
    )


def first_per_host(hosts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per host the earliest note in walk order: (keys, host, file, line)."""
    return first_by(
        hosts.select(*keys, "host", "file", "line", "phase", "walk_pos", "seq"), [*keys, "host"], ["phase", "walk_pos", "seq", "file"]
    ).select(*keys, "host", "file", "line")


def first_terminal_write(writes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per repo the earliest direct write to the terminal: (keys, file, line)."""
    return first_by(
        writes.select(*keys, "file", "line", "phase", "walk_pos", "seq"), list(keys), ["phase", "walk_pos", "seq", "file"]
    ).select(*keys, "file", "line")


def dependency_witness(
    packages: DataFrame, declared: DataFrame, locked: DataFrame, manifests: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Where an external package is declared: the first unit package's manifest line, else the lock line, else line 1
    of the main manifest.

    packages (keys, package); declared (keys, package, pos, file, line); locked (keys, name, line); manifests (keys, file).
    """
    dep = declared.groupBy(*keys, "package").agg(F.min_by(F.struct("file", F.col("line").cast("bigint").alias("line")), "pos").alias("_dep"))
    lock = locked.groupBy(*keys, F.col("name").alias("package")).agg(
        F.struct(F.lit("Cargo.lock").alias("file"), F.min("line").cast("bigint").alias("line")).alias("_lock")
    )
    main = manifests.select(*keys, F.struct("file", F.lit(1).cast("bigint").alias("line")).alias("_main"))
    return (
        packages.select(*keys, "package").distinct()
        .join(dep, [*keys, "package"], "left").join(lock, [*keys, "package"], "left").join(main, list(keys), "left")
        .withColumn("w", F.coalesce("_dep", "_lock", "_main"))
        .select(*keys, "package", F.col("w.file").alias("file"), F.col("w.line").alias("line"))
    )


def classify_links(uses: DataFrame) -> DataFrame:
    """Uses of a target as links: (target_kind, context, …) → kind, member, access; uses that make no link drop out.

    uses (…, target_kind, context, field, is_test, is_self, in_trait, spawned): the decision table is fixed and small.
    """
    spark: SparkSession = uses.sparkSession
    table = spark.createDataFrame(fixed.USE_TABLE, "target_kind string,context string,_kind string,access string")
    call = (F.col("target_kind") == "fn") & (F.col("context") == "call")
    kind = (
        F.when(call & F.col("is_test"), "tests").when(call & F.col("in_trait"), "calls-port").otherwise(F.col("_kind"))
    )
    member = F.when(F.col("context") == "field", F.col("field")).when(F.col("target_kind") == "variant", F.col("field"))
    member = F.when(kind.isin("holds") | (F.col("target_kind") == "variant"), member)
    self_type = F.col("is_self") & (F.col("context") == "type") & F.col("target_kind").isin("struct", "union", "enum", "type-alias")
    return (
        uses.join(F.broadcast(table), ["target_kind", "context"])
        .filter(~(call & F.col("spawned")) & ~self_type)
        .withColumn("kind", kind).withColumn("member", member).drop("_kind")
    )


def dedupe_links(links: DataFrame, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The first link of each (from, target, kind, member)."""
    return first_by(links, [*keys, "from", "target_kind", "target_id", "kind", "member"], order)


def unique_ids(items: DataFrame, chunk: int = 1_000_000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Items whose repeated ids get ``.2``, ``.3`` … in visit order (``pos``)."""
    ranked = numbered(items, [*keys, "id"], ["pos"], F.floor(F.col("pos") / chunk), "_nth")
    again = F.concat("id", F.lit("."), F.col("_nth").cast("string"))
    return ranked.withColumn("id", F.when(F.col("_nth") > 1, again).otherwise(F.col("id"))).drop("_nth").select(*items.columns)


def wires(
    builds: DataFrame, impls: DataFrame, visible: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Wires links: a built type that implements the unit's traits and is passed on, one link per visible impl.

    builds (keys, owner, owner_package, made, passed, file, line); impls (keys, type, impl, package);
    visible (keys, package, holds) is the package closure. Always guessed.
    """
    made = builds.filter("passed").select(*keys, "owner", "owner_package", F.col("made").alias("type"), "file", "line").distinct()
    seen = visible.select(*keys, F.col("package").alias("owner_package"), F.col("holds").alias("package"))
    found = made.join(impls.select(*keys, "type", "impl", "package").distinct(), [*keys, "type"]).join(
        seen, [*keys, "owner_package", "package"], "left_semi"
    )
    return found.groupBy(*keys, "owner", "impl").agg(F.min(F.struct("file", "line")).alias("w")).select(
        *keys, F.col("owner").alias("from"), F.col("impl").alias("target_id"), F.lit("wires").alias("kind"),
        F.lit("guessed").alias("confidence"), F.col("w.file").alias("file"), F.col("w.line").alias("line"),
    )


def port_adapters(links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, trait, adapters): distinct implementors per trait; distinct first, so a hot trait is counted in parts."""
    pairs = links.filter((F.col("kind") == "implements") & (F.col("target_kind") == "item")).select(
        *keys, F.col("target_id").alias("trait"), "from"
    ).distinct()
    return pairs.groupBy(*keys, "trait").agg(F.count(F.lit(1)).alias("adapters"))


def crate_status(packages: DataFrame, unit: DataFrame, libs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, package, status, reason): analyzed, or not and why."""
    mark = lambda d, name: d.select(*keys, "package").distinct().withColumn(name, F.lit(True))
    joined = packages.join(mark(unit, "_unit"), [*keys, "package"], "left").join(mark(libs, "_lib"), [*keys, "package"], "left")
    return joined.select(
        *keys, "package", F.when(F.col("_unit"), "analyzed").otherwise("not-analyzed").alias("status"),
        F.when(F.col("_unit").isNull(), F.when(F.col("_lib").isNull(), "tool bin").otherwise("outside the unit's closure")).alias("reason"),
    )


def plan_overlap(elements: DataFrame) -> DataFrame:
    """(repo, site, sessions): sites planned in more than one live session; a warning, never a lock.

    elements (repo, session, site). Sessions are grouped by site, never paired.
    """
    each = elements.select("repo", "site", "session").distinct()
    return (
        each.groupBy("repo", "site").agg(F.count(F.lit(1)).alias("sessions"), F.min("session").alias("first"), F.max("session").alias("last"))
        .filter(F.col("sessions") > 1)
    )


def labels_to_ids(elements: DataFrame, keys: Sequence[str] = ("session",)) -> tuple[DataFrame, DataFrame]:
    """``depends_on`` labels as ids: (keys, id, depends_on), and the unknown ones (keys, label, unknown)."""
    named = elements.select(*keys, F.col("label").alias("_wanted"), F.col("id").alias("_id"))
    wanted = elements.select(*keys, "id", "label", F.explode("depends_on").alias("_wanted"))
    known = wanted.join(named, [*keys, "_wanted"]).select(*keys, "id", F.col("_id").alias("depends_on"))
    unknown = wanted.join(named, [*keys, "_wanted"], "left_anti").select(*keys, "label", F.col("_wanted").alias("unknown"))
    return known, unknown


def row_fold(items: DataFrame, placed: DataFrame, impls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, id, row): the row each placed item is drawn in when areas stand open.

    An impl block folds into its type's row when the type is in the same area, an item with a parent into the parent's
    row, and a private loose item into its module's. items (keys, id, kind, visibility, parent, module), placed
    (keys, id, area), impls (keys, id, self_type). Parents are followed to the top by doubling, to any depth, as long as
    they are in the item's area.
    """
    homes = placed.select(*keys, "id", "area")
    base = items.join(homes, [*keys, "id"]).join(impls.select(*keys, "id", "self_type"), [*keys, "id"], "left")
    types = homes.select(*keys, F.col("id").alias("self_type"), F.col("area").alias("_type_area"))
    top = base.join(types, [*keys, "self_type"], "left")
    typed = (F.col("kind") == "impl") & (F.col("_type_area") == F.col("area"))
    loose = F.col("parent").isNull() & (F.col("visibility") == "private") & ~F.col("kind").isin("mod", "impl")
    modules = F.concat(F.lit("module:"), "module")
    # A type may itself be loose; its impls go where it goes.
    own = F.when(F.col("parent").isNotNull(), F.col("parent")).when(F.coalesce(typed, F.lit(False)), F.col("self_type")).when(loose, modules).otherwise(F.col("id"))
    rows = materialize(top.select(*keys, "id", "area", own.alias("row")), "rows")
    # A chain is no longer than the items are many, so a ring of parents ends too.
    for _ in range(rows.count().bit_length()):
        above = rows.select(*keys, F.col("id").alias("row"), "area", F.col("row").alias("_next"))
        moved = rows.join(above, [*keys, "row", "area"], "left").withColumn("_moved", F.coalesce(F.col("_next") != F.col("row"), F.lit(False)))
        rows = materialize(moved.select(*keys, "id", "area", F.coalesce("_next", "row").alias("row"), "_moved"), "rows")
        if not rows.filter("_moved").limit(1).count():
            break
        rows = rows.drop("_moved")
    return rows.select(*keys, "id", "area", "row")


def row_links(links: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row_a, row_b, links): links between rows with counts; those inside one row are not drawn."""
    near = rows.select(*keys, F.col("id").alias("from"), F.col("row").alias("row_a"))
    far = rows.select(*keys, F.col("id").alias("target_id"), F.col("row").alias("row_b"))
    return (
        links.filter(F.col("target_kind") == "item").join(near, [*keys, "from"]).join(far, [*keys, "target_id"])
        .filter(F.col("row_a") != F.col("row_b")).groupBy(*keys, "row_a", "row_b").agg(F.count(F.lit(1)).alias("links"))
    )
