"""Graph questions as one frontier loop: join the newest rows with the edges, keep what is new, repeat.

Every round writes only its new rows to the shared folder; what was seen is all rounds' files read together.
So a lost executor costs one round, no round rewrites earlier ones, and plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.ordered import KEYS, numbered
from factloom.session import materialize, scratch_path, stored

#: Newest rows up to which a round of ``frontier`` may take several steps; more of them meet edges anew for nothing.
FEW = 100_000


def frontier(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    on: Sequence[str],
    max_rounds: int | None = None,
    hops: int = 1,
    label: str = "frontier",
) -> DataFrame:
    """All rows reached from ``seed`` by ``step``, unique by ``on``; columns outside ``on`` come from the
    first round that reached the row (a step must give one row per ``on`` then).

    ``hops`` steps are taken between two writes while the newest rows are few and get no more: fewer rounds, each of which may
    meet rows twice.
    """
    spark = seed.sparkSession
    base = scratch_path(spark, label)
    names, schema = seed.columns, seed.schema

    def save(df: DataFrame, n: int) -> tuple[DataFrame, int]:
        # The write itself counts its rows; no second job asks whether there were any.
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{base}/round={n}")
        return spark.read.schema(schema).parquet(f"{base}/round={n}"), counted.get["rows"]

    paths = [f"{base}/round=0"]
    fresh, rows = save(seed.dropDuplicates(list(on)), 0)
    done = before = 0
    while rows and (max_rounds is None or done < max_rounds):
        found, newest = None, fresh
        steps = hops if rows <= min(FEW, before) else 1
        for _ in range(steps if max_rounds is None else min(steps, max_rounds - done)):
            newest = step(newest).select(*names)
            newest = newest.dropDuplicates(list(on))
            found = newest if found is None else found.unionByName(newest)
            done += 1
        seen = spark.read.schema(schema).parquet(*paths)
        new = found.dropDuplicates(list(on)).join(seen, list(on), "left_anti")
        before = rows
        fresh, rows = save(new, len(paths))
        paths.append(f"{base}/round={len(paths)}")
    return spark.read.schema(schema).parquet(*paths)


def _edges(edges: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    return edges.select(*keys, F.col("from").alias("_from"), F.col("to").alias("_to"), *more).distinct()


def numbers_of(names: DataFrame, keys: Sequence[str], label: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(keys, name, num) of distinct (keys, name), written, and what gives the number of a name beside its keys.

    A number is a hash, so links are numbered where they are read; it is taken with the first seed under which no two names
    share one. An unknown name's number is below 0.
    """
    kinds = dict(names.dtypes)
    for seed in count():
        def number(name: Column, seed: int = seed) -> Column:
            parts = [*[F.col(k).cast(kinds[k]) for k in keys], name.cast(kinds["name"])]
            # A hash passes over nulls; the flags tell where they were.
            num = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts, *[p.isNull() for p in parts]), 1)
            return F.when(name.isNull(), -num - 1).otherwise(num)

        known = materialize(names.withColumn("num", number(F.col("name"))), label)
        if known.count() == known.select("num").distinct().count():
            return known, number


def reachable(
    edges: DataFrame,
    starts: DataFrame,
    keys: Sequence[str] = KEYS,
    hops: int = 4,
    carry: Sequence[str] = (),
    label: str = "reachable",
) -> DataFrame:
    """Nodes reached from any of ``starts`` (keys, carry, node) along edges (keys, from, to), the starts included.

    Starts that differ in ``carry`` are followed side by side in the same rounds. An unknown node is
    reached once, and nothing is followed from it.
    """
    ends = edges.select(*keys, "from", "to").dropna(subset=[*keys, "from"])
    names = ends.select(*keys, F.explode(F.array("from", "to")).alias("name")).unionByName(starts.select(*keys, F.col("node").alias("name"))).distinct()
    names, number = numbers_of(names, keys, label + "-names")
    links = stored(ends.select(number(F.col("from")).alias("_from"), number(F.col("to")).alias("_to")), "_from", label + "-edges")

    def step(fresh: DataFrame) -> DataFrame:
        return fresh.join(links, F.col("node") == F.col("_from")).select(*carry, F.col("_to").alias("node"))

    seed = starts.select(*carry, number(F.col("node")).alias("node"))
    found = frontier(seed, step, [*carry, "node"], hops=hops, label=label).withColumnRenamed("node", "num")
    return found.join(names, "num").select(*keys, *carry, F.col("name").alias("node"))


#: Starts that one row of a node knows of.
WORD = 64
#: Parts in which a key's starts are numbered.
CHUNKS = 64


def reach_words(
    edges: DataFrame,
    starts: DataFrame,
    keys: Sequence[str] = KEYS,
    max_rounds: int | None = None,
    first_edges: DataFrame | None = None,
    steps: int = 1,
    label: str = "reach",
) -> tuple[DataFrame, DataFrame]:
    """What each start reaches, 64 starts to a row: (keys, word, node, bits, hops) and (keys, word, starts).

    edges (keys, from, to) and starts (keys, node). Starts are numbered; number n is bit n % 64 of word n / 64. A round joins
    the newest bits of a node with its edges and keeps, per node and word, the bits not seen before, with the round as
    ``hops``. So the rows of a round grow with the edges out of newly reached nodes and a 64th of the starts, not with pairs.
    ``first_edges`` are followed in the first round only, beside ``edges``. With more ``steps`` a round goes so many edges far
    before it writes, and ``hops`` counts rounds.
    """
    keys = list(keys)
    spark = starts.sparkSession
    links = materialize(_edges(edges, keys), label + "-edges")
    named = starts.select(*keys, "node").distinct()
    ranked = numbered(named, keys, ["node"], F.pmod(F.xxhash64("node"), F.lit(CHUNKS)), "_n").withColumn("_n", F.col("_n") - 1)
    ranked = materialize(ranked.select(*keys, "node", F.floor(F.col("_n") / WORD).alias("word"), (F.col("_n") % WORD).cast("int").alias("_bit")), label + "-numbers")
    words = ranked.groupBy(*keys, "word").agg(F.array_sort(F.collect_list(F.struct("_bit", "node"))).alias("_l")).select(*keys, "word", F.col("_l.node").alias("starts"))
    base, on = scratch_path(spark, label), [*keys, "word", "node"]
    schema = ranked.select(*on, F.lit(0).cast("bigint").alias("bits"), F.lit(0).cast("bigint").alias("hops")).schema

    def save(df: DataFrame, n: int) -> tuple[DataFrame, int]:
        counted = Observation()
        df.select(*on, "bits", F.lit(n).cast("bigint").alias("hops")).observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{base}/round={n}")
        return spark.read.schema(schema).parquet(f"{base}/round={n}"), counted.get["rows"]

    one = ranked.groupBy(*on).agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"))
    fresh, rows = save(one, 0)
    paths = [f"{base}/round=0"]
    while rows and (max_rounds is None or len(paths) <= max_rounds):
        way = links
        if first_edges is not None and len(paths) == 1:
            way = links.unionByName(_edges(first_edges, keys)).distinct()
        found, newest = None, fresh.select(*on, "bits")
        for _ in range(steps):
            newest = newest.withColumnRenamed("node", "_from").join(way, [*keys, "_from"])
            newest = newest.groupBy(*keys, "word", F.col("_to").alias("node")).agg(F.bit_or("bits").alias("bits"))
            found, way = newest if found is None else found.unionByName(newest), links
        met = found.groupBy(*on).agg(F.bit_or("bits").alias("_met")) if steps > 1 else found.withColumnRenamed("bits", "_met")
        seen = spark.read.schema(schema).parquet(*paths).groupBy(*on).agg(F.bit_or("bits").alias("_seen"))
        new = met.join(seen, on, "left").withColumn("bits", F.expr("_met & ~coalesce(_seen, 0L)")).filter("bits != 0")
        fresh, rows = save(new, len(paths))
        paths.append(f"{base}/round={len(paths)}")
    return spark.read.schema(schema).parquet(*paths), words


def start_pairs(reached: DataFrame, words: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, start, node, hops) of what ``reach_words`` gives. Rows meet the names of their word's starts before they are
    spread out, so pairs are not shuffled."""
    held = F.filter("starts", lambda _, n: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), n)) != 0)
    return reached.join(words, [*keys, "word"]).select(*keys, F.explode(held).alias("start"), "node", "hops")


def closure(
    edges: DataFrame,
    starts: DataFrame,
    keys: Sequence[str] = KEYS,
    first_edges: DataFrame | None = None,
    label: str = "closure",
) -> DataFrame:
    """(start, node) pairs: what each start reaches, itself included.

    ``first_edges`` are followed in the first step only.
    """
    return start_pairs(*reach_words(edges, starts, keys, None, first_edges, 2, label), keys).drop("hops")


def package_closure(
    packages: DataFrame, deps: DataFrame, dev_deps: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Per package: itself, its dev-dependencies (first step only) and all they depend on.

    packages (keys, name); deps and dev_deps (keys, name, dep). Names of other packages are left out.
    """
    known = packages.select(*keys, F.col("name").alias("dep"))
    local = lambda d: d.select(*keys, "name", "dep").join(known, [*keys, "dep"], "left_semi").select(
        *keys, F.col("name").alias("from"), F.col("dep").alias("to")
    )
    out = closure(
        local(deps),
        packages.select(*keys, F.col("name").alias("node")),
        keys,
        first_edges=local(dev_deps),
        label="packages",
    )
    return out.select(*keys, F.col("start").alias("package"), F.col("node").alias("holds"))


def dependents(
    packages: DataFrame, deps: DataFrame, dev_deps: DataFrame, changed: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Packages whose closure meets ``changed`` (keys, name): reverse edges from the changed set, then one
    step back over dev-dependencies."""
    known = packages.select(*keys, "name")
    back = deps.select(*keys, F.col("dep").alias("from"), F.col("name").alias("to"))
    hit = reachable(
        back, changed.join(known, [*keys, "name"], "left_semi").select(*keys, F.col("name").alias("node")), keys,
        label="dependents",
    )
    by_dev = dev_deps.join(hit.withColumnRenamed("node", "dep"), [*keys, "dep"], "left_semi").select(
        *keys, F.col("name").alias("node")
    )
    return hit.unionByName(by_dev).distinct().withColumnRenamed("node", "name").join(
        known, [*keys, "name"], "left_semi"
    )


def unit_closure(
    targets: DataFrame, deps: DataFrame, keys: Sequence[str] = KEYS, main_bin: DataFrame | None = None
) -> DataFrame:
    """The unit's targets: the main one, then libs of local packages reached by path dependencies.

    targets (keys, package, pos, kind, target): pos orders packages. deps (keys, name, dep, local).
    main_bin (keys, main_bin) names the main binary of some repos; else the first bin, else the first lib.
    """
    wanted = targets
    if main_bin is not None:
        wanted = wanted.join(main_bin.select(*keys, "main_bin"), keys, "left")
    else:
        wanted = wanted.withColumn("main_bin", F.lit(None).cast("string"))
    named = F.col("main_bin").isNull() | ((F.col("kind") == "bin") & (F.col("target") == F.col("main_bin")))
    main = (
        wanted.filter(named)
        .groupBy(*keys)
        .agg(
            F.min_by(
                F.struct("package", "kind", "target"), F.struct((F.col("kind") != "bin").cast("int"), "pos", "target")
            ).alias("m")
        )
        .select(*keys, "m.*")
    )
    edges = deps.filter("local").select(*keys, F.col("name").alias("from"), F.col("dep").alias("to"))
    reached = reachable(edges, main.select(*keys, F.col("package").alias("node")), keys, label="unit")
    libs = targets.filter(F.col("kind") == "lib").join(
        reached.withColumnRenamed("node", "package"), [*keys, "package"], "left_semi"
    )
    both = main.withColumn("main", F.lit(True)).unionByName(
        libs.select(*keys, "package", "kind", "target").withColumn("main", F.lit(False))
    )
    return both.groupBy(*keys, "package", "kind", "target").agg(F.bool_or("main").alias("main"))


#: Starts that one row of a node may list, pairs that one task is to hold about, and the most starts whose names are sent to
#: all tasks.
BLOCK, TASK_PAIRS, SENT_NAMES = 1 << 16, 2_000_000, 500_000


def parts_for(spark: SparkSession, rows: float) -> int:
    """Partitions for that many small rows: more of them for more rows, so that a task's share does not grow with a table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows // TASK_PAIRS) + 1)


def _counted(rows: DataFrame, label: str) -> DataFrame:
    """(…, start): rows, written, with numbers from 0 without gaps."""
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), label)
    # The number's upper bits are the partition that wrote the row.
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    start = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int")
    return rows.join(offsets, part == F.col("_part")).withColumn("start", start).drop("_at", "_part", "_before")


def reach(
    links: DataFrame, foci: DataFrame, depth: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(focus, node, hops): what lies within ``depth`` item links of each focus, in both directions.

    Nodes are known by numbers, and a row of a node lists the starts that met it. A round sends the newest lists along the
    links and spreads them out where a node's lists have come together: a pair is shuffled as two bytes of a list, the links
    are dealt out by node once, and names come back last.
    """
    keys, spark = list(keys), links.sparkSession
    ends = links.select(*keys, "from", "to").dropna(subset=keys)
    wanted = foci.select(*keys, F.col("focus").alias("name")).dropna(subset=keys).distinct()
    names = ends.select(*keys, F.explode(F.array("from", "to")).alias("name")).unionByName(wanted).distinct()
    nodes, number = numbers_of(names, keys, "reach-names")
    a, b = number(F.col("from")).alias("a"), number(F.col("to")).alias("b")
    ways = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    # Nothing is followed from an unknown name.
    edges = stored(ends.select(a, b).select(ways).filter("a >= 0"), "a", "reach-edges")
    starts = materialize(_counted(wanted.select(F.col("name").alias("focus"), number(F.col("name")).alias("node")), "reach-starts"), "reach-starts")
    # A start is its place in its block, which has 16 bits.
    place, start = F.col("start") % BLOCK - BLOCK // 2, F.col("block") * BLOCK + F.col("start") + BLOCK // 2
    seed = starts.select("node", F.floor(F.col("start") / BLOCK).cast("int").alias("block"), F.array(place).alias("starts"), F.lit(0).cast("bigint").alias("hops"))
    base, schema = scratch_path(spark, "reach"), "node bigint, block int, starts array<int>, hops bigint"

    def save(df: DataFrame, n: int) -> tuple[DataFrame, int]:
        counted = Observation()
        df.observe(counted, F.sum(F.size("starts")).alias("pairs")).write.parquet(f"{base}/round={n}")
        return spark.read.schema(schema).parquet(f"{base}/round={n}"), counted.get["pairs"] or 0

    paths = [f"{base}/round=0"]
    fresh, pairs = save(seed, 0)
    degree, total = edges.count() / max(1, nodes.count()), pairs
    for n in range(1, depth + 1):
        if not pairs:
            break
        sent = fresh.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "block", "starts", F.lit(n).cast("bigint").alias("hops"))
        lists = spark.read.schema(schema).parquet(*paths).unionByName(sent).withColumn("starts", F.col("starts").cast("array<smallint>"))
        spread = lists.repartition(parts_for(spark, total + pairs * degree), "node", "block").select("node", "block", F.explode("starts").alias("start"), "hops")
        # An unknown name is met anew in each round.
        first = spread.groupBy("node", "block", "start", F.when(F.col("node") < 0, F.col("hops")).alias("_again")).agg(F.min("hops").alias("hops"))
        new = first.filter(F.col("hops") == n).groupBy("node", "block", "hops").agg(F.array_sort(F.collect_list("start")).cast("array<int>").alias("starts"))
        fresh, pairs = save(new.select("node", "block", "starts", "hops"), n)
        paths.append(f"{base}/round={n}")
        total += pairs
    found = spark.read.schema(schema).parquet(*paths).join(nodes.withColumnRenamed("num", "node"), "node").select(*keys, F.col("name").alias("node"), "block", F.explode("starts").alias("start"), "hops")
    foci_names = starts.select("start", "focus")
    if starts.count() <= SENT_NAMES:
        foci_names = F.broadcast(foci_names)
    return found.withColumn("start", start).join(foci_names, "start").select(*keys, "focus", "node", "hops")


def top_module(module: Column) -> Column:
    return F.substring_index(module, "::", 1)


def reach_within_module(
    edges: DataFrame, items: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(start, node) pairs along edges whose target's top module is the start's."""
    tops = items.select(*keys, F.col("id").alias("_id"), top_module(F.col("module")).alias("top"))
    ends = lambda side: tops.withColumnRenamed("_id", side)
    inner = (
        edges.select(*keys, "from", "to").distinct()
        .join(ends("to"), [*keys, "to"]).join(ends("from"), [*keys, "from", "top"]).select(*keys, "top", "from", "to")
    )
    seed = starts.select(*keys, F.col("node").alias("_id")).distinct().join(tops, [*keys, "_id"]).select(*keys, "top", F.col("_id").alias("node")).distinct()
    # No edge is in an unknown top module.
    alone = seed.filter(F.col("top").isNull()).select(*keys, F.col("node").alias("start"), "node")
    found = closure(inner, seed.filter(F.col("top").isNotNull()), [*keys, "top"], label="within")
    return found.select(*keys, "start", "node").unionByName(alone)


def back_within_module(edges: DataFrame, items: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, node) from which one of ``starts`` (keys, node) is reached along edges inside one top module, the starts included."""
    ends = edges.select(*keys, "from", "to").dropna()
    tops = items.select(*keys, F.col("id").alias("name"), top_module(F.col("module")).alias("_top")).dropna()
    names = ends.select(*keys, F.explode(F.array("from", "to")).alias("name")).unionByName(starts.select(*keys, F.col("node").alias("name")))
    names, number = numbers_of(names.unionByName(tops.drop("_top")).distinct(), keys, "back-names")
    back = stored(ends.select(number(F.col("to")).alias("_to"), number(F.col("from")).alias("_from")), "_to", "back-edges")
    tops = stored(tops.select(number(F.col("name")).alias("_id"), "_top"), "_id", "back-tops")
    inside = tops.select(F.col("_id").alias("_from"), "_top")

    def step(fresh: DataFrame) -> DataFrame:
        placed = fresh.join(tops, F.col("node") == F.col("_id"))
        met = placed.join(back, F.col("node") == F.col("_to")).select("_from", "_top").distinct()
        return met.join(inside, ["_from", "_top"], "left_semi").select(F.col("_from").alias("node"))

    found = frontier(starts.select(number(F.col("node")).alias("node")), step, ["node"], hops=4, label="back").withColumnRenamed("node", "num")
    return found.join(names, "num").select(*keys, F.col("name").alias("node"))


def direct_calls(links: DataFrame, items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Calls between known items as (from, to) edges."""
    ids = items.select(*keys, "id")
    return (
        links.filter((F.col("kind") == "calls") & (F.col("target_kind") == "item"))
        .select(*keys, "from", F.col("target_id").alias("to"))
        .distinct()
        .join(ids.withColumnRenamed("id", "from"), [*keys, "from"], "left_semi")
        .join(ids.withColumnRenamed("id", "to"), [*keys, "to"], "left_semi")
    )


def spawned_workers(
    items: DataFrame,
    calls: DataFrame,
    spawns: DataFrame,
    tests: DataFrame,
    loops: DataFrame,
    entries: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Items a start-up spawn runs for ever, with the first spawn that says so.

    items (keys, id, module, cfg, entry); calls (keys, from, to); spawns (keys, pos, owner, target, in_loop,
    file, line); tests, loops and entries (keys, id). ``in_main``: the spawn sits in a main itself.
    """
    test_ids = tests.select(*keys, "id").distinct()
    mains = items.filter(F.col("entry")).select(*keys, "id").join(test_ids, [*keys, "id"], "left_anti")
    roots = entries.select(*keys, "id").distinct().join(test_ids, [*keys, "id"], "left_anti")
    tagged = lambda d, tag: d.select(*keys, F.lit(tag).alias("_of"), F.col("id").alias("node"))
    both = reachable(calls, tagged(mains, "main").unionByName(tagged(roots, "entry")), keys, carry=["_of"], label="from-entries")
    from_main = both.filter(F.col("_of") == "main").drop("_of")
    from_entries = both.filter(F.col("_of") == "entry").drop("_of")
    in_test = F.coalesce(F.col("cfg").contains("test"), F.lit(False))
    plain = items.filter(~in_test).select(*keys, "id").join(test_ids, [*keys, "id"], "left_anti")
    called = from_entries.withColumnRenamed("node", "id").join(roots, [*keys, "id"], "left_anti")
    # Backwards from the loops over calls inside one top module: a row per item, not per spawn and item.
    known = loops.select(*keys, F.col("id").alias("node")).join(items.select(*keys, F.col("id").alias("node")), [*keys, "node"], "left_semi")
    endless = back_within_module(calls, items, known, keys).withColumnRenamed("node", "id")
    # Spawns are many and wide; the fewer of their ends that count come first, so that the rest is dealt out for the other end only.
    owners = materialize(plain.join(from_main.withColumnRenamed("node", "id"), [*keys, "id"], "left_semi").withColumnRenamed("id", "owner").distinct(), "owners")
    targets = plain.join(called, [*keys, "id"], "left_anti").join(endless, [*keys, "id"], "left_semi")
    targets = materialize(targets.withColumnRenamed("id", "target").distinct(), "targets")
    ends = sorted(((owners.count(), "owner", owners), (targets.count(), "target", targets)), key=lambda x: x[0])
    held = spawns.filter(~F.col("in_loop"))
    for many, end, ids in ends:
        held = held.join(F.broadcast(ids) if many <= FEW else ids, [*keys, end], "left_semi")
    firsts = held.groupBy(*keys, "target").agg(F.min_by(F.struct("owner", "file", "line"), "pos").alias("s")).select(*keys, "target", "s.*")
    return firsts.join(
        mains.select(*keys, F.col("id").alias("owner"), F.lit(True).alias("_main")), [*keys, "owner"], "left"
    ).select(*keys, "target", "owner", "file", "line", F.coalesce("_main", F.lit(False)).alias("in_main"))


def side(rows: DataFrame, many: int) -> DataFrame:
    """A written table of so many rows as one side of a join. Files of repeated values are far smaller than their rows, so that
    their size would send millions of rows to the driver and all tasks."""
    return F.broadcast(rows) if many <= FEW else rows.hint("merge")


def chains(deps: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(keys, id, head, steps) of the nodes in chains, and (keys, id) of those in closed rings of them.

    A chain link is a node's only dependency, a known node that nothing else depends on. Pointers along the links are
    doubled, so a chain of n nodes takes log n rounds. deps (keys, id, depends_on), nodes (keys, id).
    """
    one = lambda by: deps.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n").hint("merge")
    links = (
        deps.join(one("id"), [*keys, "id"], "left_semi").join(one("depends_on"), [*keys, "depends_on"], "left_semi")
        .join(nodes.withColumnRenamed("id", "depends_on").hint("merge"), [*keys, "depends_on"], "left_semi")
        .select(*keys, "id", F.col("depends_on").alias("head"), F.lit(1).cast("bigint").alias("steps"))
    )
    links = materialize(links, "chain-links")
    total, reached = links.count(), 1
    further = lambda rows: rows.select(*keys, F.col("id").alias("head"), F.col("head").alias("_to"), F.col("steps").alias("_more"))
    moved = total
    while moved and reached <= total:
        seen = Observation()
        joined = links.join(side(further(links), total), [*keys, "head"], "left").observe(seen, F.count_if(F.col("_to").isNotNull()).alias("moved"))
        links = materialize(joined.select(*keys, "id", F.coalesce("_to", "head").alias("head"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")), "chain-links")
        moved, reached = seen.get["moved"], 2 * reached
    # A pointer that has gone further than there are links and still is at a link is in a ring.
    ring = links.join(side(links.select(*keys, F.col("id").alias("head")), total), [*keys, "head"], "left_semi").select(*keys, "id")
    return links.join(side(ring, total), [*keys, "id"], "left_anti"), ring


def topological_layers(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(id, pos, layer, error): layer 1 depends on nothing, layer n only on earlier ones.

    nodes (keys, id, pos); edges (keys, id, depends_on). A node that depends on an unknown one, or sits on or
    behind a cycle, has no layer and says so in ``error``. Chains are folded into their heads first, so the rounds are as
    many as the longest way has nodes that branch or join.
    """
    spark, keys = nodes.sparkSession, list(keys)
    base = scratch_path(spark, "layers")
    ids = nodes.select(*keys, "id")
    deps = materialize(edges.select(*keys, "id", "depends_on").distinct(), "deps")
    unknown = (
        deps.join(ids.withColumnRenamed("id", "depends_on").hint("merge"), [*keys, "depends_on"], "left_anti")
        .groupBy(*keys, "id").agg(F.min("depends_on").alias("_unknown"))
    )
    folded, ring = chains(deps, ids, keys)
    inner = folded.select(*keys, "id").unionByName(ring)
    folds = inner.count()
    heads = materialize(ids.join(side(inner, folds), [*keys, "id"], "left_anti"), "heads")
    # Where a head's dependency is folded: the head that stands for it, and how far behind it is.
    stands = folded.select(*keys, F.col("id").alias("depends_on"), "head", "steps").unionByName(
        heads.select(*keys, F.col("id").alias("depends_on"), F.col("id").alias("head"), F.lit(0).cast("bigint").alias("steps")))
    whole = heads.count()
    between = deps.join(side(heads, whole), [*keys, "id"], "left_semi").join(side(stands, whole + folds), [*keys, "depends_on"], "left")
    between = materialize(between.select(*keys, "id", "head", "steps"), "between")
    wanted = materialize(between.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_wanted")), "wanted")
    schema = ids.withColumn("layer", F.lit(1).cast("bigint")).schema

    def save(df: DataFrame, n: int) -> int:
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{base}/round={n}")
        return counted.get["rows"]

    rows = save(heads.join(side(wanted, whole), [*keys, "id"], "left_anti").withColumn("layer", F.lit(1).cast("bigint")), 1)
    paths, total = [f"{base}/round=1"], rows
    while rows:
        # A head is ready when as many of its dependencies are placed as it has, one of them in the newest round.
        as_dep = lambda *at: spark.read.schema(schema).parquet(*at).withColumnRenamed("id", "head")
        touched = materialize(between.join(side(as_dep(paths[-1]), rows), [*keys, "head"], "left_semi").select(*keys, "id").distinct(), "touched")
        met = between.join(side(touched, touched.count()), [*keys, "id"], "left_semi").join(side(as_dep(*paths), total), [*keys, "head"])
        counted = met.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_met"), F.max(F.col("layer") + F.col("steps") + 1).alias("layer"))
        ready = counted.join(side(wanted, whole), [*keys, "id"]).filter(F.col("_met") == F.col("_wanted"))
        rows = save(ready.select(*keys, "id", "layer"), len(paths) + 1)
        paths.append(f"{base}/round={len(paths) + 1}")
        total += rows
    placed = spark.read.schema(schema).parquet(*paths)
    behind = folded.join(side(placed.withColumnRenamed("id", "head"), total), [*keys, "head"]).select(*keys, "id", (F.col("layer") + F.col("steps")).alias("layer"))
    layers = placed.unionByName(behind)
    error = F.when(F.col("layer").isNull(), F.coalesce(
        F.concat(F.lit("depends on unknown "), F.col("_unknown").cast("string")), F.lit("on or behind a cycle")))
    return (
        nodes.join(side(layers, total + folds), [*keys, "id"], "left").join(unknown.hint("merge"), [*keys, "id"], "left")
        .select(*keys, "id", "pos", "layer", error.alias("error"))
    )
