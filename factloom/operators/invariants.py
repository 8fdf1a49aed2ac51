"""Checks on what a view draws; each gives violation rows (keys, invariant, message)."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators import graph, lints
from factloom.operators.ordered import KEYS, carried
from factloom.session import materialize

c = F.col


def _violations(df: DataFrame, invariant: str, message: Column, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.lit(invariant).alias("invariant"), message.alias("message"))


def _say(template: str, *values: Column) -> Column:
    """``template`` with each ``{}`` filled by the text of a value; null reads ``none``."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [F.coalesce(value.cast("string"), F.lit("none")), F.lit(rest)]
    return F.concat(*out)


def number(value: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _bits(value: Column) -> Column:
    # Text tells -0.0 from 0.0 and holds NaN equal to itself.
    return value.cast("string")


def _brief(text: Column) -> Column:
    """16 bytes that stand for a long id where only equality counts."""
    return F.unhex(F.md5(text))


def positions_stable(
    items: DataFrame, positions: DataFrame, base_items: DataFrame, base_positions: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Items with equal content keep their exact position."""
    same = items.select(*keys, "id", "content_hash").join(
        base_items.select(*keys, "id", "content_hash"), [*keys, "id", "content_hash"], "left_semi")
    place = lambda d, x, y: d.select(*keys, c("item").alias("id"), c("x").alias(x), c("y").alias(y), F.lit(True).alias(f"_has_{x}"))
    both = same.join(place(base_positions, "bx", "by"), [*keys, "id"]).join(place(positions, "cx", "cy"), [*keys, "id"], "left")
    moved = (_bits(c("bx")) != _bits(c("cx"))) | (_bits(c("by")) != _bits(c("cy")))
    message = F.when(c("_has_cx").isNull(), _say("{} lost its position with unchanged facts", c("id"))).when(
        moved, _say("{} moved from ({}, {}) to ({}, {}) with unchanged facts", c("id"), *[number(c(n)) for n in ("bx", "by", "cx", "cy")]))
    return _violations(both.withColumn("_m", message).filter(c("_m").isNotNull()), "MAP-1", c("_m"), keys)


def moved_positions(
    invariant: str, what: str, with_it: DataFrame, plain: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Positions computed with something equal those without, bit for bit, and there are as many."""
    q = plain.select(*keys, "item", c("x").alias("px"), c("y").alias("py"), F.lit(True).alias("_plain"))
    both = with_it.select(*keys, "item", "x", "y").join(q, [*keys, "item"], "left")
    moved = (_bits(c("x")) != _bits(c("px"))) | (_bits(c("y")) != _bits(c("py")))
    message = F.when(c("_plain").isNull(), _say("{} appears only with " + what, c("item"))).when(
        moved, _say("{} is at ({}, {}) with " + what + " but ({}, {}) without", c("item"), *[number(c(n)) for n in ("x", "y", "px", "py")]))
    rows = _violations(both.withColumn("_m", message).filter(c("_m").isNotNull()), invariant, c("_m"), keys)
    counts = (
        with_it.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(plain.select(*keys, F.lit(0), F.lit(1)))
        .groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> b")
    )
    return rows.unionByName(_violations(counts, invariant, _say("{} positions with " + what + ", {} without", c("a"), c("b")), keys))


def no_state_relayout(with_overlays: DataFrame, positions: DataFrame, overlays: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Overlays move nothing and carry no geometry."""
    geometry = overlays.filter("has_geometry")
    return moved_positions("MAP-3", "overlays", with_overlays, positions, keys).unionByName(
        _violations(geometry, "MAP-3", _say("{} overlay row on {} carries geometry", c("kind"), c("item")), keys))


def fold_floor(fold: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Against the first state: one label size, a scale of at least 0.7 of the opening one, folded above 80 items."""
    opening = fold.groupBy(*keys).agg(F.min_by(F.struct("label_px", "scale"), "pos").alias("o"))
    rows = fold.join(opening, list(keys)).select("*", c("o.label_px").alias("ol"), c("o.scale").alias("os"))
    at = c("pos")
    labels = rows.filter(_bits(c("label_px")) != _bits(c("ol")))
    scales = rows.filter(c("scale") < fixed.FOLD_SCALE_FLOOR * c("os"))
    shown = rows.filter((c("visible_items") > fixed.FOLD_ITEM_THRESHOLD) & ~c("areas_folded"))
    say = [
        _violations(labels, "MAP-4", _say("fold state {} changes label size {} → {}", at, number(c("ol")), number(c("label_px"))), keys),
        _violations(scales, "MAP-4", _say("fold state {} scale {} is below the floor 0.7 × {}", at, number(c("scale")), number(c("os"))), keys),
        _violations(shown, "MAP-4", _say("fold state {} shows {} items with areas unfolded", at, c("visible_items")), keys),
    ]
    return reduce(DataFrame.unionByName, say)


def overlay_stacking(overlays: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each overlay kind uses its own channel."""
    expected = F.lit(None).cast("string")
    for kind, channel in fixed.OVERLAY_CHANNELS.items():
        expected = F.when(c("kind") == kind, channel).otherwise(expected)
    odd = overlays.withColumn("_e", expected).filter(c("channel") != c("_e"))
    return _violations(odd, "MAP-14", _say("{} overlay on {} uses {}, expected {}", c("kind"), c("item"), c("channel"), c("_e")), keys)


def unresolved_one_pill(items: DataFrame, links: DataFrame, pills: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """An item with n unresolved links out has exactly one pill that says n; any other has none."""
    open_links = links.filter(c("unresolved").isNotNull()).groupBy(*keys, c("from").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    shown = pills.filter(c("kind") == "unresolved").groupBy(*keys, c("item").alias("id")).agg(
        F.count(F.lit(1)).alias("pills"), F.max("count").alias("says"))
    both = items.select(*keys, "id").join(open_links, [*keys, "id"], "left").join(shown, [*keys, "id"], "left").na.fill(0, ["n", "pills"])
    message = (
        F.when((c("n") == 0) & (c("pills") > 0), _say("{} has an unresolved pill but no unresolved links", c("id")))
        .when((c("n") > 0) & (c("pills") == 1) & (c("says") != c("n")), _say("{} pill says {} unresolved, facts say {}", c("id"), c("says"), c("n")))
        .when((c("n") > 0) & (c("pills") != 1), _say("{} has {} unresolved pills, expected one", c("id"), c("pills")))
    )
    return _violations(both.withColumn("_m", message).filter(c("_m").isNotNull()), "MAP-16", c("_m"), keys)


def cross_unit_public(items: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Links between crates end on public items."""
    end = lambda side: items.select(*keys, c("id").alias(side), c("krate").alias(f"_{side}"), c("public").alias(f"_{side}_public"))
    # The far end first: links onto public items are not dealt out again.
    crossing = links.filter(c("unresolved").isNull()).join(end("to").filter(~c("_to_public")), [*keys, "to"]).join(
        end("from").drop("_from_public"), [*keys, "from"]).filter(c("_from") != c("_to"))
    return _violations(crossing, "MAP-30", _say("link {} crosses {} → {} onto non-public {}", c("id"), c("_from"), c("_to"), c("to")), keys)


def direction_marked(
    items: DataFrame, links: DataFrame, units: DataFrame, findings: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every link against the grain has a direction finding."""
    marked = findings.filter((c("rule") == "direction") & c("link").isNotNull()).select(*keys, _brief(c("link")).alias("_id")).distinct()
    odd = lints.direction_smells(links, items, units, keys).withColumn("_id", _brief(c("id"))).join(marked, [*keys, "_id"], "left_anti")
    return _violations(odd, "MAP-17", _say(
        "{} link {} goes {} → {}, against the {} grain, and no direction finding marks it",
        c("kind"), c("id"), c("from_column"), c("to_column"), c("rule")), keys)


def columns_are_sides(items: DataFrame, areas: DataFrame, units: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area sides are columns of the rule, and items sit in their area's column."""
    ruled = units.filter(c("rule").isNotNull()).select(*keys, "rule", "columns")
    odd_areas = areas.join(ruled, list(keys)).filter(~F.coalesce(F.array_contains("columns", c("side")), F.lit(False)))
    homes = areas.select(*keys, c("id").alias("area"), c("side").alias("_side"), F.lit(True).alias("_known"))
    sat = items.filter(c("area").isNotNull()).join(ruled.select(*keys), list(keys), "left_semi").join(homes, [*keys, "area"], "left")
    message = F.when(c("_known").isNull(), _say("{} is in unknown area {}", c("id"), c("area"))).when(
        ~c("column").eqNullSafe(c("_side")), _say("{} sits in column {} but its area {} is on side {}", c("id"), c("column"), c("area"), c("_side")))
    return _violations(odd_areas, "MAP-2", _say("area {} has side {}, not a column under {}", c("id"), c("side"), c("rule")), keys).unionByName(
        _violations(sat.withColumn("_m", message).filter(c("_m").isNotNull()), "MAP-2", c("_m"), keys))


def folded_link_counts(
    items: DataFrame, links: DataFrame, areas: DataFrame, findings: DataFrame, chip_links: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One chip link per direction between folded areas, with the count and badge of the links it folds."""
    folded = areas.filter("folded").select(*keys, c("id").alias("area"))
    homes = items.select(*keys, "id", "area").join(folded, [*keys, "area"], "left_semi")
    marked = findings.filter(c("link").isNotNull()).select(*keys, _brief(c("link")).alias("_id")).distinct().withColumn("_marked", F.lit(True))
    end = lambda side, name: homes.select(*keys, c("id").alias(side), c("area").alias(name))
    expected = (
        links.filter(c("unresolved").isNull()).select(*keys, "from", "to", _brief(c("id")).alias("_id"))
        .join(end("from", "a"), [*keys, "from"]).join(end("to", "b"), [*keys, "to"])
        .filter(c("a") != c("b")).join(marked, [*keys, "_id"], "left")
        .groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("_marked", F.lit(False))).alias("badge"))
    )
    drawn = chip_links.groupBy(*keys, c("from").alias("a"), c("to").alias("b")).agg(
        F.count(F.lit(1)).alias("chips"), F.max("count").alias("says"), F.bool_or("badged").alias("badged"))
    both = expected.join(drawn, [*keys, "a", "b"], "full")
    message = (
        F.when(c("n").isNull(), _say("chip link {} → {} folds no item link between folded areas", c("a"), c("b")))
        .when(c("chips").isNull(), _say("chips {} → {} fold {} links but no chip link is drawn", c("a"), c("b"), c("n")))
        .when(c("chips") > 1, _say("{} chip links drawn {} → {}, expected one", c("chips"), c("a"), c("b")))
        .when(c("says") != c("n"), _say("chip link {} → {} says {}, it folds {} links", c("a"), c("b"), c("says"), c("n")))
        .when(c("badged") != c("badge"), _say("chip link {} → {} badge is {}, findings on its links say {}", c("a"), c("b"), c("badged"), c("badge")))
    )
    return _violations(both.withColumn("_m", message).filter(c("_m").isNotNull()), "MAP-7", c("_m"), keys)


def reach_difference(expected: DataFrame, shown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one set and not the other, with ``side``: missing from what is shown, or extra in it."""
    # Each side is written and counted, so that both meet once and in as many parts as they have rows for.
    on, spark = [*keys, "node"], expected.sparkSession
    sides = [materialize(df.select(*on), "reach-side") for df in (expected, shown)]
    flagged = [df.withColumn("_e", F.lit(1 - n)).withColumn("_s", F.lit(n)) for n, df in enumerate(sides)]
    met = flagged[0].unionByName(flagged[1]).repartition(graph.parts_for(spark, sum(df.count() for df in sides)), *on)
    told = met.groupBy(*on).agg(F.sum("_e").alias("_e"), F.sum("_s").alias("_s"))
    # A row with an unknown value equals none.
    lost = F.greatest(*[c(k).isNull() for k in on])
    times = lambda mine, other: F.when(lost | (c(other) == 0), c(mine)).otherwise(0).cast("int")
    side = F.concat(F.array_repeat(F.lit("missing"), times("_e", "_s")), F.array_repeat(F.lit("extra"), times("_s", "_e")))
    return told.select(*on, F.explode(side).alias("side"))


def reach_depth(items: DataFrame, links: DataFrame, reach: DataFrame, depth: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The shown reach sets equal those computed at ``depth``. reach (keys, focus, node): what is shown, per focus."""
    known = items.select(*keys, c("id").alias("focus"))
    foci = reach.select(*keys, "focus").distinct()
    lost = foci.join(known, [*keys, "focus"], "left_anti")
    good = foci.join(known, [*keys, "focus"], "left_semi")
    edges = links.filter(c("unresolved").isNull()).select(*keys, "from", "to")
    expected = graph.reach(edges, good, depth, keys).select(*keys, "focus", "node")
    shown = reach.filter(c("node").isNotNull()).select(*keys, "focus", "node").distinct().join(good, [*keys, "focus"], "left_semi")
    odd = reach_difference(expected, shown, [*keys, "focus"])
    message = F.when(c("side") == "missing", _say(f"{{}} is within {depth} hops of {{}} but outside the Reach set", c("node"), c("focus"))).otherwise(
        _say(f"{{}} is in the Reach set but more than {depth} hops from {{}}", c("node"), c("focus")))
    return _violations(lost, "MAP-11", _say("Reach focus {} is not an item", c("focus")), keys).unionByName(
        _violations(odd, "MAP-11", message, keys))


def column_rule_from_entry(units: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A unit's rule is the override, else what its entry says. units (keys, rule, rule_override, has_entry)."""
    expected = F.coalesce("rule_override", F.when(c("has_entry"), "hexagon").otherwise("layers"))
    why = F.when(c("rule_override").isNotNull(), "the override").otherwise(_say("has_entry = {}", c("has_entry")))
    odd = units.withColumn("_e", expected).withColumn("_why", why).filter(c("rule") != c("_e"))
    return _violations(odd, "MAP-26", _say("unit rule is {}, {} says {}", c("rule"), c("_why"), c("_e")), keys)


def section_inversions(ports: DataFrame, keys: Sequence[str] = KEYS, chunk: int = 100_000) -> DataFrame:
    """Ports whose section comes before that of the port in front of them on the same side, with that port."""
    rank = F.array_position(F.array(*[F.lit(s) for s in fixed.SECTIONS]), c("section"))
    ranked = ports.withColumn("_rank", rank.cast("int"))
    seen = carried(ranked, [*keys, "side"], ["pos"], F.floor(c("pos") / chunk), {
        "_prev": F.struct(c("_rank").alias("rank"), c("id").alias("id"), c("section").alias("section"))})
    return seen.filter(c("_rank") < c("_prev.rank")).select(
        *keys, "side", "id", "section", c("_prev.id").alias("after"), c("_prev.section").alias("after_section"))


def externals_on_rails(ports: DataFrame, externals: DataFrame, items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Port kinds are known, every external is behind a port, sections are in order, no item sits in the rail column
    and no external among the items. externals (keys, id)."""
    odd_kind = ports.filter(~c("kind").isin(fixed.PORT_KINDS))
    behind = ports.filter(c("external").isNotNull()).select(*keys, c("external").alias("id")).distinct()
    bare = externals.select(*keys, "id").distinct().join(behind, [*keys, "id"], "left_anti")
    back = section_inversions(ports, keys)
    railed = items.filter(c("column") == fixed.RAIL_COLUMN)
    placed = items.filter(c("column").isNotNull() & (c("column") != fixed.RAIL_COLUMN)).join(
        externals.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")
    parts = [
        _violations(odd_kind, "MAP-31", _say("port {} has kind {}, not a known one", c("id"), c("kind")), keys),
        _violations(bare, "MAP-31", _say("external {} is not a port", c("id")), keys),
        _violations(back, "MAP-31", _say("{} rail puts {} ({}) after {} ({})", c("side"), c("id"), c("section"), c("after"), c("after_section")), keys),
        _violations(railed, "MAP-31", _say("{} sits in the rail column " + fixed.RAIL_COLUMN, c("id")), keys),
        _violations(placed, "MAP-31", _say("external {} is placed in column {}", c("id"), c("column")), keys),
    ]
    return reduce(DataFrame.unionByName, parts)


def rail_docking(positions: DataFrame, without_rails: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rails move nothing."""
    return moved_positions("MAP-32", "rails", positions, without_rails, keys)


def ports_from_facts(ports: DataFrame, externals: DataFrame, rail_edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ports name a known external, and an edge ends on its external's port. rail_edges (keys, from, external, port)."""
    known = externals.select(*keys, c("id").alias("external")).distinct().withColumn("_known", F.lit(True))
    named = ports.join(known, [*keys, "external"], "left")
    message = F.when(c("external").isNull(), _say("port {} has no witness external", c("id"))).when(
        c("_known").isNull(), _say("port {} names external {}, absent from the facts", c("id"), c("external")))
    docks = ports.select(*keys, c("id").alias("port"), c("external").alias("_docked"))
    edges = rail_edges.join(docks, [*keys, "port"], "left").filter(~c("_docked").eqNullSafe(c("external")))
    return _violations(named.withColumn("_m", message).filter(c("_m").isNotNull()), "CANVAS-2", c("_m"), keys).unionByName(
        _violations(edges, "CANVAS-2", _say("edge {} → {} ends on {}, not on that external's port", c("from"), c("external"), c("port")), keys))


def finding_confidence(findings: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """No finding blocks or gates on a guessed link, and none gates on a declared one."""
    # Only what can break the rule is joined.
    trust = links.filter(c("confidence").isin("guessed", "declared")).select(*keys, _brief(c("id")).alias("_link"), "confidence")
    bold = findings.filter(c("link").isNotNull() & ((c("level") == "block") | c("gates_merge")))
    both = bold.select(*keys, "id", "link", "level", "gates_merge", _brief(c("link")).alias("_link")).join(trust, [*keys, "_link"])
    message = F.when(
        (c("confidence") == "guessed") & ((c("level") == "block") | c("gates_merge")),
        _say("finding {} on guessed link {} blocks or gates", c("id"), c("link")),
    ).when((c("confidence") == "declared") & c("gates_merge"), _say("finding {} on declared link {} gates a merge", c("id"), c("link")))
    return _violations(both.withColumn("_m", message).filter(c("_m").isNotNull()), "ADR-9", c("_m"), keys)


def origin_is_core(findings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _violations(findings.filter(c("origin") != "core"), "ORIGIN", _say("finding {} has origin {}", c("id"), c("origin")), keys)


def load_input(items: DataFrame, links: DataFrame, entries: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The checks' items and links from facts: public surface, a hash of each item's own facts, link ids of their parts.

    Only links between items are drawn.
    """
    named = entries.select(*keys, c("item").alias("id")).distinct().withColumn("_named", F.lit(True))
    facts = F.to_json(F.struct(*[c(n) for n in items.columns if n not in keys]))
    seen = items.withColumn("content_hash", F.sha2(facts, 256)).join(named, [*keys, "id"], "left").select(
        *keys, "id", c("crate").alias("krate"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("area"),
        C.is_public(c("visibility"), c("reexported"), c("_named")).alias("public"), "content_hash")
    member = F.coalesce(F.concat(F.lit("."), "member"), F.lit(""))
    drawn = links.filter(c("target_kind") == "item").select(
        *keys, F.concat("from", F.lit(" -"), "kind", member, F.lit("-> "), "target_id").alias("id"), "from", c("target_id").alias("to"),
        "kind", F.when(c("confidence").isin("resolved", "declared"), c("confidence")).otherwise("guessed").alias("confidence"),
        F.lit(None).cast("string").alias("unresolved"))
    return seen, drawn


def checks_of(v: dict[str, DataFrame], reach_at: int, keys: Sequence[str]) -> dict[str, tuple[tuple[str, ...], Callable[[], DataFrame]]]:
    """Each check: the tables it reads, and how it is run."""
    return {
        "positions_stable": (("items", "positions", "base_items", "base_positions"), lambda: positions_stable(v["items"], v["positions"], v["base_items"], v["base_positions"], keys)),
        "columns_are_sides": (("items", "areas", "units"), lambda: columns_are_sides(v["items"], v["areas"], v["units"], keys)),
        "no_state_relayout": (("with_overlays", "positions", "overlays"), lambda: no_state_relayout(v["with_overlays"], v["positions"], v["overlays"], keys)),
        "fold_floor": (("fold",), lambda: fold_floor(v["fold"], keys)),
        "folded_link_counts": (("items", "links", "areas", "findings", "chip_links"), lambda: folded_link_counts(v["items"], v["links"], v["areas"], v["findings"], v["chip_links"], keys)),
        "reach_depth": (("items", "reach_links", "reach"), lambda: reach_depth(v["items"], v["reach_links"], v["reach"], reach_at, keys)),
        "overlay_stacking": (("overlays",), lambda: overlay_stacking(v["overlays"], keys)),
        "unresolved_one_pill": (("items", "links", "pills"), lambda: unresolved_one_pill(v["items"], v["links"], v["pills"], keys)),
        "direction_marked": (("items", "links", "units", "findings"), lambda: direction_marked(v["items"], v["links"], v["units"], v["findings"], keys)),
        "column_rule_from_entry": (("entry_units",), lambda: column_rule_from_entry(v["entry_units"])),
        "cross_unit_public": (("items", "links"), lambda: cross_unit_public(v["items"], v["links"], keys)),
        "externals_on_rails": (("ports", "externals", "items"), lambda: externals_on_rails(v["ports"], v["externals"], v["items"], keys)),
        "rail_docking": (("positions", "without_rails"), lambda: rail_docking(v["positions"], v["without_rails"], keys)),
        "ports_from_facts": (("ports", "externals", "rail_edges"), lambda: ports_from_facts(v["ports"], v["externals"], v["rail_edges"], keys)),
        "finding_confidence": (("findings", "links"), lambda: finding_confidence(v["findings"], v["links"], keys)),
        "origin_is_core": (("findings",), lambda: origin_is_core(v["findings"], keys)),
    }


def check_all(view: dict[str, DataFrame], reach_at: int = 2, keys: Sequence[str] = KEYS, skip: Collection[str] = ()) -> DataFrame:
    """Every check as one table of violations. A table that is absent fails, unless ``skip`` names the checks that read it.

    ``reach_links`` are the links that Reach sets are drawn over, if others than ``links``; ``entry_units`` the units with
    their rule, override and entry flag, if others than ``units``.
    """
    view = {"reach_links": view.get("links"), "entry_units": view.get("units")} | view
    checks = {n: x for n, x in checks_of(view, reach_at, keys).items() if n not in skip}
    absent = {n: [t for t in tables if view.get(t) is None] for n, (tables, _) in checks.items()}
    if missing := {n: t for n, t in absent.items() if t}:
        raise ValueError(f"tables that checks need are absent: {missing}")
    return reduce(DataFrame.unionByName, [run() for _, run in checks.values()])
