"""Bursts of file changes, as a batch job: a burst ends after a quiet time or at an age limit.

The age limit makes bursts depend on where the one before was cut, so plain gaps are not enough. Changes are first
reduced to distinct times and cut at quiet gaps into islands; only islands older than the limit need more. There each
time points to the first time past its limit, and the cut points are those reached from an island's start: found by
doubling the pointers, in as many rounds as the logarithm of the bursts in the longest island. No island or source is
gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.ordered import carried
from factloom.session import materialize

c = F.col


def micros(ts: Column) -> Column:
    """A time as microseconds, for timestamps with and without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def bursts(changes: DataFrame, quiet_us: int, max_age_us: int, keys: Sequence[str]) -> DataFrame:
    """(keys, burst, at): each distinct time ``at`` of a source with the start of its burst, in microseconds.

    changes (keys, at). A change stays in a burst up to ``quiet_us`` after the one before and ``max_age_us`` after the first.
    """
    keys = list(keys)
    points = changes.select(*keys, "at").distinct()
    width = 64 * max(quiet_us, 1)
    cell = F.floor(c("at") / width)
    gaps = carried(points, keys, ["at"], cell, {"_prev": c("at")})
    opens = F.when(c("_prev").isNull() | (c("at") - c("_prev") > quiet_us), c("at"))
    marked = carried(gaps.withColumn("_open", opens).drop("_prev"), keys, ["at"], cell, {"_island": c("_open")})
    islands = marked.select(*keys, "at", F.coalesce("_open", "_island").alias("island"))
    islands = materialize(islands, "islands")
    old = islands.groupBy(*keys, "island").agg(F.max("at").alias("_end")).filter(c("_end") - c("island") > max_age_us).select(*keys, "island")
    tall = islands.join(old, [*keys, "island"], "left_semi")
    cuts = _cuts(tall, old, max_age_us, keys, width)
    flagged = tall.join(cuts.withColumn("_cut", c("at")), [*keys, "island", "at"], "left")
    within = carried(flagged, [*keys, "island"], ["at"], cell, {"_burst": c("_cut")})
    short = islands.join(old, [*keys, "island"], "left_anti").select(*keys, c("island").alias("burst"), "at")
    return short.unionByName(within.select(*keys, F.coalesce("_cut", "_burst").alias("burst"), "at"))


def _cuts(tall: DataFrame, old: DataFrame, max_age_us: int, keys: list[str], width: int) -> DataFrame:
    """Burst starts (keys, island, at) of the islands older than the limit."""
    on = [*keys, "island"]
    # The first time past each time's limit: seen backwards, the last point before a query placed at that limit.
    points = tall.select(*on, (-c("at")).alias("_back"), F.lit(1).alias("_point"), c("at").alias("_at"), c("at"))
    asked = tall.select(*on, (-(c("at") + max_age_us)).alias("_back"), F.lit(0).alias("_point"), F.lit(None).cast("bigint").alias("_at"), c("at"))
    both = carried(points.unionByName(asked), on, ["_back", "_point", "at"], F.floor(c("_back") / width), {"_next": c("_at")})
    jump = both.filter((c("_point") == 0) & c("_next").isNotNull()).select(*on, "at", c("_next").alias("next"))
    jump = materialize(jump, "jumps")
    starts = materialize(old.select(*on, c("island").alias("at")), "starts")
    while not jump.isEmpty():
        reached = starts.join(jump, [*on, "at"]).select(*on, c("next").alias("at"))
        starts = materialize(starts.unionByName(reached).distinct(), "starts")
        further = jump.select(*on, c("at").alias("next"), c("next").alias("_far"))
        jump = materialize(jump.join(further, [*on, "next"]).select(*on, "at", c("_far").alias("next")), "jumps")
    return starts


def tag_bursts(changes: DataFrame, quiet_us: int, max_age_us: int, keys: Sequence[str]) -> DataFrame:
    """Changes with ``burst``. changes (keys, ts, …)."""
    timed = changes.withColumn("at", micros(c("ts")))
    return timed.join(bursts(timed, quiet_us, max_age_us, keys), [*keys, "at"]).drop("at")


def burst_windows(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, burst, last, changes) of tagged changes."""
    return tagged.groupBy(*keys, "burst").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("changes"))


def quiet_sessions(changes: DataFrame, quiet: str, keys: Sequence[str]) -> DataFrame:
    """Bursts closed by quiet alone: session windows, in a batch or a stream with a watermark. changes (keys, ts)."""
    return (
        changes.groupBy(*keys, F.session_window(c("ts"), quiet).alias("w")).agg(F.count(F.lit(1)).alias("changes"))
        .select(*keys, c("w.start").alias("start"), c("w.end").alias("end"), "changes")
    )


def burst_batches(tagged: DataFrame, keys: Sequence[str], tree: str = "worktree") -> DataFrame:
    """(keys, burst, worktree, path): the distinct paths of each burst's batch per worktree, as rows."""
    cols = [*keys, "burst"] + ([] if tree in keys else [tree])
    return tagged.select(*cols, "path").distinct()


def batches_by_writer(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, writer, files, first): per batch one row per writer, in order of first appearance.

    batches (keys, pos, path, writer).
    """
    return batches.groupBy(*keys, "writer").agg(F.count_distinct("path").alias("files"), F.min("pos").alias("first"))


def rescan(changes: DataFrame, notices: DataFrame, listing: DataFrame) -> DataFrame:
    """Changes plus every file of the worktrees a dropped-events notice concerns; a notice without one concerns all.

    changes (worktree, path); notices (worktree?); listing (worktree, path).
    """
    if notices.filter(c("worktree").isNull()).isEmpty():
        listing = listing.join(notices.select("worktree").distinct(), "worktree", "left_semi")
    return changes.select("worktree", "path").unionByName(listing.select("worktree", "path")).distinct()


def removed_or_changed(batch: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of a closed burst with ``removed``: gone from the listing now. listing (worktree, path, sha256)."""
    return batch.join(listing, ["worktree", "path"], "left").withColumn("removed", c("sha256").isNull())
