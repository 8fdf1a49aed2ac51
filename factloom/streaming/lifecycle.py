"""The session state machine as a stream that takes triggers in any order.

A trigger is a function on the states, and functions compose. A session's state is a list of runs: gap-free ranges of seq
with the function of all their triggers. A trigger that comes late joins the run it belongs to, or fills the gap between two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom import fixed
from factloom.operators.bursts import micros
from factloom.streaming.closing import next_timer, use_state_with_timers

LAST = "archived"


def trigger_functions() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By trigger, for each state the state after it and whether that was an illegal move."""
    states = fixed.SESSION_STATES
    moves = {(a, t): b for a, t, b in fixed.TRANSITIONS}
    return {
        t: (np.array([states.index(moves.get((s, t), s)) for s in states]), np.array([(s, t) not in moves for s in states], np.int64))
        for t in {t for _, t, _ in fixed.TRANSITIONS}
    }


def composed(to: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function of n functions one after another: row k gives the state after each state, and the illegal moves."""
    while len(to) > 1:
        even = len(to) // 2 * 2
        a, b = slice(0, even, 2), slice(1, even, 2)
        paired = np.take_along_axis(to[b], to[a], 1), bad[a] + np.take_along_axis(bad[b], to[a], 1)
        to, bad = (np.concatenate((x, y[even:])) for x, y in zip(paired, (to, bad), strict=True))
    return to[0], bad[0]


def joined(runs: list[tuple]) -> list[tuple]:
    """Runs (first, last, to, bad) in order with neighbours that leave no gap put together; a run inside another is a repeat."""
    out, group = [], []

    def flush() -> None:
        if group:
            to, bad = composed(np.array([g[2] for g in group]), np.array([g[3] for g in group]))
            out.append((group[0][0], group[-1][1], to, bad))
            group.clear()

    reach = None
    for run in sorted(runs, key=lambda r: (r[0], -r[1])):
        if reach is not None and run[1] <= reach:
            continue
        if reach is not None and run[0] != reach + 1:
            flush()
        group.append(run)
        reach = run[1]
    flush()
    return out


class Lifecycle(StatefulProcessor):
    """State: the runs of a session. A session that is archived and quiet is forgotten by a timer."""

    def __init__(self, start: str, quiet_us: int):
        self.start, self.quiet = fixed.SESSION_STATES.index(start), quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first bigint,last bigint,to array<int>,bad array<bigint>")
        self.newest = handle.getValueState("newest", "at bigint")
        n = len(fixed.SESSION_STATES)
        self.known, self.other = trigger_functions(), (np.arange(n), np.ones(n, np.int64))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = [(a, b, np.array(to), np.array(bad)) for a, b, to, bad in self.runs.get()] if self.runs.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else 0
        for part in rows:
            newest = max(newest, int(part["at"].max()))
            runs += [(s, s, *self.known.get(t, self.other)) for s, t in zip(part["seq"].astype("int64").tolist(), part["trigger"].tolist(), strict=True)]
        runs = joined(runs)
        self.runs.put([(a, b, [int(x) for x in to], [int(x) for x in bad]) for a, b, to, bad in runs])
        self.newest.update((newest,))
        to, bad = composed(np.array([r[2] for r in runs]), np.array([r[3] for r in runs]))
        state = fixed.SESSION_STATES[to[self.start]]
        next_timer(self.handle, newest + self.quiet if state == LAST else None)
        yield pd.DataFrame({"session": pd.Series([key[0]], dtype=object), "state": pd.Series([state], dtype=object), "illegal": [int(bad[self.start])], "gaps": [len(runs) - 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.runs.clear()
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def lifecycle_stream(triggers: DataFrame, delay: str = "1 day", quiet: str = "7 days", start: str = "planning") -> DataFrame:
    """(session, state, illegal, gaps) after each micro-batch that has triggers of the session, in update mode.

    triggers (session, seq, trigger, ts). After any split of the rows over micro-batches a session's last row is the state of
    all its triggers in order of seq, illegal ones counted and skipped; ``gaps`` counts breaks in the seqs seen so far. A seq
    that comes again is a repeat and changes nothing; rows with a null seq or time take no part. Triggers later than ``delay``
    are dropped. A session that has been archived for ``quiet`` is forgotten.
    """
    use_state_with_timers(triggers.sparkSession)
    quiet_us = triggers.sparkSession.sql(f"SELECT CAST(1000000 * (unix_seconds(TIMESTAMP '2001-01-01' + INTERVAL {quiet}) - unix_seconds(TIMESTAMP '2001-01-01')) AS BIGINT)").first()[0]
    timed = triggers.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", delay)
    rows = timed.select("session", "ts", micros(F.col("ts")).alias("at"), "seq", "trigger")
    return rows.groupBy("session").transformWithStateInPandas(
        Lifecycle(start, quiet_us), "session string,state string,illegal bigint,gaps bigint", "update", "eventTime")
