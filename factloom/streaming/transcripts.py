"""Transcripts read as they arrive, with the places of their lines and the end of each turn."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.bursts import micros
from factloom.sources.logs import parse_transcript
from factloom.streaming.closing import next_timer, use_state_with_timers

c = F.col
#: The subtype of the result that ends a turn whose transcript went quiet.
UNFINISHED = "unfinished"


class Turns(StatefulProcessor):
    """Numbers the lines of a transcript, which may go on in later files, and ends a turn that has no result in time.

    State: the lines so far, the open turn's session id, and the time of the newest file.
    """

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("turn", "lines bigint,open boolean,id string,newest bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines, open_, id_, newest = self.state.get() if self.state.exists() else (0, False, "", 0)
        part = pd.concat(list(rows)).sort_values(["part", "row"], kind="stable")
        newest = max(newest, int(part["at"].max()))
        # What the last line with a say in it leaves: a result closes the turn, any other event opens or keeps one.
        told = part[part["told"].notna()]
        if len(told):
            after = told["told"].eq("result").to_numpy().nonzero()[0]
            tail = told.iloc[after[-1] + 1 :] if len(after) else told
            if len(after):
                open_, id_ = False, ""
            if len(tail):
                named = tail["id"][tail["id"].fillna("") != ""]
                open_, id_ = True, named.iloc[-1] if len(named) else id_
        part["pos"] = range(lines + 1, lines + 1 + len(part))
        self.state.update((lines + len(part), open_, id_, newest))
        next_timer(self.handle, newest + self.quiet if open_ else None)
        yield self._lines(key, part["pos"].tolist(), part["value"].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lines, open_, id_, newest = self.state.get() if self.state.exists() else (0, False, "", 0)
        self.state.update((lines, False, "", newest))
        if open_:
            yield self._lines(key, [lines], [json.dumps({"type": "result", "subtype": UNFINISHED, "is_error": True, "session_id": id_})])

    @staticmethod
    def _lines(key, places: list[int], values: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"file": pd.Series([key[0]] * len(places), dtype=object), "pos": places, "value": pd.Series(values, dtype=object)})

    def close(self) -> None:
        pass


def transcript_stream(spark: SparkSession, path: str, transcript: str = r"([^/]*)$", quiet_us: int = 3_600_000_000, delay: str = "1 minute", **options) -> DataFrame:
    """Turn events of transcript files as they land in a folder; the folder must exist.

    ``transcript`` finds a transcript's name in a file's path; its files go on from one another in order of path, and a
    file that lands after later ones counts from where the transcript is then. Columns are those of ``parse_transcript``:
    ``file`` is the transcript and ``pos`` its line, counted from 1. A turn is open from its first event to its result. If
    nothing has come for ``quiet_us`` past the newest file's time of change, seen against the watermark over all files, the
    turn ends with a result that is not ok, subtype ``unfinished``, at the last line's place. A file is read by one
    task, and a transcript's lines of one micro-batch are put in order in one; the session's log bounds both.
    """
    use_state_with_timers(spark)
    # A file lands whole, and only a whole text tells the places of its lines in a stream.
    files = spark.readStream.options(**options).text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", transcript, 1).alias("file"), c("_metadata.file_path").alias("part"),
        c("_metadata.file_modification_time").alias("ts"), F.split("value", "\r\n|\n|\r").alias("lines"))
    lines = files.select("file", "part", "ts", F.size("lines").alias("n"), F.posexplode("lines").alias("row", "value")).where("row < n - 1 OR value != ''")
    kind = F.get_json_object("value", "$.type")
    read = kind.isin("assistant", "user", "result") | ((kind == "system") & F.get_json_object("value", "$.subtype").isin("init", "task_started", "hook_response"))
    rows = lines.withWatermark("ts", delay).select(
        "file", "part", "row", "ts", micros(c("ts")).alias("at"), F.when(read, kind).alias("told"),
        F.get_json_object("value", "$.session_id").alias("id"), "value")
    numbered = rows.groupBy("file").transformWithStateInPandas(Turns(quiet_us), "file string,pos bigint,value string", "append", "eventTime")
    return parse_transcript(numbered)


def unfinished_turns(events: DataFrame) -> DataFrame:
    """Sessions that have events and no result: an error once their transcript has ended."""
    named = events.filter(c("session_id") != "")
    done = named.filter(c("kind") == "result").select("session_id").distinct()
    return named.select("session_id").distinct().join(done, "session_id", "left_anti")
