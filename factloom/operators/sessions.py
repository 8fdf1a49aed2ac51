"""Work sessions: who wrote what, audits of writes, gates, reviews, forge state and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators.ordered import carried, first_by, last_by, numbered
from factloom.session import materialize

c = F.col
SESSION = ["session"]


def attribute_writes(changes: DataFrame, states: DataFrame) -> DataFrame:
    """Changes with ``writer``: the session whose expected (path, hash) matches, first by state file, else ``you``.

    changes (worktree, path, sha256, removed, …); states (worktree, state_file, session, path, sha256).
    """
    claims = states.groupBy("worktree", "path", "sha256").agg(F.min_by("session", "state_file").alias("_session"))
    on = ["worktree", "path", "sha256"]
    writer = F.when(c("removed"), "you").otherwise(F.coalesce("_session", F.lit("you")))
    return changes.join(claims, on, "left").withColumn("writer", writer).drop("_session")


def stale_write_audit(log: DataFrame, chunk: Column) -> DataFrame:
    """The writes of a log with ``last_seen`` and ``verdict``: fresh, stale, never-read, or new for a file not there yet.

    log (element, path, ts, seq, op, hash, new_hash): ``hash`` is the content on disk (null: no file), ``new_hash`` what a
    landed write left, which its element has seen. ``chunk`` cuts time so that no (element, path) is one task's work.
    """
    seen = F.when(c("op") == "read", c("hash")).when(c("op") == "write", c("new_hash"))
    known = carried(log, ["element", "path"], ["ts", "seq"], chunk, {"last_seen": seen})
    verdict = (
        F.when(c("hash").isNull(), "new").when(c("last_seen").isNull(), "never-read")
        .when(c("last_seen") != c("hash"), "stale").otherwise("fresh")
    )
    return known.filter(c("op") == "write").withColumn("verdict", verdict)


def scope_audit(writes: DataFrame, files: DataFrame) -> DataFrame:
    """Writes outside their element's files, with the list it may write.

    writes (element, path, …); files (element, path). An element's own files are a short list from its plan.
    """
    mine = files.select("element", C.normalize_path(c("path")).alias("path")).distinct()
    may = mine.groupBy("element").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("may_write"))
    outside = writes.withColumn("path", C.normalize_path(c("path"))).join(mine, ["element", "path"], "left_anti")
    return outside.join(may, "element", "left").withColumn("may_write", F.coalesce("may_write", F.lit("nothing")))


def pair_tool_results(results: DataFrame, calls: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Tool results with their call's tool name, empty when the call is unknown. calls (keys, pos, tool_use_id, tool)."""
    named = calls.groupBy(*keys, "tool_use_id").agg(F.max_by("tool", "pos").alias("_tool"))
    return results.join(named, [*keys, "tool_use_id"], "left").withColumn("tool", F.coalesce("_tool", F.lit(""))).drop("_tool")


def thread_projection(events: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Turn events as thread lines: text, tool calls, tool results and results, each in one line; the rest drops out.

    events (keys, pos, kind, text, tool_use_id, tool, input, ok, subtype).
    """
    calls = events.filter(c("kind") == "tool-call").select(*keys, "pos", "tool_use_id", "tool")
    kept = events.filter(c("kind").isin("text", "tool-call", "tool-result", "result")).drop("tool")
    named = pair_tool_results(kept, calls, keys)
    summary = (
        F.when(c("kind") == "tool-call", C.one_line(c("input"))).when(c("kind") == "tool-result", C.short(c("text")))
        .when(c("kind") == "result", F.coalesce("text", "subtype"))
    )
    uses_tool = c("kind").isin("tool-call", "tool-result")
    return named.select(
        *keys, "pos", "kind", F.when(c("kind") == "text", c("text")).alias("text"), F.when(uses_tool, c("tool")).alias("tool"),
        F.when(c("kind") == "tool-result", c("ok")).alias("ok"), summary.alias("summary"),
    )


def tool_state(log: DataFrame) -> DataFrame:
    """What each element's tool layer holds after a log: (element, path, holds, hash), ``holds`` being read or expected.

    log (element, path, pos, op, hash): ``read`` and ``confirm`` show the content; ``expect`` adds an expected content;
    ``confirm`` leaves its own as the only one; ``fail`` leaves only the content on disk, if it was expected.
    A content is expected when it was last set after the path was last cleared of it, so two maxima decide and no event
    list is gathered.
    """
    path = ["element", "path"]
    read = (
        log.filter(c("op").isin("read", "confirm") & c("hash").isNotNull()).groupBy(*path)
        .agg(F.max_by("hash", "pos").alias("hash")).withColumn("holds", F.lit("read"))
    )
    sets = log.filter(c("op").isin("expect", "confirm")).groupBy(*path, "hash").agg(F.max("pos").alias("_set"))
    clears = log.filter(c("op").isin("confirm", "fail")).groupBy(*path, F.coalesce("hash", F.lit("")).alias("by")).agg(F.max("pos").alias("at"))
    # The last clear of a path, and the last one by any other content.
    top = clears.groupBy(*path).agg(F.max(F.struct("at", "by")).alias("top"))
    second = (
        clears.join(top, path).filter(c("by") != c("top.by")).groupBy(*path).agg(F.max("at").alias("second"))
    )
    cleared = F.when(c("top.by") == c("hash"), c("second")).otherwise(c("top.at"))
    expected = (
        sets.join(top, path, "left").join(second, path, "left")
        .filter(c("_set") >= F.coalesce(cleared, F.lit(-1)))
        .select(*path, "hash").withColumn("holds", F.lit("expected"))
    )
    return read.select(*path, "holds", "hash").unionByName(expected.select(*path, "holds", "hash"))


# ---------------------------------------------------------------- gates and judges


def complete_verdicts(elements: DataFrame, answers: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """A verdict for every element: the last answer that names it by id or label; anything but pass is fail, none is fail.

    elements (keys, group, id, label); answers (keys, pos, named, verdict, reason).
    """
    names = elements.select(*keys, "id", F.explode(F.array_distinct(F.array("id", "label"))).alias("named"))
    said = (
        names.join(answers, [*keys, "named"]).groupBy(*keys, "id")
        .agg(F.max_by(F.struct("verdict", "reason"), "pos").alias("_a"))
    )
    return elements.join(said, [*keys, "id"], "left").select(
        *elements.columns, F.when(c("_a.verdict") == "pass", "pass").otherwise("fail").alias("verdict"),
        F.when(c("_a").isNull(), "the judge gave no verdict for this element").otherwise(F.coalesce("_a.reason", F.lit(""))).alias("reason"),
    )


def gate_outcomes(verdicts: DataFrame, runs: DataFrame, groups: DataFrame, keys: Sequence[str] = ("session", "group")) -> DataFrame:
    """Per group: which elements go back and what happens: passed, fix-round or budget-spent.

    verdicts (keys, element, verdict); runs (keys, exit_code); groups (keys, fix_round, fix_rounds, extra_rounds).
    ``failing`` counts the failing elements; a failed command with no failing verdict sends the whole group back.
    """
    judged = verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("elements"), F.count_if(c("verdict") == "fail").alias("_failed"))
    ran = runs.groupBy(*keys).agg(F.bool_or(c("exit_code") != 0).alias("_broken"))
    joined = groups.join(judged, list(keys), "left").join(ran, list(keys), "left")
    failing = F.when(F.coalesce("_failed", F.lit(0)) > 0, c("_failed")).when(
        F.coalesce("_broken", F.lit(False)), F.coalesce("elements", F.lit(0))).otherwise(F.lit(0))
    failed = (F.coalesce("_failed", F.lit(0)) > 0) | F.coalesce("_broken", F.lit(False))
    outcome = F.when(~failed, "passed").when(c("fix_round") < c("fix_rounds") + c("extra_rounds"), "fix-round").otherwise("budget-spent")
    return joined.select(*keys, failing.cast("bigint").alias("failing"), outcome.alias("outcome"))


def failing_elements(verdicts: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ("session", "group")) -> DataFrame:
    """The elements that go back, as rows: those with a fail verdict, else all of the group."""
    back = outcomes.filter(c("outcome") != "passed").select(*keys)
    named = verdicts.filter(c("verdict") == "fail")
    blamed = named.select(*keys).distinct()
    return named.join(back, list(keys), "left_semi").select(*keys, "element").unionByName(
        verdicts.join(back, list(keys), "left_semi").join(blamed, list(keys), "left_anti").select(*keys, "element"))


def gate_summaries(runs: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("session", "group")) -> DataFrame:
    """One line per gate: ``gate · <group> · cmd ✓ · cmd ✗ (exit n) · judge p/n pass``. A gate runs a few commands.

    runs (keys, pos, command, exit_code); verdicts (keys, element, verdict).
    """
    said = F.when(c("exit_code") == 0, F.concat("command", F.lit(" ✓"))).otherwise(
        F.concat("command", F.lit(" ✗ (exit "), c("exit_code").cast("string"), F.lit(")")))
    lines = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("text")))).alias("_r")).select(
        *keys, F.array_join(F.transform("_r", lambda r: r["text"]), " · ").alias("_runs"))
    judged = verdicts.groupBy(*keys).agg(F.count_if(c("verdict") == "pass").alias("_p"), F.count(F.lit(1)).alias("_n"))
    judge = F.concat(F.lit("judge "), c("_p").cast("string"), F.lit("/"), c("_n").cast("string"), F.lit(" pass"))
    return lines.join(judged, list(keys), "full").select(
        *keys, F.concat_ws(" · ", F.lit("gate"), c(keys[-1]).cast("string"), "_runs", judge).alias("line"))


def latest_verdicts(records: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """The last judge verdict of each element. records (keys, seq, kind, element, verdict, reason)."""
    judged = records.filter(c("kind") == "judge-verdict").select(*keys, "element", "seq", "verdict", "reason")
    return last_by(judged, [*keys, "element"], ["seq"]).drop("seq")


# ---------------------------------------------------------------- forge


def checks_summary(checks: DataFrame, keys: Sequence[str] = ("sha",)) -> DataFrame:
    """failed when any check failed, else pending when any is, else passed. checks (keys, state)."""
    return checks.groupBy(*keys).agg(
        F.when(F.bool_or(c("state") == "failed"), "failed").when(F.bool_or(c("state") == "pending"), "pending")
        .otherwise("passed").alias("summary"))


def pick_requests(pulls: DataFrame, keys: Sequence[str] = ("branch",)) -> DataFrame:
    """Per branch the first open request, else the first listed. pulls (keys, pos, state, …)."""
    return first_by(pulls, keys, [(c("state") != "open").cast("int"), "pos"])


def fold_reviews(reviews: DataFrame, requested: DataFrame, keys: Sequence[str] = ("pr",)) -> DataFrame:
    """(keys, reviewer, state): each reviewer's standing verdict.

    Asked again outranks all; after the last dismissal the last approval or change request stands, comments undo
    nothing; pending reviews are drafts. Two maxima per reviewer say it, so reviews are never gathered.
    reviews (keys, pos, reviewer, state); requested (keys, reviewer).
    """
    who = [*keys, "reviewer"]
    verdict = F.when(c("state").isin("APPROVED", "CHANGES_REQUESTED"), F.struct("pos", "state"))
    seen = (
        reviews.filter(c("state").isin("APPROVED", "CHANGES_REQUESTED", "COMMENTED", "DISMISSED") & c("reviewer").isNotNull())
        .groupBy(*who).agg(F.max(verdict).alias("_v"), F.max(F.when(c("state") == "DISMISSED", c("pos"))).alias("_d"))
    )
    asked = requested.select(*who).distinct().withColumn("_asked", F.lit(True))
    stands = c("_v.pos") > F.coalesce("_d", F.lit(-1))
    state = F.when(c("_asked"), "requested").when(stands & (c("_v.state") == "APPROVED"), "approved").when(
        stands, "changes-requested").otherwise("commented")
    return asked.join(seen, who, "full").select(*who, state.alias("state"))


# ---------------------------------------------------------------- reports


def denied_scope_paths(records: DataFrame, starts: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """(keys, element, seq, path) of scope denials since the element's turn began.

    records (keys, seq, kind, element, path, reason); starts (keys, element, start_seq).
    """
    denials = records.filter((c("kind") == "denial") & (C.denial_cause(c("reason")) == "scope"))
    return denials.join(starts, [*keys, "element"]).filter(c("seq") > c("start_seq")).select(*keys, "element", "seq", "path")


def session_reports(sessions: DataFrame, thread: DataFrame, denied: DataFrame, tool_author: str = "tool", keys: Sequence[str] = SESSION) -> DataFrame:
    """Per session its state, gate lines, last questions when it asks, denied paths when it deviates.

    thread (keys, seq, author, kind, text); denied (keys, seq, path). Gate lines and denials are a short list of
    one session; they are chosen before they are gathered.
    """
    gates = thread.filter(C.is_gate_line(c("author"), c("text"), tool_author) & (c("kind") == "text")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_g"))
    asks = thread.filter(c("kind") == "ask").groupBy(*keys).agg(F.max_by("text", "seq").alias("_q"))
    deviating = sessions.filter(c("state") == "deviation").select(*keys)
    paths = denied.join(deviating, list(keys), "left_semi").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("seq", "path"))).alias("_d"))
    texts = lambda col, field: F.coalesce(F.transform(col, lambda x: x[field]), F.array().cast("array<string>"))
    return (
        sessions.join(gates, list(keys), "left").join(asks, list(keys), "left").join(paths, list(keys), "left")
        .select(*keys, "state", texts("_g", "text").alias("gates"),
                F.when(c("state").isin("asks", "gate-failed"), c("_q")).alias("questions"), texts("_d", "path").alias("denied"))
    )


def review_descriptions(
    sessions: DataFrame, elements: DataFrame, verdicts: DataFrame, gates: DataFrame, overrides: DataFrame, keys: Sequence[str] = SESSION
) -> DataFrame:
    """(keys, section, pos, line): the description of each session's request, line by line.

    The lines of one session sorted by (section, pos) are the document; they stay rows, so a long plan is no long row.
    sessions (keys, intention); elements (keys, pos, id, label, intention, site, files); verdicts (keys, element, verdict,
    reason); gates (keys, seq, text); overrides (keys, seq, what, reason, by).
    """
    counted = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    line = lambda d, n, pos, text: d.select(*keys, F.lit(n).alias("section"), pos.cast("bigint").alias("pos"), text.alias("line"))
    head = line(sessions, 0, zero, c("intention"))
    count = line(sessions.join(counted, list(keys), "left"), 1, zero, F.concat(
        F.lit("session `"), c(keys[0]), F.lit("` · "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" element(s)")))
    said = verdicts.select(*keys, c("element").alias("id"), F.concat("verdict", F.lit(" · "), "reason").alias("_v"))
    files = F.array_join(F.transform("files", lambda f: F.concat(F.lit("`"), f, F.lit("`"))), " ")
    row = F.concat(
        F.lit("| "), "label", F.lit(" | "), C.markdown_cell(c("intention")), F.lit(" | `"), "site", F.lit("` | "), files, F.lit(" | "),
        C.markdown_cell(F.coalesce("_v", F.lit("—"))), F.lit(" |"))
    rows = line(elements.join(said, [*keys, "id"], "left"), 2, c("pos"), row)
    gate = line(gates, 3, c("seq"), F.concat(F.lit("- "), "text"))
    over = line(overrides, 4, c("seq"), F.concat(F.lit("- "), "what", F.lit(" accepted as is by "), "by", F.lit(": "), "reason"))
    return head.unionByName(count).unionByName(rows).unionByName(gate).unionByName(over)


# ---------------------------------------------------------------- files of a session


def archive_sessions(files: DataFrame, path: str, keys: Sequence[str] = SESSION) -> None:
    """Write each session's files to a folder of its own, sorted by path. files (keys, path, content).

    Sorted in ranges: a session with very many files is several pack files in name order, never one long row.
    """
    ordered = files.select(*keys, "path", "content").repartitionByRange(*keys, "path").sortWithinPartitions(*keys, "path")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def restore_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The files of archived sessions: (session, path, content)."""
    return spark.read.schema("path string,content string,session string").parquet(path)


def replace_file(files: DataFrame, path: str, content: Column) -> DataFrame:
    """Files with one path's content replaced wherever it is held."""
    return files.withColumn("content", F.when(c("path") == path, content).otherwise(c("content")))


def append_after(old: DataFrame, new: DataFrame, order: Sequence[str], chunk: Column, keys: Sequence[str] = SESSION) -> DataFrame:
    """New rows with ``seq`` going on from the last one of their session. old (keys, seq); new (keys, …)."""
    last = old.groupBy(*keys).agg(F.max("seq").alias("_last"))
    ranked = numbered(new, keys, order, chunk, "_n")
    return ranked.join(last, list(keys), "left").withColumn(
        "seq", (F.coalesce("_last", F.lit(0)) + c("_n")).cast("bigint")).drop("_last", "_n")


# ---------------------------------------------------------------- the life of a session

PER_CHUNK = 512


def transitions(spark) -> DataFrame:
    """The legal edges as a table of 18 rows: (state, trigger, next)."""
    return spark.createDataFrame(fixed.TRANSITIONS, "state string,trigger string,next string")


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Moves (…, state, trigger) outside the table."""
    return moves.join(F.broadcast(transitions(moves.sparkSession)), ["state", "trigger"], "left_anti")


def replay_lifecycles(triggers: DataFrame, start: str = "planning", chunk: Column | None = None, keys: Sequence[str] = SESSION) -> DataFrame:
    """(keys, state, illegal): each session's state after all its triggers in order; illegal ones are counted and skipped.

    A trigger is a function on the 11 states and functions compose, so a session of any length is folded in parallel:
    rows of a chunk become one table "state before → state after, illegal moves"; chunks' tables are composed the same way,
    level by level, each step over at most 512 rows. triggers (keys, seq, trigger).
    """
    states = fixed.SESSION_STATES
    names = F.array(*[F.lit(s) for s in states])
    edges = {(a, t): b for a, t, b in fixed.TRANSITIONS}
    legal = sorted({t for _, t, _ in fixed.TRANSITIONS})
    # One row of the function per trigger; a missing edge keeps the state and counts one illegal move.
    spark = triggers.sparkSession
    table = spark.createDataFrame(
        [(t, [(states.index(edges.get((s, t), s)), int((s, t) not in edges)) for s in states]) for t in legal],
        "trigger string,step array<struct<to:int,bad:bigint>>",
    )
    unknown = F.transform(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda n: F.struct(n.cast("int").alias("to"), F.lit(1).cast("bigint").alias("bad")))
    ranked = numbered(triggers, keys, ["seq"], F.floor(c("seq") / 100_000) if chunk is None else chunk, "_n")
    steps = ranked.join(F.broadcast(table), "trigger", "left").select(
        *keys, (c("_n") - 1).alias("_n"), F.coalesce("step", unknown).alias("step"))
    longest = steps.agg(F.max("_n")).first()[0]
    identity = F.transform(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda n: F.struct(n.cast("int").alias("to"), F.lit(0).cast("bigint").alias("bad")))
    then = lambda acc, m: F.transform(acc, lambda a: F.struct(
        F.get(m["step"], a["to"])["to"].alias("to"), (a["bad"] + F.get(m["step"], a["to"])["bad"]).alias("bad")))
    while longest is not None:
        steps = steps.groupBy(*keys, F.floor(c("_n") / PER_CHUNK).alias("_n")).agg(
            F.array_sort(F.collect_list(F.struct("_n", "step"))).alias("_l")
        ).select(*keys, "_n", F.aggregate("_l", identity, then).alias("step"))
        if longest < PER_CHUNK:
            break
        steps = materialize(steps, "lifecycles")
        longest //= PER_CHUNK
    at = F.get("step", F.lit(states.index(start)))
    return steps.select(*keys, F.get(names, at["to"]).alias("state"), at["bad"].alias("illegal"))
