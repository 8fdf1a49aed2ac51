"""Logs of work: writes, tools, gates, verdicts, forge state, reports, bursts and lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import columns as C
from factloom.operators import bursts as B
from factloom.operators import sessions as S
from factloom.plans.catalog import Inputs, query
from factloom.plans.views import VIEWS
from factloom.session import scratch_path
from factloom.sources import logs

c = F.col

VIEWS["v_changes"] = """
SELECT 'w' || CAST(user_id % 10 AS STRING) AS worktree, event_type || '/' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.rs' AS path, ts, event_id AS seq,
  'h' || CAST(event_id % 400 AS STRING) AS sha256, event_id % 23 = 0 AS removed FROM events"""
VIEWS["v_states"] = """
SELECT 'w' || CAST(user_id % 10 AS STRING) AS worktree, 'e' || CAST(event_id % 7 AS STRING) AS state_file, 's' || CAST(event_id % 7 AS STRING) AS session,
  event_type || '/' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.rs' AS path, 'h' || CAST((event_id + event_id % 3) % 400 AS STRING) AS sha256 FROM events"""


@query("attribute_writes", """
SELECT c.worktree, c.path, c.seq, CASE WHEN c.removed THEN 'you' ELSE coalesce(s.session, 'you') END AS writer FROM v_changes c
LEFT JOIN (SELECT worktree, path, sha256, arg_min(session, state_file) AS session FROM v_states GROUP BY ALL) s ON s.worktree = c.worktree AND s.path = c.path AND s.sha256 = c.sha256""")
def _(i):
    return S.attribute_writes(i.v_changes, i.v_states).select("worktree", "path", "seq", "writer")


VIEWS["v_tool_log"] = """
SELECT 'e' || CAST(user_id % 10 AS STRING) AS element, 'f' || CAST(CAST(floor(value) AS BIGINT) % 20 AS STRING) AS path, ts, event_id AS seq,
  CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'purchase' THEN 'write' ELSE 'other' END AS op,
  CASE WHEN event_id % 50 <> 3 THEN 'h' || CAST(CAST(floor(event_id / 200) AS BIGINT) AS STRING) END AS hash,
  CASE WHEN event_id % 2 = 0 THEN 'h' || CAST(CAST(floor(event_id / 200) AS BIGINT) AS STRING) ELSE 'own' END AS new_hash FROM events"""


@query("stale_write_audit", """
SELECT element, path, seq, CASE WHEN hash IS NULL THEN 'new' WHEN seen IS NULL THEN 'never-read' WHEN seen <> hash THEN 'stale' ELSE 'fresh' END AS verdict FROM (
  SELECT *, last_value(CASE op WHEN 'read' THEN hash WHEN 'write' THEN new_hash END IGNORE NULLS) OVER (PARTITION BY element, path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM v_tool_log) x WHERE op = 'write'""")
def _(i):
    return S.stale_write_audit(i.v_tool_log, F.date_trunc("day", "ts")).select("element", "path", "seq", "verdict")


VIEWS["v_scope_files"] = """
SELECT DISTINCT 'e' || CAST(user_id % 10 AS STRING) AS element, 'x/../f' || CAST((user_id + user_id % 3) % 20 AS STRING) AS path FROM events"""


@query("scope_audit", """
SELECT t.element, t.path, t.seq, coalesce(m.may, 'nothing') AS may_write FROM v_tool_log t
LEFT JOIN (SELECT element, string_agg(DISTINCT substr(path, 6), ', ' ORDER BY substr(path, 6)) AS may FROM v_scope_files GROUP BY element) m ON m.element = t.element
WHERE t.op = 'write' AND NOT EXISTS (SELECT 1 FROM v_scope_files f WHERE f.element = t.element AND substr(f.path, 6) = t.path)""")
def _(i):
    writes = i.v_tool_log.filter(c("op") == "write").select("element", F.concat(F.lit("./"), "path").alias("path"), "seq")
    return S.scope_audit(writes, i.v_scope_files)


# A tool-layer log: reads, expected writes, confirmed and failed ones.
VIEWS["v_state_log"] = """
SELECT 'e' || CAST(user_id % 10 AS STRING) AS element, 'f' || CAST(CAST(floor(value) AS BIGINT) % 15 AS STRING) AS path, event_id AS pos,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'expect' WHEN 'purchase' THEN 'expect' WHEN 'signup' THEN 'confirm' ELSE 'fail' END AS op,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE 'h' || CAST(event_id % 4 AS STRING) END AS hash FROM events"""


@query("tool_state_replay", """
WITH decisive AS (SELECT t.element, t.path, t.hash, l.pos, CASE WHEN l.op IN ('expect', 'confirm') AND l.hash = t.hash THEN 1 ELSE 0 END AS on_now
  FROM (SELECT DISTINCT element, path, hash FROM v_state_log WHERE op IN ('expect', 'confirm')) t JOIN v_state_log l ON l.element = t.element AND l.path = t.path
  WHERE (l.op = 'expect' AND l.hash = t.hash) OR l.op = 'confirm' OR (l.op = 'fail' AND l.hash IS DISTINCT FROM t.hash))
SELECT element, path, 'expected' AS holds, hash FROM decisive GROUP BY element, path, hash HAVING arg_max(on_now, pos) = 1
UNION ALL SELECT element, path, 'read', arg_max(hash, pos) FROM v_state_log WHERE op IN ('read', 'confirm') GROUP BY element, path""")
def _(i):
    return S.tool_state(i.v_state_log)


@query("read_tool_states", """
SELECT 's' || CAST(user_id % 10 AS STRING) AS session, path, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, event_type || CAST(event_id % 9 AS STRING) AS path FROM events) x GROUP BY ALL""")
def _(i):
    path = scratch_path(i.spark, "tool-states")
    named = i.events.select(F.concat(F.lit("s"), (c("user_id") % 10).cast("string")).alias("session"), (c("event_id") % 50).alias("part"),
                            F.struct(F.concat("event_type", (c("event_id") % 9).cast("string")).alias("path"), F.lit("h").alias("sha256")).alias("e"))
    named.groupBy("session", "part").agg(F.collect_list("e").alias("expected")).select(
        F.to_json(F.struct("session", F.lit("e1").alias("element"), "expected")).alias("value")).write.text(path)
    i.spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return logs.expected_writes(logs.read_tool_states(i.spark, path)).groupBy("session", "path").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- verdicts and gates

VIEWS["v_verdicts"] = """
SELECT 's' || CAST(doc_id % 5 AS STRING) AS session, 'g' || CAST(doc_id % 150 AS STRING) AS "group", 'e' || CAST(doc_id AS STRING) AS element, doc_id AS seq,
  CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict, toxic AS exit_code, 'because ' || CAST(doc_id AS STRING) AS reason FROM labels"""
VIEWS["v_gates"] = """
SELECT session, "group", CAST(max(seq) % 3 AS BIGINT) AS fix_round, CAST(1 AS BIGINT) AS fix_rounds, CAST(max(seq) % 2 AS BIGINT) AS extra_rounds FROM v_verdicts GROUP BY session, "group" """
VIEWS["v_judged"] = """SELECT * FROM v_verdicts WHERE CAST(substr("group", 2) AS INT) % 3 <> 0"""
VIEWS["v_outcomes"] = """
SELECT g.session, g."group", CAST(CASE WHEN coalesce(j.f, 0) > 0 THEN j.f WHEN r.broken THEN coalesce(j.n, 0) ELSE 0 END AS BIGINT) AS failing,
  CASE WHEN NOT (coalesce(j.f, 0) > 0 OR r.broken) THEN 'passed' WHEN g.fix_round < g.fix_rounds + g.extra_rounds THEN 'fix-round' ELSE 'budget-spent' END AS outcome
FROM v_gates g LEFT JOIN (SELECT session, "group", count(*) AS n, count(*) FILTER (WHERE verdict = 'fail') AS f FROM v_judged GROUP BY ALL) j ON j.session = g.session AND j."group" = g."group"
JOIN (SELECT session, "group", bool_or(exit_code <> 0) AS broken FROM v_verdicts GROUP BY ALL) r ON r.session = g.session AND r."group" = g."group" """


def outcomes(i: Inputs):
    return S.gate_outcomes(i.v_judged, i.v_verdicts, i.v_gates)


@query("gate_outcome", 'SELECT session, "group", failing, outcome FROM v_outcomes')
def _(i):
    return outcomes(i)


@query("failing_elements", """
SELECT v.session, v."group", v.element FROM v_judged v JOIN v_outcomes o ON o.session = v.session AND o."group" = v."group" AND o.outcome <> 'passed'
WHERE v.verdict = 'fail' OR NOT EXISTS (SELECT 1 FROM v_judged x WHERE x.session = v.session AND x."group" = v."group" AND x.verdict = 'fail')""")
def _(i):
    return S.failing_elements(i.v_judged, outcomes(i))


@query("gate_summary", """
SELECT r.session, r."group", 'gate · ' || r."group" || ' · ' || r.line || coalesce(' · judge ' || CAST(j.p AS STRING) || '/' || CAST(j.n AS STRING) || ' pass', '') AS line
FROM (SELECT session, "group", string_agg('check ' || element || CASE WHEN exit_code = 0 THEN ' ✓' ELSE ' ✗ (exit ' || CAST(exit_code AS STRING) || ')' END, ' · ' ORDER BY seq) AS line FROM v_verdicts GROUP BY ALL) r
LEFT JOIN (SELECT session, "group", count(*) AS n, count(*) FILTER (WHERE verdict = 'pass') AS p FROM v_judged GROUP BY ALL) j ON j.session = r.session AND j."group" = r."group" """)
def _(i):
    runs = i.v_verdicts.select("session", "group", c("seq").alias("pos"), F.concat(F.lit("check "), "element").alias("command"), "exit_code")
    return S.gate_summaries(runs, i.v_judged)


VIEWS["v_records"] = """
SELECT session, seq, CASE WHEN seq % 4 = 3 THEN 'denial' WHEN seq % 9 = 4 THEN 'override' ELSE 'judge-verdict' END AS kind, 'el' || CAST(seq % 20 AS STRING) AS element, verdict,
  CASE WHEN seq % 3 = 0 THEN 'x is outside element E1' WHEN seq % 3 = 1 THEN 'x changed since element E1 last read it' ELSE 'command refused' END AS reason, 'p' || CAST(seq AS STRING) AS path FROM v_verdicts"""


@query("latest_verdict", """
SELECT session, element, arg_max(verdict, seq) AS verdict, arg_max(reason, seq) AS reason FROM v_records WHERE kind = 'judge-verdict' GROUP BY session, element""")
def _(i):
    return S.latest_verdicts(i.v_records)


@query("denied_scope_paths", """
SELECT session, element, seq, path FROM v_records WHERE kind = 'denial' AND contains(reason, ' is outside element ') AND seq > 30""")
def _(i):
    starts = i.v_records.select("session", "element").distinct().withColumn("start_seq", F.lit(30))
    return S.denied_scope_paths(i.v_records, starts)


@query("read_records", "SELECT session, seq, kind, element, verdict, reason, path FROM v_records ORDER BY session, seq")
def _(i):
    path = scratch_path(i.spark, "records")
    i.v_records.write.json(path)
    return logs.read_records(i.spark, path).select("session", "seq", "kind", "element", "verdict", "reason", "path")


VIEWS["v_named"] = """
SELECT session, 'g' AS "group", element AS id, 'L' || CAST(seq AS STRING) AS label, seq FROM v_verdicts"""
VIEWS["v_answers"] = """
SELECT session, seq AS pos, CASE WHEN seq % 2 = 0 THEN element ELSE 'L' || CAST(seq AS STRING) END AS named, CASE WHEN verdict = 'pass' AND seq % 7 <> 0 THEN 'pass' ELSE 'no' END AS verdict, reason FROM v_verdicts WHERE seq % 5 <> 2
UNION ALL SELECT session, seq + 100000, 'L' || CAST(seq AS STRING), 'pass', 'again' FROM v_verdicts WHERE seq % 11 = 0"""


@query("complete_verdicts", """
SELECT n.session, n.id, CASE WHEN a.verdict = 'pass' THEN 'pass' ELSE 'fail' END AS verdict, coalesce(a.reason, 'the judge gave no verdict for this element') AS reason FROM v_named n
LEFT JOIN (SELECT n.session, n.id, arg_max(a.verdict, a.pos) AS verdict, arg_max(a.reason, a.pos) AS reason FROM v_named n JOIN v_answers a ON a.session = n.session AND (a.named = n.id OR a.named = n.label) GROUP BY ALL) a
  ON a.session = n.session AND a.id = n.id""")
def _(i):
    return S.complete_verdicts(i.v_named, i.v_answers).select("session", "id", "verdict", "reason")


# ---------------------------------------------------------------- forge

VIEWS["v_checks"] = """
SELECT 'c' || CAST(CAST(floor(event_id / 5) AS BIGINT) AS STRING) AS sha, 'k' || CAST(event_id AS STRING) AS name, CASE WHEN event_type = 'signup' THEN 'in_progress' ELSE 'completed' END AS status,
  CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'neutral' WHEN 'purchase' THEN 'failure' WHEN 'error' THEN 'timed_out' END AS conclusion FROM events"""
VIEWS["v_check_states"] = """
SELECT *, CASE WHEN status <> 'completed' THEN 'pending' WHEN conclusion = 'success' THEN 'passed' WHEN conclusion IN ('neutral', 'skipped') THEN 'skipped' ELSE 'failed' END AS state FROM v_checks"""


@query("check_state", "SELECT sha, name, state FROM v_check_states")
def _(i):
    return i.v_checks.select("sha", "name", C.check_state(c("status"), c("conclusion")).alias("state"))


@query("checks_summary", """
SELECT sha, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'pending') THEN 'pending' ELSE 'passed' END AS summary FROM v_check_states GROUP BY sha""")
def _(i):
    return S.checks_summary(i.v_checks.withColumn("state", C.check_state(c("status"), c("conclusion"))))


@query("read_forge_dumps", """
SELECT name, state FROM v_check_states UNION ALL
SELECT 'st' || CAST(event_id AS STRING), CASE event_type WHEN 'view' THEN 'passed' WHEN 'click' THEN 'pending' ELSE 'failed' END FROM events""")
def _(i):
    path = scratch_path(i.spark, "forge")
    run = F.struct("name", "status", "conclusion", F.lit("u").alias("html_url"))
    i.v_checks.groupBy("sha").agg(F.collect_list(run).alias("check_runs")).select("check_runs").write.json(path + "/runs")
    state = F.when(c("event_type") == "view", "success").when(c("event_type") == "click", "pending").otherwise("error")
    status = F.struct(F.concat(F.lit("st"), c("event_id").cast("string")).alias("context"), state.alias("state"), F.lit(None).cast("string").alias("target_url"))
    i.events.groupBy(F.floor(c("event_id") / 10).alias("p")).agg(F.collect_list(status).alias("statuses")).select("statuses").write.json(path + "/statuses")
    runs, statuses = logs.read_check_runs(i.spark, path + "/runs"), logs.read_statuses(i.spark, path + "/statuses")
    return runs.unionByName(statuses).select("name", "state")


VIEWS["v_pulls"] = """
SELECT 'b' || CAST(user_id AS STRING) AS branch, event_id AS "number", event_id AS pos, CASE WHEN event_type = 'signup' THEN 'open' ELSE 'closed' END AS state,
  CASE WHEN event_type = 'click' THEN '2024-01-01' END AS merged_at FROM events"""
VIEWS["v_pull_states"] = """
SELECT branch, "number", pos, CASE WHEN state = 'open' THEN 'open' WHEN merged_at IS NOT NULL THEN 'merged' ELSE 'closed' END AS state FROM v_pulls"""


@query("read_pulls", 'SELECT branch, "number", state FROM v_pull_states')
def _(i):
    path = scratch_path(i.spark, "pulls")
    i.v_pulls.select("number", "state", "merged_at", F.struct(c("branch").alias("ref"), F.lit("s").alias("sha")).alias("head")).write.json(path)
    return logs.read_pulls(i.spark, path).select("branch", "number", "state")


@query("pick_request", """
SELECT branch, "number", state FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY CASE WHEN state = 'open' THEN 0 ELSE 1 END, pos) AS rn FROM v_pull_states) x WHERE rn = 1""")
def _(i):
    pulls = i.v_pulls.withColumn("state", C.request_state(c("state"), c("merged_at")))
    return S.pick_requests(pulls.select("branch", "number", "pos", "state")).drop("pos")


VIEWS["v_reviews"] = """
SELECT user_id % 50 AS pr, event_id AS pos, 'r' || CAST(CAST(floor(value) AS BIGINT) % 7 AS STRING) AS reviewer,
  CASE event_type WHEN 'view' THEN 'COMMENTED' WHEN 'click' THEN 'APPROVED' WHEN 'purchase' THEN 'CHANGES_REQUESTED' WHEN 'signup' THEN 'DISMISSED' ELSE 'PENDING' END AS state FROM events"""
VIEWS["v_requested"] = """SELECT DISTINCT user_id % 50 AS pr, 'r' || CAST(((user_id % 50) * 3) % 7 AS STRING) AS reviewer FROM events"""


@query("fold_reviews", """
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY pr, reviewer ORDER BY pos) AS n FROM v_reviews WHERE state <> 'PENDING'),
fold AS (SELECT pr, reviewer, n, CASE state WHEN 'APPROVED' THEN 'approved' WHEN 'CHANGES_REQUESTED' THEN 'changes-requested' ELSE 'commented' END AS s FROM ranked WHERE n = 1
  UNION ALL SELECT r.pr, r.reviewer, r.n, CASE WHEN r.state = 'DISMISSED' THEN 'commented' WHEN r.state = 'COMMENTED' THEN f.s WHEN r.state = 'APPROVED' THEN 'approved' ELSE 'changes-requested' END
  FROM fold f JOIN ranked r ON r.pr = f.pr AND r.reviewer = f.reviewer AND r.n = f.n + 1),
done AS (SELECT pr, reviewer, arg_max(s, n) AS s FROM fold GROUP BY ALL)
SELECT coalesce(d.pr, q.pr) AS pr, coalesce(d.reviewer, q.reviewer) AS reviewer, CASE WHEN q.pr IS NOT NULL THEN 'requested' ELSE d.s END AS state
FROM done d FULL JOIN v_requested q ON q.pr = d.pr AND q.reviewer = d.reviewer""")
def _(i):
    return S.fold_reviews(i.v_reviews, i.v_requested)


# ---------------------------------------------------------------- threads and transcripts

VIEWS["v_thread"] = """
SELECT 's' || CAST(conv_id AS STRING) AS session, turn AS seq, CASE "role" WHEN 'system' THEN 'tool' WHEN 'user' THEN 'you' ELSE 'agent' END AS author,
  CASE turn % 5 WHEN 1 THEN 'tool-call' WHEN 2 THEN 'tool-result' WHEN 3 THEN 'result' WHEN 4 THEN 'ask' ELSE 'text' END AS kind,
  CASE WHEN turn % 5 = 0 AND conv_id % 2 = 0 THEN 'gate · g' || CAST(turn AS STRING) ELSE text END AS text, conv_id FROM conversations"""
VIEWS["v_gate_thread"] = """SELECT session, seq, CASE WHEN conv_id % 3 = 0 THEN 'tool' ELSE author END AS author, kind, text FROM v_thread"""
VIEWS["v_sessions"] = """
SELECT DISTINCT session, CASE conv_id % 4 WHEN 0 THEN 'asks' WHEN 1 THEN 'deviation' WHEN 2 THEN 'gate-failed' ELSE 'running' END AS state FROM v_thread"""


@query("select_gate_lines", "SELECT session, seq, text FROM v_gate_thread WHERE author = 'tool' AND kind = 'text' AND starts_with(text, 'gate · ')")
def _(i):
    return i.v_gate_thread.filter(C.is_gate_line(c("author"), c("text")) & (c("kind") == "text")).select("session", "seq", "text")


@query("session_report", """
SELECT s.session, s.state, coalesce(g.gates, '') AS gates, CASE WHEN s.state IN ('asks', 'gate-failed') THEN a.q END AS questions, coalesce(CASE WHEN s.state = 'deviation' THEN d.paths END, '') AS denied
FROM v_sessions s LEFT JOIN (SELECT session, string_agg(text, ' / ' ORDER BY seq) AS gates FROM v_gate_thread WHERE author = 'tool' AND kind = 'text' AND starts_with(text, 'gate · ') GROUP BY ALL) g ON g.session = s.session
LEFT JOIN (SELECT session, arg_max(text, seq) AS q FROM v_gate_thread WHERE kind = 'ask' GROUP BY ALL) a ON a.session = s.session
LEFT JOIN (SELECT session, string_agg('p' || CAST(seq AS STRING), ' / ' ORDER BY seq) AS paths FROM v_thread WHERE kind = 'tool-result' GROUP BY ALL) d ON d.session = s.session""")
def _(i):
    denied = i.v_thread.filter(c("kind") == "tool-result").select("session", "seq", F.concat(F.lit("p"), c("seq").cast("string")).alias("path"))
    out = S.session_reports(i.v_sessions, i.v_gate_thread, denied)
    return out.select("session", "state", F.array_join("gates", " / ").alias("gates"), "questions", F.array_join("denied", " / ").alias("denied"))


VIEWS["v_short"] = """
SELECT session, seq, split_part(text, chr(10), 1) AS first_line, text FROM v_thread"""


@query("thread_projection", """
SELECT t.session, t.seq, t.kind, CASE WHEN t.kind = 'text' THEN t.text END AS text,
  CASE t.kind WHEN 'tool-call' THEN 'Edit' WHEN 'tool-result' THEN CASE WHEN EXISTS (SELECT 1 FROM v_thread p WHERE p.session = t.session AND p.kind = 'tool-call' AND p.seq = t.seq - 1) THEN 'Edit' ELSE '' END END AS tool,
  CASE t.kind WHEN 'tool-call' THEN 'src/' || t.session || '.rs' WHEN 'result' THEN t.text
    WHEN 'tool-result' THEN CASE WHEN length(s.first_line) > 160 THEN substr(s.first_line, 1, 160) || '…' ELSE s.first_line END END AS summary
FROM v_thread t JOIN v_short s ON s.session = t.session AND s.seq = t.seq WHERE t.kind <> 'ask'""")
def _(i):
    call = F.concat("session", F.lit("-"), F.when(c("kind") == "tool-result", c("seq") - 1).otherwise(c("seq")).cast("string"))
    events = i.v_thread.select(
        "session", c("seq").alias("pos"), F.when(c("kind") == "ask", "hook").otherwise(c("kind")).alias("kind"), "text", call.alias("tool_use_id"),
        F.lit("Edit").alias("tool"), F.to_json(F.struct(F.concat(F.lit("src/"), "session", F.lit(".rs")).alias("file_path"), "text")).alias("input"),
        F.lit(True).alias("ok"), F.lit("success").alias("subtype"))
    return S.thread_projection(events).select("session", c("pos").alias("seq"), "kind", "text", "tool", "summary")


@query("pair_tool_results", """
SELECT r.session, r.seq, coalesce(c.tool, '') AS tool FROM v_thread r LEFT JOIN (SELECT session, seq, CASE WHEN seq % 2 = 0 THEN 'Read' ELSE 'Bash' END AS tool FROM v_thread WHERE kind = 'tool-call') c
  ON c.session = r.session AND c.seq = r.seq - 1 WHERE r.kind = 'tool-result'""")
def _(i):
    key = lambda n: F.concat(F.lit("t"), n.cast("string")).alias("tool_use_id")
    calls = i.v_thread.filter(c("kind") == "tool-call").select("session", c("seq").alias("pos"), key(c("seq")), F.when(c("seq") % 2 == 0, "Read").otherwise("Bash").alias("tool"))
    results = i.v_thread.filter(c("kind") == "tool-result").select("session", "seq", key(c("seq") - 1))
    return S.pair_tool_results(results, calls).select("session", "seq", "tool")


@query("read_thread", """
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY seq) * 2 - 1 AS BIGINT) AS pos, kind, text FROM v_thread""")
def _(i):
    # Each session's log with a blank line after every entry, so positions are odd.
    path = scratch_path(i.spark, "threads")
    entry = F.to_json(F.struct(c("author").alias("role"), "kind", "text"))
    whole = i.v_thread.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("e")))).alias("l")).select(
        "session", F.array_join(F.transform("l", lambda x: x["e"]), "\n\n").alias("value"))
    whole.write.partitionBy("session").text(path)
    return logs.read_thread(i.spark, path).select("session", "pos", "kind", "text")


def transcript_lines(i: Inputs):
    """A transcript per session: assistant text and tool calls, user tool results, a result line, noise and junk."""
    t = i.v_thread
    block = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    lit = F.lit
    said = F.to_json(F.struct(lit("assistant").alias("type"), c("session").alias("session_id"), F.struct(F.array(
        block(type=lit("text"), text=c("text"), id=lit(None).cast("string"), name=lit(None).cast("string"), input=lit(None).cast("struct<file_path:string>")),
        block(type=lit("thinking"), text=lit("hm"), id=lit(None).cast("string"), name=lit(None).cast("string"), input=lit(None).cast("struct<file_path:string>")),
        block(type=lit("tool_use"), text=lit(None).cast("string"), id=F.concat(lit("t"), c("seq").cast("string")), name=lit("Read"), input=F.struct(lit("a.rs").alias("file_path"))),
    ).alias("content")).alias("message")))
    answered = F.to_json(F.struct(lit("user").alias("type"), F.struct(F.array(F.struct(
        lit("tool_result").alias("type"), F.concat(lit("t"), (c("seq") - 1).cast("string")).alias("tool_use_id"), (c("seq") % 2 == 0).alias("is_error"),
        F.array(F.struct(lit("text").alias("type"), c("text")), F.struct(lit("text").alias("type"), lit("end").alias("text"))).alias("content"))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(lit("user").alias("type"), F.struct(F.array(F.struct(
        lit("tool_result").alias("type"), lit("t0").alias("tool_use_id"), c("text").alias("content"))).alias("content")).alias("message")))
    done = F.to_json(F.struct(lit("result").alias("type"), lit("success").alias("subtype"), (c("conv_id") % 2 == 0).alias("is_error"), c("session").alias("session_id"), c("text").alias("result"),
                              c("seq").alias("num_turns"), (c("seq") / 4).alias("total_cost_usd"), F.array(F.struct(lit("Bash").alias("tool_name")), F.struct(lit("Edit").alias("tool_name"))).alias("permission_denials")))
    odd = F.when(c("conv_id") % 3 == 0, lit("not json {")).when(c("conv_id") % 3 == 1, lit('{"type":"novel"}')).otherwise(lit('{"type":"system","subtype":"progress"}'))
    value = F.when(c("kind") == "text", said).when(c("kind") == "tool-call", answered).when(c("kind") == "tool-result", plain).when(c("kind") == "result", done).otherwise(odd)
    return t.select(c("session").alias("file"), c("seq").alias("pos"), value.alias("value"))


@query("read_transcripts", """
SELECT session AS file, seq AS pos, n.n AS block, CASE WHEN kind = 'text' THEN CASE WHEN n.n = 0 THEN 'text' ELSE 'tool-call' END WHEN kind = 'result' THEN 'result' ELSE 'tool-result' END AS kind,
  CASE WHEN kind = 'text' THEN CASE WHEN n.n = 0 THEN text END WHEN kind = 'tool-call' THEN text || chr(10) || 'end' WHEN kind = 'tool-result' THEN text ELSE CASE WHEN conv_id % 2 <> 0 THEN text END END AS text,
  CASE WHEN kind = 'text' AND n.n = 2 THEN 't' || CAST(seq AS STRING) WHEN kind = 'tool-call' THEN 't' || CAST(seq - 1 AS STRING) WHEN kind = 'tool-result' THEN 't0' END AS tool_use_id,
  CASE WHEN kind = 'tool-call' THEN seq % 2 <> 0 WHEN kind = 'tool-result' THEN true WHEN kind = 'result' THEN conv_id % 2 <> 0 END AS ok
FROM v_thread JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(2 AS BIGINT))) AS n(n) ON n.n = 0 OR kind = 'text' WHERE kind <> 'ask'""")
def _(i):
    path = scratch_path(i.spark, "transcripts")
    # Lines carry their file and position through the text files.
    transcript_lines(i).select(F.concat_ws("\u0001", "file", c("pos").cast("string"), "value").alias("value")).write.text(path)
    raw = F.split("value", "\u0001")
    lines = logs.read_transcripts(i.spark, path).select(
        F.get(raw, F.lit(0)).alias("file"), F.get(raw, F.lit(1)).cast("bigint").alias("pos"), F.get(raw, F.lit(2)).alias("value"))
    return logs.parse_transcript(lines).select("file", "pos", "block", "kind", "text", "tool_use_id", "ok")


@query("stream_stats", """
SELECT session AS file, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE kind = 'ask' AND conv_id % 3 = 0) AS BIGINT) AS skipped,
  CAST(count(*) FILTER (WHERE kind = 'ask' AND conv_id % 3 = 1) AS BIGINT) AS "unknown", CAST(count(*) FILTER (WHERE kind = 'result') AS BIGINT) AS results FROM v_thread GROUP BY session""")
def _(i):
    return logs.stream_stats(transcript_lines(i))


@query("turn_result", """
SELECT session AS file, seq AS pos, conv_id % 2 <> 0 AS ok, 'success' AS subtype, CASE WHEN conv_id % 2 <> 0 THEN text END AS text, seq AS num_turns, CAST(seq AS DOUBLE) / 4 AS cost_usd, 'Bash,Edit' AS denials
FROM v_thread WHERE kind = 'result'""")
def _(i):
    return logs.turn_results(transcript_lines(i)).select("file", "pos", "ok", "subtype", "text", "num_turns", "cost_usd", F.array_join("denials", ",").alias("denials"))


VIEWS["v_elements"] = """
SELECT session, seq AS pos, 'e' || CAST(seq AS STRING) AS id, 'E' || CAST(seq + 1 AS STRING) AS label, text AS intention, 'src/f' || CAST(seq AS STRING) || '.rs' AS site FROM v_thread"""
VIEWS["v_cells"] = """
SELECT e.*, replace(replace(intention, '|', chr(92) || '|'), chr(10), ' ') AS cell FROM v_elements e"""


@query("review_description", """
SELECT session, 0 AS section, CAST(0 AS BIGINT) AS pos, 'plan of ' || session AS line FROM (SELECT DISTINCT session FROM v_thread) s
UNION ALL SELECT session, 1, 0, 'session `' || session || '` · ' || CAST(count(*) AS STRING) || ' element(s)' FROM v_thread GROUP BY session
UNION ALL SELECT e.session, 2, e.pos, '| ' || e.label || ' | ' || e.cell || ' | `' || e.site || '` | `' || e.site || '` `Cargo.toml` | ' || CASE WHEN e.pos % 2 = 0 THEN 'pass · ok ' || CAST(e.pos AS STRING) ELSE '—' END || ' |' FROM v_cells e
UNION ALL SELECT session, 3, seq, '- ' || text FROM v_gate_thread WHERE author = 'tool' AND kind = 'text' AND starts_with(text, 'gate · ')
UNION ALL SELECT session, 4, seq, '- gate accepted as is by ann: late' FROM v_thread WHERE kind = 'ask'""")
def _(i):
    sessions = i.v_thread.select("session").distinct().withColumn("intention", F.concat(F.lit("plan of "), "session"))
    elements = i.v_elements.withColumn("files", F.array("site", F.lit("Cargo.toml")))
    verdicts = i.v_elements.filter(c("pos") % 2 == 0).select("session", c("id").alias("element"), F.lit("pass").alias("verdict"), F.concat(F.lit("ok "), c("pos").cast("string")).alias("reason"))
    gates = i.v_gate_thread.filter(C.is_gate_line(c("author"), c("text")) & (c("kind") == "text"))
    overrides = i.v_thread.filter(c("kind") == "ask").select("session", "seq", F.lit("gate").alias("what"), F.lit("late").alias("reason"), F.lit("ann").alias("by"))
    return S.review_descriptions(sessions, elements, verdicts, gates, overrides)


@query("read_plan_elements", "SELECT session, pos, label, intention, site FROM v_elements")
def _(i):
    path = scratch_path(i.spark, "plans")
    i.v_elements.select("session", "pos", "label", "intention", "site").write.json(path)
    return logs.read_plan_elements(i.spark, path).select("session", "pos", "label", "intention", "site")


@query("archive_session", """
SELECT session, 'turn-' || CAST(seq AS STRING) AS path, CASE WHEN seq = 0 THEN 'replaced' ELSE text END AS content FROM v_thread""")
def _(i):
    files = i.v_thread.select("session", F.concat(F.lit("turn-"), c("seq").cast("string")).alias("path"), c("text").alias("content"))
    path = scratch_path(i.spark, "archive")
    S.archive_sessions(files, path)
    again = scratch_path(i.spark, "archive")
    S.archive_sessions(S.replace_file(S.restore_sessions(i.spark, path), "turn-0", F.lit("replaced")), again)
    return S.restore_sessions(i.spark, again)


@query("append_thread", """
SELECT a.session, CAST(b.last + row_number() OVER (PARTITION BY a.session ORDER BY a.seq) AS BIGINT) AS seq, a.text FROM v_thread a
JOIN (SELECT session, max(seq) AS last FROM v_thread GROUP BY session) b ON b.session = a.session""")
def _(i):
    new = i.v_thread.select("session", c("seq").alias("at"), "text")
    return S.append_after(i.v_thread, new, ["at"], F.floor(c("at") / 4)).select("session", "seq", "text")


@query("read_git_log", r"""
SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS hash, "role" AS author, 'turn ' || CAST(turn AS STRING) AS summary,
  'Reviewed-by=' || "role" || ';Plan-Element=e' || CAST(turn AS STRING) || ';Plan-Element=x: y' AS trailers, 'e' || CAST(turn AS STRING) AS element, 'a.rs,b' || CAST(conv_id AS STRING) || '.rs' AS files FROM conversations""")
def _(i):
    path = scratch_path(i.spark, "gitlog")
    turn, conv = c("turn").cast("string"), c("conv_id").cast("string")
    block = F.concat(F.lit("Reviewed-by: "), "role", F.lit("\nno trailer\n: empty\nPlan-Element:  e"), turn, F.lit("\nPlan-Element: x: y\n"))
    record = F.concat_ws("\u001f", F.concat(F.lit("c"), conv, F.lit("-"), turn), "role", F.concat(F.lit("turn "), turn), block, F.concat(F.lit("\n\na.rs\n b"), conv, F.lit(".rs\n")))
    i.conversations.select(F.concat(F.lit("\u001e"), record).alias("value")).write.text(path)
    pairs = F.array_join(F.transform("trailers", lambda t: F.concat(t["key"], F.lit("="), t["value"])), ";")
    return logs.read_git_log(i.spark, path).select("hash", "author", "summary", pairs.alias("trailers"), "element", F.array_join("files", ",").alias("files"))


# ---------------------------------------------------------------- bursts

QUIET, AGE = 3_600_000_000, 6 * 3_600_000_000
VIEWS["v_bursts"] = f"""
SELECT * FROM (WITH RECURSIVE p AS (SELECT worktree, tm, row_number() OVER (PARTITION BY worktree ORDER BY tm) AS n FROM (SELECT DISTINCT worktree, epoch_us(ts) AS tm FROM v_changes) d),
f AS (SELECT worktree, n, tm, tm AS burst FROM p WHERE n = 1
  UNION ALL SELECT p.worktree, p.n, p.tm, CASE WHEN p.tm - f.tm <= {QUIET} AND p.tm - f.burst <= {AGE} THEN f.burst ELSE p.tm END FROM f JOIN p ON p.worktree = f.worktree AND p.n = f.n + 1)
SELECT worktree, tm, burst FROM f) z"""
VIEWS["v_tagged"] = """SELECT c.*, b.burst FROM v_changes c JOIN v_bursts b ON b.worktree = c.worktree AND b.tm = epoch_us(c.ts)"""


def tagged(i: Inputs):
    return B.tag_bursts(i.v_changes, QUIET, AGE, ["worktree"])


@query("burst_window", """SELECT worktree, burst, CAST(max(epoch_us(ts)) AS BIGINT) AS "last", CAST(count(*) AS BIGINT) AS changes FROM v_tagged GROUP BY worktree, burst""")
def _(i):
    return B.burst_windows(tagged(i), ["worktree"]).withColumn("last", B.micros(c("last")))


@query("burst_window_one_clock", f"""
WITH RECURSIVE p AS (SELECT tm, row_number() OVER (ORDER BY tm) AS n FROM (SELECT DISTINCT epoch_us(ts) AS tm FROM v_changes) d),
f AS (SELECT n, tm, tm AS burst FROM p WHERE n = 1 UNION ALL SELECT p.n, p.tm, CASE WHEN p.tm - f.tm <= {QUIET // 10} AND p.tm - f.burst <= {AGE // 10} THEN f.burst ELSE p.tm END FROM f JOIN p ON p.n = f.n + 1)
SELECT c.worktree, f.burst, CAST(count(DISTINCT c.path) AS BIGINT) AS paths FROM v_changes c JOIN f ON f.tm = epoch_us(c.ts) GROUP BY ALL""")
def _(i):
    # One clock over all worktrees, one batch per worktree; gaps a tenth as long at ten times the rate.
    changes = i.v_changes.withColumn("clock", F.lit("all"))
    one = B.tag_bursts(changes, QUIET // 10, AGE // 10, ["clock"])
    return B.burst_batches(one, ["clock"]).groupBy("worktree", "burst").agg(F.count(F.lit(1)).alias("paths"))


@query("quiet_sessions", f"""
SELECT worktree, CAST(min(tm) AS BIGINT) AS "start", CAST(max(tm) + {QUIET} AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS changes FROM (SELECT *, sum(o) OVER (PARTITION BY worktree ORDER BY tm, seq) AS g FROM (
  SELECT worktree, seq, epoch_us(ts) AS tm, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY worktree ORDER BY ts, seq) <= {QUIET} THEN 0 ELSE 1 END AS o FROM v_changes) x) y GROUP BY worktree, g""")
def _(i):
    return B.quiet_sessions(i.v_changes.withColumn("ts", c("ts").cast("timestamp")), "1 hour", ["worktree"]).select("worktree", B.micros(c("start")).alias("start"), B.micros(c("end")).alias("end"), "changes")


@query("burst_batches", "SELECT DISTINCT worktree, burst, path FROM v_tagged")
def _(i):
    return B.burst_batches(tagged(i), ["worktree"])


@query("batches_by_writer", """
SELECT t.worktree, t.burst, CASE WHEN t.removed THEN 'you' ELSE coalesce(s.session, 'you') END AS writer, CAST(count(DISTINCT t.path) AS BIGINT) AS files, CAST(min(t.seq) AS BIGINT) AS "first" FROM v_tagged t
LEFT JOIN (SELECT worktree, path, sha256, arg_min(session, state_file) AS session FROM v_states GROUP BY ALL) s ON s.worktree = t.worktree AND s.path = t.path AND s.sha256 = t.sha256 GROUP BY ALL""")
def _(i):
    written = S.attribute_writes(tagged(i), i.v_states).withColumn("pos", c("seq"))
    return B.batches_by_writer(written, ["worktree", "burst"])


VIEWS["v_listing"] = """SELECT DISTINCT worktree, path, 'now' AS sha256 FROM v_changes WHERE length(path) % 3 <> 0"""
VIEWS["v_notices"] = """SELECT DISTINCT CASE WHEN worktree <> 'w3' THEN worktree END AS worktree FROM v_changes WHERE worktree IN ('w1', 'w2')"""


@query("rescan", """
SELECT worktree, path FROM v_changes UNION SELECT worktree, path FROM v_listing l WHERE worktree IN (SELECT worktree FROM v_notices) OR EXISTS (SELECT 1 FROM v_notices WHERE worktree IS NULL)""")
def _(i):
    return B.rescan(i.v_changes, i.v_notices, i.v_listing)


@query("removed_or_changed", """
SELECT t.worktree, t.burst, t.path, l.path IS NULL AS removed FROM (SELECT DISTINCT worktree, burst, path FROM v_tagged) t LEFT JOIN v_listing l ON l.worktree = t.worktree AND l.path = t.path""")
def _(i):
    return B.removed_or_changed(B.burst_batches(tagged(i), ["worktree"]), i.v_listing).drop("sha256")


VIEWS["v_roots"] = """
SELECT DISTINCT event_type AS root FROM events UNION SELECT DISTINCT event_type || '/' || CAST(CAST(floor(value) AS BIGINT) % 40 AS STRING) FROM events WHERE user_id % 2 = 0 UNION SELECT ''"""


@query("innermost_root", """
SELECT p.path, (SELECT arg_max(r.root, length(r.root)) FROM v_roots r WHERE r.root = '' OR p.path = r.root OR starts_with(p.path, r.root || '/')) AS root
FROM (SELECT DISTINCT event_type || '/' || CAST(CAST(floor(value) AS BIGINT) % 60 AS STRING) || '/x.rs' AS path FROM events) p""")
def _(i):
    from factloom.operators.placement import innermost

    files = i.events.select(F.lit("r").alias("repo"), F.concat("event_type", F.lit("/"), (F.floor("value") % 60).cast("string"), F.lit("/x.rs")).alias("path"))
    roots = i.v_roots.select(F.lit("r").alias("repo"), c("root").alias("dir"))
    return innermost(files, roots, ["repo"]).select("path", c("dir").alias("root"))


@query("package_of_file", """
SELECT d.repo, d.path, CASE WHEN d.doc_id % 5 = 0 THEN 'x' || d.lang || ',' || 'y' || d.source WHEN d.lang = 'en' THEN d.source || '-en' WHEN substr(d.source, 4) IN ('1', '2', '3') THEN d.source ELSE 'unit' END AS package FROM v_docs d""")
def _(i):
    from factloom.operators.placement import package_of_file

    docs = i.v_docs
    owned = docs.filter(c("doc_id") % 5 == 0)
    owners = owned.select("repo", "path", F.lit(1).alias("pos"), F.concat(F.lit("x"), "lang").alias("package")).unionByName(
        owned.select("repo", "path", F.lit(2).alias("pos"), F.concat(F.lit("y"), "source").alias("package")))
    packages = docs.select("repo", F.concat(F.lit("src/"), "source", F.lit("/en")).alias("dir"), F.concat("source", F.lit("-en")).alias("package")).unionByName(
        docs.filter(c("source").isin("src1", "src2", "src3")).select("repo", F.concat(F.lit("src/"), "source").alias("dir"), c("source").alias("package"))).distinct()
    return package_of_file(docs, owners, packages, ["repo"])


# ---------------------------------------------------------------- lifecycles

TRIGGER_CASE = "CASE event_id % 18 " + " ".join(f"WHEN {n} THEN '{t}'" for n, (_, t, _x) in enumerate(fixed.TRANSITIONS)) + " END"
STATE_CASE = "CASE (event_id * 7) % 11 " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(fixed.SESSION_STATES)) + " END"
VIEWS["v_triggers"] = f"""
SELECT 'u' || CAST(user_id AS STRING) AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, {TRIGGER_CASE} AS "trigger", {STATE_CASE} AS state, ts FROM events"""
EDGES = "(VALUES " + ", ".join(f"('{a}', '{t}', '{b}')" for a, t, b in fixed.TRANSITIONS) + ") AS e(state, trg, nxt)"


@query("session_lifecycle", f"""
WITH RECURSIVE e AS (SELECT * FROM {EDGES}),
f AS (SELECT t.session, t.seq, coalesce(e.nxt, 'planning') AS state, CASE WHEN e.nxt IS NULL THEN 1 ELSE 0 END AS illegal FROM v_triggers t LEFT JOIN e ON e.state = 'planning' AND e.trg = t."trigger" WHERE t.seq = 1
  UNION ALL SELECT t.session, t.seq, coalesce(e.nxt, f.state), f.illegal + CASE WHEN e.nxt IS NULL THEN 1 ELSE 0 END FROM f JOIN v_triggers t ON t.session = f.session AND t.seq = f.seq + 1 LEFT JOIN e ON e.state = f.state AND e.trg = t."trigger")
SELECT session, arg_max(state, seq) AS state, CAST(max(illegal) AS BIGINT) AS illegal FROM f GROUP BY session""")
def _(i):
    return S.replay_lifecycles(i.v_triggers)


@query("illegal_transitions", f"""
SELECT session, seq, state, "trigger" FROM v_triggers t WHERE NOT EXISTS (SELECT 1 FROM {EDGES} WHERE e.state = t.state AND e.trg = t."trigger")""")
def _(i):
    return S.illegal_transitions(i.v_triggers).select("session", "seq", "state", "trigger")
