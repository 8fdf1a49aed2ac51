"""Readers of threads, transcripts, records, git logs, forge dumps, plans and tool states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import columns as C
from factloom.operators.ordered import numbered

c = F.col


def numbered_lines(spark: SparkSession, path: str, session: str = r"session=([^/]*)/") -> DataFrame:
    """(session, line, value): the lines of one log file per session, counted from 1; ``session`` finds it in the path.

    Large files are read in blocks. A line's place is its block and its order in the block's task, and the numbers come
    from the counts of the blocks before, so no file is held whole.
    """
    lines = spark.read.format("text").option("recursiveFileLookup", True).load(path).select(
        F.regexp_extract("_metadata.file_path", session, 1).alias("session"), c("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    return numbered(lines, ["session"], ["block", "at"], c("block"), "line").select("session", "line", "value")


def read_thread(spark: SparkSession, path: str) -> DataFrame:
    """Thread entries of ``<path>/session=<id>/`` logs: (session, pos, kind, …); blank lines are skipped, a line that is no
    entry fails the read and names its number."""
    return parse_thread(numbered_lines(spark, path))


def parse_thread(lines: DataFrame) -> DataFrame:
    """Thread entries of numbered lines (session, line, value)."""
    parsed = F.from_json("value", schemas.THREAD, {"mode": "PERMISSIVE"})
    rows = lines.filter(F.trim("value") != "").withColumn("_e", parsed)
    wrong = F.raise_error(F.concat(F.lit("line "), c("line").cast("string"), F.lit(" is no thread entry")))
    checked = F.when(c("_e.kind").isNotNull(), c("line")).otherwise(wrong.cast("bigint"))
    return rows.select("session", checked.alias("pos"), "_e.*")


def parse_transcript(lines: DataFrame) -> DataFrame:
    """Turn events of transcript lines (file, pos, value): one line gives none to several events.

    (file, pos, block, kind, session_id, text, tool_use_id, tool, input, ok, subagent, subtype, …). Lines that are no JSON
    object and types not read give no event.
    """
    line = _decoded(lines)
    at = lambda p: F.coalesce(F.get_json_object("value", f"$.{p}"), F.lit(""))
    base = ["file", "pos"]
    none = F.lit(None).cast("string")
    kind = (
        F.when((c("type") == "system") & (c("subtype") == "init"), "started")
        .when((c("type") == "system") & (c("subtype") == "task_started"), "subagent")
        .when((c("type") == "system") & (c("subtype") == "hook_response"), "hook")
        .when(c("type") == "result", "result")
    )
    text = F.when(kind == "subagent", at("description")).when(kind == "hook", at("output")).when(
        (kind == "result") & (F.coalesce(F.get_json_object("value", "$.is_error"), F.lit("true")) == "false"), F.get_json_object("value", "$.result"))
    whole = line.withColumn("_k", kind).filter(c("_k").isNotNull()).select(
        *base, F.lit(0).cast("bigint").alias("block"), c("_k").alias("kind"), at("session_id").alias("session_id"), text.alias("text"),
        F.when(c("_k") == "subagent", at("tool_use_id")).alias("tool_use_id"), none.alias("tool"), none.alias("input"),
        F.when(c("_k") == "result", F.coalesce(F.get_json_object("value", "$.is_error"), F.lit("true")) == "false").alias("ok"),
        none.alias("subagent"), "subtype",
    )
    blocks = F.from_json(F.get_json_object("value", "$.message.content"), "array<string>")
    inner = line.filter(c("type").isin("assistant", "user")).select(
        *base, c("type"), at("session_id").alias("session_id"), F.get_json_object("value", "$.parent_tool_use_id").alias("subagent"),
        F.posexplode(blocks).alias("block", "b"))
    of = lambda p: F.get_json_object("b", f"$.{p}")
    part = of("type")
    said = (
        F.when((c("type") == "assistant") & (part == "text"), "text").when((c("type") == "assistant") & (part == "tool_use"), "tool-call")
        .when((c("type") == "user") & (part == "tool_result"), "tool-result")
    )
    # A tool result's content is text or an array of parts; text is quoted again so that both read as JSON.
    content = of("content")
    parts = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    is_list = F.coalesce(F.substring(F.ltrim(content), 1, 1) == "[", F.lit(False)) & parts.isNotNull()
    result_text = F.when(is_list, joined).otherwise(F.coalesce(content, F.lit("")))
    empty = F.lit("")
    within = inner.withColumn("_k", said).filter(c("_k").isNotNull()).select(
        *base, c("block").cast("bigint").alias("block"), c("_k").alias("kind"), "session_id",
        F.when(c("_k") == "text", F.coalesce(of("text"), empty)).when(c("_k") == "tool-result", result_text).alias("text"),
        F.when(c("_k") == "tool-call", F.coalesce(of("id"), empty)).when(c("_k") == "tool-result", F.coalesce(of("tool_use_id"), empty)).alias("tool_use_id"),
        F.when(c("_k") == "tool-call", F.coalesce(of("name"), empty)).alias("tool"), F.when(c("_k") == "tool-call", of("input")).alias("input"),
        F.when(c("_k") == "tool-result", F.coalesce(of("is_error"), F.lit("false")) != "true").alias("ok"), "subagent", none.alias("subtype"),
    )
    return whole.unionByName(within)


def _decoded(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, with type and subtype."""
    text = F.trim("value")
    known = lines.filter(_is_object(text))
    at = lambda p: F.coalesce(F.get_json_object("value", f"$.{p}"), F.lit(""))
    return known.withColumn("type", at("type")).withColumn("subtype", at("subtype"))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


QUIET_TYPES = ["system", "rate_limit_event", "stream_event", "assistant", "user", "result"]


def stream_stats(lines: DataFrame, keys=("file",)) -> DataFrame:
    """(keys, lines, skipped, unknown, results) of transcript lines; blank lines do not count."""
    text = F.trim("value")
    is_object = _is_object(text)
    kind = F.coalesce(F.get_json_object("value", "$.type"), F.lit(""))
    return lines.filter(text != "").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~is_object).alias("skipped"),
        F.count_if(is_object & ~kind.isin(QUIET_TYPES)).alias("unknown"), F.count_if(is_object & (kind == "result")).alias("results"))


def turn_results(lines: DataFrame) -> DataFrame:
    """(file, pos, session_id, ok, subtype, text, structured, num_turns, cost_usd, denials) of each result line."""
    at = lambda p: F.get_json_object("value", f"$.{p}")
    ok = F.coalesce(at("is_error"), F.lit("true")) == "false"
    denials = F.from_json(at("permission_denials"), "array<struct<tool_name:string>>")
    return _decoded(lines).filter(c("type") == "result").select(
        "file", "pos", F.coalesce(at("session_id"), F.lit("")).alias("session_id"), ok.alias("ok"), "subtype",
        F.when(ok, at("result")).alias("text"), at("structured_output").alias("structured"),
        F.coalesce(at("num_turns").cast("bigint"), F.lit(0)).alias("num_turns"), at("total_cost_usd").cast("double").alias("cost_usd"),
        F.coalesce(F.transform(denials, lambda d: F.coalesce(d["tool_name"], F.lit(""))), F.array().cast("array<string>")).alias("denials"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines with their file: (file, value), for :func:`parse_transcript` once they carry a position."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Session records as JSON lines, in order of session and seq; a bad line fails."""
    return spark.read.schema(schemas.RECORD).option("mode", "FAILFAST").json(path).orderBy("session", "seq")


def read_git_log(spark: SparkSession, path: str, element_suffix: str = "-Element") -> DataFrame:
    """Commits of log dumps with records between 0x1E and fields between 0x1F.

    (hash, author, summary, trailers, files, element); records with fewer than five fields are left out.
    """
    records = spark.read.option("lineSep", "\x1e").text(path)
    f = F.split("value", "\x1f")
    trailers = C.commit_trailers(F.get(f, F.lit(3)))
    files = F.filter(F.transform(F.split(F.get(f, F.lit(4)), "\n"), lambda l: F.trim(l)), lambda l: l != "")
    clean = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return records.filter(F.size(f) >= 5).select(
        clean(F.get(f, F.lit(0))).alias("hash"), F.get(f, F.lit(1)).alias("author"), F.get(f, F.lit(2)).alias("summary"),
        trailers.alias("trailers"), files.alias("files"), C.element_trailer(trailers, element_suffix).alias("element"))


def read_pulls(spark: SparkSession, path: str) -> DataFrame:
    """Requests of forge pages, with their state."""
    pulls = spark.read.schema(schemas.PULL).option("mode", "FAILFAST").json(path)
    return pulls.select(
        "number", c("html_url").alias("url"), "title", C.request_state(c("state"), c("merged_at")).alias("state"), "draft",
        c("head.ref").alias("branch"), c("head.sha").alias("sha"))


def read_check_runs(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, state) of check runs, one page of runs per line."""
    pages = spark.read.schema(schemas.CHECK_RUNS).option("mode", "FAILFAST").json(path)
    return pages.select(F.inline("check_runs")).select(
        "name", c("html_url").alias("url"), C.check_state(c("status"), c("conclusion")).alias("state"))


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    """The same of commit statuses."""
    pages = spark.read.schema(schemas.STATUSES).option("mode", "FAILFAST").json(path)
    return pages.select(F.inline("statuses")).select(
        c("context").alias("name"), c("target_url").alias("url"), C.status_state(c("state")).alias("state"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(reviewer, state) of review pages; reviews of deleted users are left out."""
    return spark.read.schema(schemas.REVIEW).json(path).filter(c("user").isNotNull()).select(c("user.login").alias("reviewer"), "state")


def read_plan_elements(spark: SparkSession, path: str) -> DataFrame:
    """Planned elements; lines that do not fit fail, and so does an empty list."""
    rows = spark.read.schema(schemas.PLAN_ELEMENT).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError("a plan needs at least one element")
    return rows


def read_tool_states(spark: SparkSession, path: str) -> DataFrame:
    """Tool-layer states with the file they come from; an unreadable line claims nothing."""
    return (
        spark.read.schema(schemas.TOOL_STATE).option("mode", "DROPMALFORMED").json(path)
        .withColumn("state_file", F.input_file_name())
    )


def expected_writes(states: DataFrame) -> DataFrame:
    return states.select("session", "element", "state_file", F.inline("expected"))


def read_policy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A policy table (areas, rules, lints or allows) as JSON lines with its order column."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
