"""Both dialects as one table of records: a row per line with what it says and does.

Columns: source, path, session_ord, mtime, line; sid and cwd_set (what the line sets), ts (its raw time), user_text,
agent (the agent has spoken here), step (an agent step), step_text; calls and results, in block order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import catalog
from tracemill.config import Settings
from tracemill.functions import text as tx
from tracemill.functions.patterns import matches
from tracemill.sources import shared

KEYS = ["source", "path", "session_ord", "mtime", "line"]
CALLS = "array<struct<pos:int,call_id:string,tool:string,command:string,skill:string,mode:string>>"
RESULTS = "array<struct<pos:int,call_id:string,output:string,flag:boolean>>"


def _text(value: Column) -> Column:
    return F.coalesce(tx.text_of(value), F.lit(""))


def _plain(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _flag(value: Column) -> Column:
    """True and false only as booleans: a string that reads so is no flag."""
    return F.when(tx.is_kind(value, "BOOLEAN"), F.try_variant_get(value, "$", "boolean"))


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _own_id(value: Column, pos: Column) -> Column:
    """A call without an id gets one that no result names."""
    return F.coalesce(tx.text_of(value), F.concat_ws(":", F.col("path"), F.col("line").cast("string"), pos.cast("string"), F.lit("call")))


def claude(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    base = records.select(*KEYS, tx.text_of(tx.field(rec, "sessionId")).alias("sid"), tx.text_of(tx.field(rec, "cwd")).alias("cwd_set"), tx.text_of(tx.field(rec, "timestamp")).alias("ts"), tx.field(rec, "message").alias("message"), _plain(tx.field(rec, "type")).alias("kind"))
    base = base.withColumn("role", F.coalesce(tx.text_of(tx.field(F.col("message"), "role")), "kind")).withColumn("content", tx.field(F.col("message"), "content"))
    blocks = F.transform(F.coalesce(tx.items(F.col("content")), F.array().cast("array<variant>")), lambda b, n: _struct(pos=n, block=b))
    base = base.withColumn("blocks", blocks)
    of_kind = lambda kind: F.filter("blocks", lambda b: F.coalesce(_plain(tx.field(b["block"], "type")) == kind, F.lit(False)))

    def call(b: Column) -> Column:
        given, tool = tx.field(b["block"], "input"), _text(tx.field(b["block"], "name"))
        return _struct(pos=b["pos"], call_id=_own_id(tx.field(b["block"], "id"), b["pos"]), tool=tool, command=_text(tx.field(given, "command")), skill=_text(tx.field(given, "skill")), mode=F.when(tool == "Bash", "shell").otherwise("none"))

    def result(b: Column) -> Column:
        return _struct(pos=b["pos"], call_id=_text(tx.field(b["block"], "tool_use_id")), output=tx.result_text(tx.field(b["block"], "content")), flag=_flag(tx.field(b["block"], "is_error")))

    said = tx.message_text(F.col("content"))
    speaks = F.coalesce(F.col("role") == "assistant", F.lit(False))
    has_content = F.col("content").isNotNull() & F.coalesce(F.size("blocks") > 0, F.lit(False)) | (_text(F.col("content")) != "")
    return base.select(
        *KEYS, "sid", "cwd_set", "ts",
        F.when(F.col("role") == "user", said).otherwise("").alias("user_text"),
        speaks.alias("agent"), (speaks & has_content).alias("step"), F.when(speaks, said).otherwise("").alias("step_text"),
        F.transform(of_kind("tool_use"), call).cast(CALLS).alias("calls"), F.transform(of_kind("tool_result"), result).cast(RESULTS).alias("results"),
    )


def codex(records: DataFrame) -> DataFrame:
    rec = F.col("rec")
    base = records.select(*KEYS, _plain(tx.field(rec, "type")).alias("envelope"), tx.field(rec, "payload").alias("payload"), tx.field(rec, "timestamp").alias("stamp"))
    payload = F.col("payload")
    part = lambda name: tx.field(payload, name)
    meta = F.coalesce(F.col("envelope") == "session_meta", F.lit(False))
    kind, role = _plain(part("type")), _plain(part("role"))
    base = base.withColumns({"meta": meta, "kind": kind, "role": role})
    is_kind = lambda *names: F.coalesce(F.col("kind").isin(*names), F.lit(False)) & ~F.col("meta")
    by_agent = F.coalesce(F.col("role") == "assistant", F.lit(False)) & ~F.col("meta")
    said = tx.payload_text(payload)
    from_user = is_kind("user_message") | (is_kind("message") & (F.col("role").isNull() | (F.col("role") == "user")))
    arguments = tx.object_of(part("arguments"))
    command = F.when(is_kind("custom_tool_call"), _text(part("input"))).otherwise(F.coalesce(tx.text_of(tx.field(arguments, "cmd")), tx.text_of(tx.field(arguments, "command")), F.lit("")))
    zero = F.lit(0)
    call = _struct(pos=zero, call_id=_own_id(part("call_id"), zero), tool=_text(part("name")), command=command, skill=F.lit(""), mode=F.when(is_kind("custom_tool_call"), "program").otherwise("shell"))
    result = _struct(pos=zero, call_id=_text(part("call_id")), output=tx.output_text(part("output")), flag=_flag(part("is_error")))
    own_id, own_cwd = tx.text_of(part("id")), tx.text_of(part("cwd"))
    message, speaks = is_kind("agent_message"), is_kind("message") & by_agent
    acts = is_kind("function_call", "custom_tool_call")
    return base.select(
        *KEYS, F.when(F.col("meta"), own_id).alias("sid"), F.when(F.coalesce(F.col("envelope").isin("session_meta", "turn_context"), F.lit(False)), own_cwd).alias("cwd_set"),
        F.coalesce(tx.text_of(F.col("stamp")), tx.text_of(part("timestamp"))).alias("ts"),
        F.when(from_user, said).otherwise("").alias("user_text"),
        (by_agent | is_kind("agent_message", "assistant_message", "custom_tool_call", "function_call", "reasoning")).alias("agent"),
        (message | speaks | acts).alias("step"), F.when(message, _text(part("message"))).when(speaks, said).otherwise("").alias("step_text"),
        F.when(acts, F.array(call)).otherwise(F.array()).cast(CALLS).alias("calls"),
        F.when(is_kind("function_call_output", "custom_tool_call_output"), F.array(result)).otherwise(F.array()).cast(RESULTS).alias("results"),
    )


def normalized(records: DataFrame) -> DataFrame:
    return claude(records.where("source = 'claude'")).unionByName(codex(records.where("source = 'codex'")))


#: Lines of one stretch of a file: windows run within a stretch, and stretches are joined by what each one hands on.
STRETCH = 1 << 15


def marked(rows: DataFrame, settings: Settings) -> DataFrame:
    """Whether a line holds something that a user typed, and what its agent step says, if it is one: (line, seen)."""
    scaffold = tx.is_scaffold(F.col("user_text"), F.col("path"), settings)
    step = F.when(F.col("step"), F.struct("line", matches(F.col("step_text"), catalog.EMPTY_SEEN).alias("seen")))
    return rows.withColumns({"typed": (F.col("user_text") != "") & ~scaffold, "own_step": step}).drop("step", "step_text")


def stem(path: Column) -> Column:
    """The name of a file without its ending: a session's id until a line names another."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _handed_on(rows: DataFrame) -> DataFrame:
    """For each stretch of each file what comes in from the stretches around it, and what holds for the whole file.

    A stretch is summed up in one row first, so what a file's windows run over is a row for each ``STRETCH`` lines.
    """
    said = lambda name: F.col(name).isNotNull()
    last = lambda name: F.max_by(name, F.when(said(name), F.col("line"))).alias(name)
    first = lambda name: F.min_by(name, F.when(said(name), F.col("line")))
    sums = rows.groupBy("path", "stretch").agg(last("sid"), last("cwd_set"), last("ts"), first("ts").alias("first_ts"), F.max("agent").alias("agent"), F.max("typed").alias("typed"), first("own_step").alias("own_step"))
    along = W.partitionBy("path").orderBy("stretch")
    whole, before = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), along.rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("path").orderBy(F.col("stretch").desc()).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        "path", "stretch", F.last("sid", True).over(before).alias("sid_in"), F.coalesce(F.max("agent").over(before), F.lit(False)).alias("agent_in"),
        F.coalesce(F.max("typed").over(before), F.lit(False)).alias("typed_in"), F.last("own_step", True).over(after).alias("step_in"),
        F.coalesce(F.last("sid", True).over(whole), stem(F.col("path"))).alias("last_session_id"), F.coalesce(F.last("cwd_set", True).over(whole), F.lit("")).alias("cwd"),
        F.coalesce(F.first("first_ts", True).over(whole), F.lit("")).alias("started_at"), F.coalesce(F.last("ts", True).over(whole), F.lit("")).alias("ended_at"),
    )


def _said_again(rows: DataFrame) -> DataFrame:
    """Lines of each stretch whose words a user typed before in the same file."""
    texts = rows.where("user_text <> ''").select("path", "stretch", "line", "typed", F.sha2("user_text", 256).alias("words"))
    firsts = texts.where("typed").groupBy("path", "words").agg(F.min("line").alias("first_line"))
    again = texts.join(firsts, ["path", "words"]).where("line > first_line")
    return again.groupBy("path", "stretch").agg(F.collect_list("line").alias("again"))  # at most STRETCH lines


def with_context(rows: DataFrame, settings: Settings, stretch: int = STRETCH) -> DataFrame:
    """What holds at each line: session and directory so far, earlier user texts, the next agent step.

    A file of any length is cut into stretches of lines, each windowed on its own; running values are carried over from
    stretch to stretch (a prefix scan), so the lines of one file spread over as many tasks as it has stretches.
    """
    rows = shared.keep(marked(rows, settings).withColumn("stretch", F.floor((F.col("line") - 1) / stretch).cast("int")), "records")
    carried = _handed_on(rows).join(_said_again(rows), ["path", "stretch"], "left")
    within = W.partitionBy("path", "stretch").orderBy("line")
    so_far, before = within.rowsBetween(W.unboundedPreceding, 0), within.rowsBetween(W.unboundedPreceding, -1)
    from_the_end = W.partitionBy("path", "stretch").orderBy(F.col("line").desc()).rowsBetween(W.unboundedPreceding, -1)  # a running frame
    rows = rows.withColumns({
        "sid_here": F.last("sid", True).over(so_far),
        "agent_here": F.coalesce(F.max("agent").over(so_far), F.lit(False)),
        "typed_here": F.coalesce(F.max("typed").over(before), F.lit(False)),
        "step_here": F.last("own_step", True).over(from_the_end),
    })
    rows = rows.join(carried, ["path", "stretch"])
    rows = rows.withColumns({"session_id": F.coalesce("sid_here", "sid_in", stem(F.col("path"))), "next_step": F.coalesce("step_here", "step_in")})
    eligible = F.expr("user_text <> '' AND (agent_here OR agent_in) AND (typed_here OR typed_in) AND NOT coalesce(array_contains(again, line), false)")
    correction = eligible & tx.is_correction(F.col("user_text"), F.col("path"), settings)
    return rows.withColumn("correction", correction).drop("stretch", "sid", "cwd_set", "agent", "typed", "own_step", "sid_here", "agent_here", "typed_here", "step_here", "sid_in", "agent_in", "typed_in", "step_in", "again")
