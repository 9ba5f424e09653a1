"""Evidence: one long table of what the detectors see.

Each row names a list (cli, skill, slash, failure, empty, correction, call) and, for the first three, an entity. Rows of
one record leave a single pass over it; ``session_ord, phase, line, sub, pos, cli_pos`` is the order in which a reader of the
files would have met them, which later decides what is kept and how proposals are keyed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import catalog
from tracemill.config import Settings
from tracemill.functions import text as tx
from tracemill.functions.patterns import java, matches
from tracemill.functions.shell import call_facts

ORDER = ["session_ord", "phase", "line", "sub", "pos", "cli_pos"]
FIELDS = ["source", "path", "line", "session_id", "kind", "tool_name", "command", "occurred_at", "excerpt"]
ITEM = "struct<sub:int,pos:int,call_id:string,is_call:boolean,tool:string,command:string,skill:string,mode:string,output:string,flag:boolean,text:string>"
CALL = "struct<tool:string,command:string,clis:array<string>,sole:string,wants:boolean>"
FOUND = "array<struct<list:string,entity:string,kind:string,text:string,tool_name:string,command:string,session:string,phase:int,sub:int,pos:int,cli_pos:int>>"
#: What ends a line of a tool's output.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def item(sub, pos, **given) -> Column:
    """A call, a result or a text; what isn't given is empty."""
    fields = [p.split(":") for p in ITEM[7:-1].split(",")]
    values = {"sub": sub, "pos": pos} | given
    lit = lambda v, kind: v if isinstance(v, Column) else F.lit(v if v is not None else "" if kind == "string" else None)
    return F.struct(*(lit(values.get(n), kind).alias(n) for n, kind in fields)).cast(ITEM)


def call_items() -> Column:
    return F.transform("calls", lambda c: item(2, c["pos"], call_id=c["call_id"], is_call=True, tool=c["tool"], command=c["command"], skill=c["skill"], mode=c["mode"]))


def result_items() -> Column:
    return F.transform("results", lambda r: item(2, r["pos"], call_id=r["call_id"], is_call=False, output=r["output"], flag=r["flag"]))


def text_items(text: Column) -> Column:
    return F.when(text != "", F.array(item(0, 0, text=text))).otherwise(F.array().cast(f"array<{ITEM}>"))


def items_of(rows: DataFrame) -> DataFrame:
    """Calls, results and user texts as rows of their own, in the order of their record."""
    keep = ["source", "path", "session_ord", "mtime", "line", "ts", "session_id", "last_session_id", "next_step", "correction", "cwd", "started_at", "ended_at"]
    return rows.select(*keep, F.explode(F.concat(text_items(F.col("user_text")), call_items(), result_items())).alias("item")).select(*keep, "item.*")


def with_calls(items: DataFrame, settings: Settings) -> DataFrame:
    """Each result with the latest earlier call of its id; results of no call go."""
    facts = items.withColumn("facts", call_facts(settings, F.coalesce("tool", F.lit("")), F.when(F.col("is_call"), F.col("mode")).otherwise("none"), F.when(F.col("is_call"), F.col("command")).otherwise("")))
    call = F.when(F.col("is_call"), F.struct("tool", "command", F.col("facts.clis").alias("clis"), F.col("facts.sole").alias("sole"), F.col("facts.wants").alias("wants")).cast(CALL))
    alone = F.when(F.col("call_id") == "", F.struct("line", "sub", "pos"))  # what names no call stays where it is
    earlier = W.partitionBy("path", "call_id", alone).orderBy("line", "sub", "pos").rowsBetween(W.unboundedPreceding, 0)
    bound = facts.withColumn("call", F.last(call, True).over(earlier))
    return bound.where((F.col("text") != "") | F.col("call").isNotNull()).drop("facts", "tool", "command", "mode")


def _blamed(output: Column, clis: Column, source: Column) -> Column:
    """Of several tracked names those near whose mention the output shows friction.

    When that blames nobody, one dialect's calls blame all of them and the other's none.
    """
    lines = F.split(output, LINE_ENDS)
    spots = F.sequence(F.lit(0), F.size(lines) - 1)

    def friction(n: Column) -> Column:
        near = F.array_join(F.slice(lines, F.greatest(n, F.lit(1)), F.when(n > 0, 4).otherwise(3)), "\n")
        return matches(near, catalog.BAD_EXIT) | matches(near, catalog.CLI_FRICTION)

    found = F.filter(clis, lambda c: F.exists(spots, lambda n: F.get(lines, n).contains(c) & friction(n)))
    return F.when(F.size(clis) <= 1, clis).when((F.size(found) == 0) & (source == "claude"), clis).otherwise(found)


def evidence(rows: DataFrame, settings: Settings) -> DataFrame:
    """The evidence table of normalized records with their context."""
    return found_in(with_calls(items_of(rows), settings), settings)


def found_in(items: DataFrame, settings: Settings, more: tuple[str, ...] = ()) -> DataFrame:
    """The evidence of items that know their call and their context, each by itself; with more columns of the items."""
    call, clis = F.col("call"), F.col("call.clis")
    is_call, output, tool = F.coalesce(F.col("is_call"), F.lit(False)), F.col("output"), F.col("call.tool")
    # one layer of columns at a time, so that no expression is spelled out more than once
    items = items.withColumns({"is_result": (F.col("text") == "") & ~is_call, "bad": matches(output, catalog.BAD_EXIT), "good": matches(output, catalog.GOOD_EXIT), "stalled": matches(output, catalog.HANG_WORDS), "worded": matches(output, catalog.FAILURE_WORDS)})
    items = items.withColumn("bash", (F.col("source") != "claude") | (tool == "Bash"))
    judged = F.when(F.col("flag").isNotNull(), F.col("flag")).when(output == "", False).when((F.size(clis) > 0) | tool.startswith("mcp__") | F.col("bad"), F.col("bad")).otherwise(~F.col("good") & F.col("worded"))
    items = items.withColumn("failed", F.col("is_result") & (output != "") & judged)
    inspected = matches(F.col("call.command"), catalog.INSPECTION) & ~matches(output, catalog.STRONG_FRICTION)
    items = items.withColumn("hung", F.expr("is_result AND NOT failed AND output <> '' AND bash AND stalled AND NOT good") & ~matches(output, catalog.COMPLETED) & ~inspected)
    swallowed = F.col("next_step").isNotNull() & ~F.coalesce(F.col("next_step.seen"), F.lit(False))
    quiet = F.expr("is_result AND NOT bad AND NOT worded AND NOT stalled") & F.lit(settings.detect_empty) & ~F.coalesce(F.col("flag"), F.lit(False)) & (F.size(clis) <= 1) & F.col("call.wants") & swallowed
    items = items.withColumn("quiet", quiet).withColumn("payload", F.when(F.col("quiet"), tx.empty_payload(output)))
    items = items.withColumn("blamed", F.when(F.col("failed") & F.col("bash"), _blamed(output, clis, F.col("source"))).otherwise(F.array().cast("array<string>")))

    # words are masked once an item, however many rows they come to stand in, and by one expression for all of them
    slashes = F.when(F.col("text") != "", F.regexp_extract_all("text", F.lit(java(catalog.SLASH_COMMAND)), F.lit(1))).otherwise(F.array().cast("array<string>"))
    skilled = is_call & (tool == "Skill") & (F.col("skill") != "") & (F.col("source") == "claude")
    items = items.withColumns({"slashes": slashes, "skilled": skilled})
    words = {"text": F.when(F.col("correction"), F.col("text")), "output": F.when(F.expr("failed OR hung"), output), "command": call["command"], "sole": F.when(F.col("payload").isNotNull(), call["sole"]), "skill": F.when(F.col("skilled"), F.concat(F.lit("Skill("), F.col("skill"), F.lit(")")))}
    every = F.concat(F.array(*words.values()), F.transform("slashes", lambda n: F.concat(F.lit("/"), n)))
    items = items.withColumn("redacted", F.transform(every, lambda t: F.when(t.isNotNull(), tx.redact(t, settings))))
    items = items.withColumns({f"redacted_{n}": F.get("redacted", F.lit(k)) for k, n in enumerate(words)} | {"redacted_slashes": F.slice("redacted", len(words) + 1, F.size("slashes"))})
    shown = {"masked_text": ("redacted_text", catalog.EXCERPT_CHARS), "masked_output": ("redacted_output", catalog.EXCERPT_CHARS), "masked_call": ("redacted_command", catalog.EXCERPT_CHARS), "masked_command": ("redacted_command", catalog.COMMAND_CHARS), "masked_sole": ("redacted_sole", catalog.COMMAND_CHARS), "masked_payload": ("payload", catalog.EXCERPT_CHARS), "masked_skill": ("redacted_skill", catalog.EXCERPT_CHARS)}
    items = items.withColumns({n: F.when(F.col(t).isNotNull(), tx.shorten(F.col(t), most, settings)) for n, (t, most) in shown.items()})  # a payload is one of a few shapes, with nothing to mask

    def found(where, lst, entity, kind, text, tool="", command="", session="session_id", phase=0, sub=None, pos=None, cli_pos=0) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        row = F.struct(lit(lst).alias("list"), lit(entity).alias("entity"), lit(kind).alias("kind"), lit(text).alias("text"), lit(tool).alias("tool_name"), lit(command).alias("command"), F.col(session).alias("session"), lit(phase).alias("phase"), (F.col("sub") if sub is None else lit(sub)).alias("sub"), (F.col("pos") if pos is None else pos).alias("pos"), lit(cli_pos).alias("cli_pos"))
        return F.when(where, F.array(row)).otherwise(F.array()).cast(FOUND)

    def each(where, names: Column, make) -> Column:
        return F.when(where, F.transform(names, make)).otherwise(F.array()).cast(FOUND)

    def row(lst, entity, kind, text, tool, command, session, phase, sub, pos, cli_pos) -> Column:
        values = dict(list=lst, entity=entity, kind=kind, text=text, tool_name=tool, command=command, session=session, phase=phase, sub=sub, pos=pos, cli_pos=cli_pos)
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in values.items()))

    command, sole, sid, last = F.col("masked_command"), F.col("masked_sole"), F.col("session_id"), F.col("last_session_id")
    text, output, payload = F.col("masked_text"), F.col("masked_output"), F.col("masked_payload")
    at = (F.col("sub"), F.col("pos"))
    cut = lambda t: tx.shorten(t, catalog.EXCERPT_CHARS, settings)
    many = [
        each(F.size("slashes") > 0, F.col("slashes"), lambda n, k: row("slash", n, catalog.SLASH, cut(F.get("redacted_slashes", k)), "", "", sid, 0, 0, k, 0)),
        found((F.col("text") != "") & F.col("correction"), "correction", "", catalog.CORRECTION, text, sub=1),
        found(is_call, "call", "", "call", "", tool, command),
        found(F.col("skilled"), "skill", F.col("skill"), catalog.SKILL, F.col("masked_skill"), tool),
        each(is_call & (F.col("call.command") != ""), clis, lambda c, k: row("cli", c, catalog.INVOCATION, F.col("masked_call"), tool, command, sid, 0, *at, k)),
        found(F.col("failed"), "failure", "", catalog.FAILURE, output, tool, command),
        each(F.col("failed"), F.col("blamed"), lambda c, k: row("cli", c, catalog.FAILURE, output, tool, command, sid, 0, *at, k)),
        each(F.col("hung"), clis, lambda c, k: row("cli", c, catalog.HANG, output, "Bash", command, sid, 0, *at, k)),
        found(F.col("payload").isNotNull(), "empty", "", catalog.EMPTY, payload, tool, sole, "last_session_id", 1),
        each(F.col("payload").isNotNull(), clis, lambda c, k: row("cli", c, catalog.EMPTY, payload, tool, sole, last, 1, *at, k)),
    ]
    own = ["source", "path", "session_ord", "mtime", "line", "ts", "last_session_id", *HEAD, *more]
    called = F.col("call.command").alias("called")
    rows = items.select(*own, called, F.explode(F.concat(*many)).alias("e")).select(*own, "called", "e.*")
    time = tx.parse_time(F.col("ts"))
    raw = F.when(F.col("list") == "call", F.col("called"))
    plain = F.when(raw.isNotNull(), (raw != "") & ~matches(raw, catalog.CODE_HEAD))
    hits = F.when(raw.isNotNull(), F.filter(F.array(*(F.when(matches(raw, w[1]), F.lit(n)) for n, w in enumerate(catalog.WORKFLOWS))), lambda x: x.isNotNull()))
    return rows.select(
        "list", "entity", "source", "path", "line", F.col("session").alias("session_id"), "kind", "tool_name",
        "command", tx.iso(time).alias("occurred_at"), F.coalesce("text", F.lit("")).alias("excerpt"),
        F.coalesce(time, "mtime", tx.path_time(F.col("path"))).alias("event_time"), "mtime", "last_session_id", *HEAD,
        *(c for c in ORDER if c != "line"), F.when(raw.isNotNull(), tx.executable(raw)).alias("program"), plain.alias("plain"), hits.alias("workflows"),
        F.when(plain, raw).alias("raw_command"), *more,
    )


HEAD = ["cwd", "started_at", "ended_at"]


def sessions(found: DataFrame) -> DataFrame:
    """One row per file that has a signal: header, names and counts."""
    names = lambda lst: F.array_sort(F.collect_set(F.when(F.col("list") == lst, F.col("entity"))))
    count = lambda lst: F.count_if(F.col("list") == lst)
    head = [F.first(c).alias(c) for c in ("source", "session_ord", *HEAD)]
    sums = found.groupBy("path").agg(*head, F.first("last_session_id").alias("session_id"), count("call").alias("tool_call_count"), names("cli").alias("pp_cli_names"), names("skill").alias("skill_names"), names("slash").alias("slash_commands"), count("failure").alias("failure_count"), count("empty").alias("silent_empty_count"), count("correction").alias("correction_count"), F.max(F.col("list") != "call").alias("signal"))
    return sums.where("signal").select("source", "path", "session_id", *HEAD, "tool_call_count", "pp_cli_names", "skill_names", "slash_commands", "failure_count", "silent_empty_count", "correction_count", "session_ord")
