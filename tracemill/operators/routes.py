"""Improvement proposals: tracked tools, skills, project memory, backlog tools and tool servers.

Each route filters the evidence, groups it, applies its thresholds and keeps the first pieces of each group in the order
of the files. Counts are plain aggregates; the pieces that are kept are cut by rank before they are gathered, so no group
is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import catalog
from tracemill.config import Settings
from tracemill.functions import text as tx
from tracemill.functions.patterns import matches
from tracemill.functions.shell import flag_shapes, tracked_names
from tracemill.operators.evidence import FIELDS, ORDER
from tracemill.operators.keys import key_of

COLUMNS = ["gen_route", "gen_name", "route", "title", "summary", "target_kind", "target_name", "evidence", "latest_evidence", "suggested_action", "impact", "proposal_key", "details"]


def not_subagent(settings: Settings) -> Column:
    return F.lit(settings.subagent_failures) | ~F.col("path").contains("/subagents/")


def kept(rows: DataFrame, group: str, order: list[str], most: int = catalog.KEPT_EVIDENCE) -> DataFrame:
    """group, evidence (in order), latest_evidence, kept_sessions of each group's first rows."""
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("nth") <= most)
    item = F.struct("nth", *FIELDS, "event_time")
    got = ranked.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("kept"), F.max("event_time").alias("latest_evidence"))
    evidence = F.transform("kept", lambda e: F.struct(*(e[c].alias(c) for c in FIELDS)))
    return got.select(group, evidence.alias("evidence"), "latest_evidence", F.size(F.array_distinct(F.transform("kept", lambda e: e["session_id"]))).alias("kept_sessions"))


def references(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.concat_ws(":", e["source"], e["path"], e["line"].cast("string"), e["kind"]))


def said(*parts: tuple[Column, Column]) -> Column:
    """The parts whose condition holds, with commas between them."""
    return F.concat_ws(", ", *(F.when(c, t) for c, t in parts))


def num(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def proposal(groups: DataFrame, number: int, name: str, route: str, target_kind: str, target: Column, title: Column, summary: Column, action: Column, impact: list[str]) -> DataFrame:
    key = key_of([F.lit(route), F.lit(target_kind), target], references(F.col("evidence")))
    return groups.select(F.lit(number).alias("gen_route"), F.col(name).alias("gen_name"), F.lit(route).alias("route"), title.alias("title"), summary.alias("summary"), F.lit(target_kind).alias("target_kind"), target.alias("target_name"), "evidence", "latest_evidence", action.alias("suggested_action"), F.array(*map(F.lit, impact)).alias("impact"), key.alias("proposal_key"), F.lit(None).cast("string").alias("details"))


def retries(cli: DataFrame, settings: Settings) -> DataFrame:
    """entity, retries: the most uses of a tool in one session that had trouble, or tried one subcommand with other flags."""
    counted = cli.where((F.col("kind") != catalog.EMPTY) | not_subagent(settings))
    keys = ["path", "entity", "session_id"]
    per = counted.groupBy(*keys).agg(F.count_if(F.col("kind") == catalog.INVOCATION).alias("uses"), F.max(F.col("kind") != catalog.INVOCATION).alias("trouble")).where(F.col("uses") >= catalog.RETRIES)
    used = counted.where(F.col("kind") == catalog.INVOCATION).join(per.where("NOT trouble").select(*keys), keys, "left_semi")
    shape = used.select(*keys, F.explode(flag_shapes(settings, F.col("command"), F.col("entity"))).alias("s")).where("s.subcommand != ''")
    varied = shape.groupBy(*keys, "s.subcommand").agg(F.count_distinct("s.flags").alias("n")).where("n > 1").select(*keys).distinct().withColumn("varied", F.lit(True))
    found = per.join(varied, keys, "left").where("trouble OR varied")
    return found.groupBy("entity").agg(F.max("uses").alias("retries"))


def tools(found: DataFrame, settings: Settings, sources: DataFrame | None) -> DataFrame:
    """Tracked tools with failures, hangs, swallowed empty results or retries.

    sources: (entity, directory) where a source tree is at hand; names seen only in programs must then resolve there.
    """
    cli = found.where("list = 'cli'").where((F.col("kind") != catalog.EMPTY) | not_subagent(settings))
    kind = lambda k: F.count_if(F.col("kind") == k)
    sums = cli.groupBy("entity").agg(kind(catalog.FAILURE).alias("failures"), kind(catalog.HANG).alias("hangs"), kind(catalog.EMPTY).alias("empties"))
    sums = sums.join(retries(found.where("list = 'cli'"), settings), "entity", "left").withColumn("retries", F.coalesce("retries", F.lit(0)))
    sums = sums.where("failures > 0 OR hangs > 0 OR empties > 0 OR retries > 0").where(matches(F.col("entity"), settings.cli_name))
    sums = sums.withColumn("directory", F.lit(None).cast("string"))
    if sources is not None:
        sums = sums.drop("directory").join(sources, "entity", "left")
        if settings.validate_candidates:
            typed = found.where("list = 'call' AND plain").select(F.explode(tracked_names(settings, F.col("raw_command"))).alias("entity")).distinct().withColumn("typed", F.lit(True))
            sums = sums.join(typed, "entity", "left").where("typed OR directory IS NOT NULL").drop("typed")
    rank = F.array_position(F.array(*map(F.lit, (catalog.FAILURE, catalog.HANG, catalog.EMPTY, catalog.INVOCATION))), F.col("kind"))
    groups = sums.join(kept(cli.withColumn("rank", rank), "entity", ["rank", *ORDER]), "entity")
    name = F.col("entity")
    bits = said((F.col("failures") > 0, F.concat(num("failures"), F.lit(" failure signal(s)"))), (F.col("hangs") > 0, F.concat(num("hangs"), F.lit(" hang/timeout signal(s)"))), (F.col("empties") > 0, F.concat(num("empties"), F.lit(" swallowed empty result(s)"))), (F.col("retries") > 0, F.concat(F.lit("retried up to "), num("retries"), F.lit("x in one session before it worked"))))
    action = F.concat(F.lit("Review the evidence. If it reflects a missing command, bad flag, bad JSON contract, silent-null result, fragile auth flow, or syntax the agent had to guess and retry, fix the tool itself instead of working around it in a prompt."), F.coalesce(F.concat(F.lit(" Its source is at "), F.col("directory"), F.lit(".")), F.lit("")))
    return proposal(groups, 0, "entity", "tool", "tool", name, F.concat(F.lit("Review "), name, F.lit(" friction from real CLI use")), F.concat(name, F.lit(": "), bits, F.lit(" across "), num("kept_sessions"), F.lit(" session(s).")), action, ["shorter", "safer", "more_correct", "more_ergonomic"])


def skills(found: DataFrame) -> DataFrame:
    """Skills whose sessions hold corrections after their first use."""
    used = found.where("list = 'skill'")
    first = used.groupBy("path", "entity").agg(F.min("line").alias("first_line"))
    later = found.where("list = 'correction'").drop("entity").join(first, "path").where("line > first_line").drop("first_line")
    own = used.join(later.select("path", "entity").distinct(), ["path", "entity"], "left_semi")
    both = own.withColumn("turn", F.lit(0)).unionByName(later.withColumn("turn", F.lit(1)).select(*used.columns, "turn"))
    groups = both.groupBy("entity").agg(F.count_distinct("session_id").alias("n")).join(kept(both, "entity", ["session_ord", "turn", *ORDER[1:]]), "entity")
    name = F.col("entity")
    return proposal(groups, 1, "entity", "skill_improvement", "skill", name, F.concat(F.lit("Review "), name, F.lit(" skill after user correction")), F.concat(F.lit("The "), name, F.lit(" skill was invoked in "), num("n"), F.lit(" session(s) that also contained user correction signal(s).")), F.lit("Read the skill and the referenced transcript lines. If the correction is durable, stage a patch to SKILL.md or a support file. Prefer patching this existing skill over creating a new one."), ["shorter", "more_correct", "more_ergonomic"])


def memory(found: DataFrame, index: DataFrame) -> DataFrame:
    """Corrections by project, in sessions that use no skill; a few of each session."""
    with_skill = found.where("list = 'skill'").select("path").distinct()
    rows = found.where("list = 'correction'").join(with_skill, "path", "left_anti")
    rows = rows.withColumn("own", F.row_number().over(W.partitionBy("path").orderBy(*ORDER))).where(F.col("own") <= catalog.CORRECTIONS_A_SESSION)
    rows = rows.join(index.select("path", F.coalesce(F.nullif(F.col("cwd"), F.lit("")), F.lit("unknown-project")).alias("project")), "path")
    groups = rows.groupBy("project").agg(F.count("*").alias("n")).join(kept(rows, "project", ORDER), "project")
    name = F.col("project")
    label = F.when(name == "unknown-project", name).otherwise(F.regexp_extract(name, "([^/]*)/*$", 1))
    return proposal(groups, 2, "project", "memory_context", "memory_or_runbook", name, F.concat(F.lit("Review durable corrections for "), label), F.concat(num("n"), F.lit(" correction signal(s) in sessions under "), name, F.lit(" were not tied to a specific invoked skill.")), F.lit("Classify each correction as durable preference, project runbook update, or one-off incident. Stage AGENTS.md/CLAUDE.md/memory edits only for durable lessons; discard transient environment failures."), ["safer", "more_correct", "more_ergonomic"])


def _friction(rows: DataFrame, group: str) -> DataFrame:
    """Counts of failures and empty results by group, with their sessions."""
    failure = F.col("list") == "failure"
    session = lambda c: F.count_distinct(F.when(c, F.col("session_id")))
    return rows.groupBy(group).agg(F.count_if(failure).alias("failures"), F.count_if(~failure).alias("empties"), session(failure).alias("failure_sessions"), session(~failure).alias("empty_sessions"), F.count_distinct("session_id").alias("n_sessions"))


def backlog(found: DataFrame, settings: Settings) -> DataFrame:
    """Other programs whose use fails, or comes back empty, again and again."""
    rows = found.where(F.col("list").isin("failure", "empty") & not_subagent(settings))
    rows = rows.where((F.col("list") == "failure") & matches(F.col("excerpt"), catalog.TOOLING_FRICTION) | (F.col("list") == "empty") & ~F.col("tool_name").startswith("mcp__"))
    rows = rows.withColumn("blamed", tx.blamed_executable(F.col("command"), settings.backlog_ignore)).where(F.col("blamed") != "").where(~F.col("blamed").endswith(settings.suffix))
    groups = _friction(rows, "blamed").where("(failures >= 3 AND failure_sessions >= 2) OR (empties >= 3 AND empty_sessions >= 2)")
    groups = groups.join(kept(rows.withColumn("rank", (F.col("list") == "empty").cast("int")), "blamed", ["rank", *ORDER]), "blamed")
    name = F.col("blamed")
    bits = said((F.col("failures") > 0, F.concat(num("failures"), F.lit(" command-interface failure(s)"))), (F.col("empties") > 0, F.concat(num("empties"), F.lit(" swallowed empty result(s)"))))
    return proposal(groups, 3, "blamed", "backlog", "tooling", name, F.concat(F.lit("Investigate repeated "), name, F.lit(" command friction")), F.concat(name, F.lit(" had "), bits, F.lit(" across "), num("n_sessions"), F.lit(" session(s).")), F.lit("Decide whether this is a durable tooling/runbook gap or a transient environment issue. For unexpected empty data, add a clear empty-result error or contract check instead of consuming it."), ["shorter", "safer", "more_correct"])


def servers(found: DataFrame, settings: Settings) -> DataFrame:
    """Tool servers with three failed or empty calls in two sessions."""
    rows = found.where(F.col("list").isin("failure", "empty") & F.col("tool_name").startswith("mcp__") & not_subagent(settings)).withColumn("server", tx.mcp_server(F.col("tool_name")))
    groups = _friction(rows, "server").where("failures + empties >= 3 AND n_sessions >= 2")
    groups = groups.join(rows.groupBy("server").agg(F.array_sort(F.collect_set("tool_name")).alias("names")), "server")
    groups = groups.join(kept(rows.withColumn("rank", (F.col("list") == "empty").cast("int")), "server", ["rank", *ORDER]), "server")
    name = F.col("server")
    bits = said((F.col("failures") > 0, F.concat(num("failures"), F.lit(" failed tool call(s)"))), (F.col("empties") > 0, F.concat(num("empties"), F.lit(" swallowed empty result(s)"))))
    shown = F.concat(F.array_join(F.slice("names", 1, 4), ", "), F.when(F.size("names") > 4, "...").otherwise(""))
    return proposal(groups, 4, "server", "tool", "mcp_server", F.concat(F.lit("mcp:"), name), F.concat(F.lit("Review mcp:"), name, F.lit(" friction from real use")), F.concat(F.lit("MCP server "), name, F.lit(": "), bits, F.lit(" across "), num("n_sessions"), F.lit(" session(s) ("), shown, F.lit(").")), F.lit("Review the failed or empty calls. Recurring MCP friction usually means expired auth, a broken server config, a swallowed empty response, or a tool schema the agent keeps guessing wrong. Fix the server setup or its tool contract instead of prompting around it."), ["shorter", "safer", "more_correct"])


def improvements(found: DataFrame, index: DataFrame, settings: Settings, sources: DataFrame | None = None) -> DataFrame:
    """All five routes, in their order."""
    out = tools(found, settings, sources)
    for part in (skills(found), memory(found, index), backlog(found, settings), servers(found, settings)):
        out = out.unionByName(part)
    return out
