"""Content ideas: slash commands, a private build, workflow clusters and rankings of what is used.

A proposal's key covers all its evidence, hashed as it streams by; what is kept with it is cut by rank first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import catalog
from tracemill.functions.patterns import matches
from tracemill.operators.evidence import FIELDS, ORDER
from tracemill.operators.keys import stream_keys
from tracemill.operators.routes import COLUMNS, kept, num

DETAILS = "content_type string, recommendation string, confidence double, trigger string, audience array<string>, why array<string>, query string, outline array<string>, private boolean"
NAME_PATTERN = r"^[A-Za-z][A-Za-z0-9._-]*$"


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def as_workflow(calls: DataFrame) -> DataFrame:
    """Calls as evidence: what stands for them is their command, redacted like everything else."""
    return calls.withColumns({"kind": F.lit(catalog.WORKFLOW), "excerpt": F.col("command")})


def private(rows: DataFrame) -> Column:
    return matches(F.concat_ws(" ", "excerpt", "command"), catalog.PRIVATE)


def _finish(rows: DataFrame, number: int, group: str, title: Column, summary: Column, content_type: Column, recommendation: Column, confidence: Column, trigger: str, audience: Column, why: Column, query: Column, outline: Column, order: list[str] = ORDER) -> DataFrame:
    """rows: all evidence of the proposals, with what their words need; one proposal per value of ``group``."""
    rows = rows.withColumns({"p_title": title, "p_private": private(rows)})
    keys = stream_keys(rows, group, F.concat(F.lit("content_idea\0"), F.col("p_title")), order)
    sums = rows.groupBy(group).agg(
        F.first("p_title").alias("title"), F.first(summary).alias("summary"), F.first(content_type).alias("content_type"), F.first(recommendation).alias("recommendation"), F.first(confidence).alias("confidence"),
        F.first(audience).alias("audience"), F.first(why).alias("why"), F.first(query).alias("query"), F.first(outline).alias("outline"), F.max("p_private").alias("private"), F.max("event_time").alias("latest_evidence"),
    )
    groups = sums.join(kept(rows, group, order).drop("latest_evidence"), group).join(keys, F.col(group).cast("string") == F.col("group"))
    demoted = F.col("private") & (F.col("recommendation") == "write_now")
    groups = groups.withColumns({"confidence": F.when(demoted, F.least("confidence", F.lit(0.72))).otherwise(F.col("confidence")), "recommendation": F.when(demoted, "needs_context").otherwise(F.col("recommendation"))})
    hidden = F.transform("evidence", lambda e: F.struct(*((F.lit(catalog.HIDDEN) if c in ("command", "excerpt") else e[c]).alias(c) for c in FIELDS)))
    groups = groups.withColumns({"evidence": F.when(F.col("private"), hidden).otherwise(F.col("evidence")), "trigger": F.lit(trigger)})
    details = F.to_json(F.struct(*(c.split(" ")[0] for c in DETAILS.split(", "))))
    return groups.select(F.lit(number).alias("gen_route"), F.col(group).cast("string").alias("gen_name"), F.lit("content_idea").alias("route"), "title", "summary", F.lit("content_angle").alias("target_kind"), F.col("title").alias("target_name"), "evidence", "latest_evidence", F.lit("Review the angle, privacy notes, and evidence references. If approved, optionally run the suggested last30days query, then brief a writer. Do not auto-draft.").alias("suggested_action"), F.array().cast("array<string>").alias("impact"), "proposal_key", details.alias("details"))


def slash_ideas(spark: SparkSession, found: DataFrame) -> DataFrame:
    rows = found.where("list = 'slash'")
    profiles = spark.createDataFrame([(n, *p[:3], list(p[3])) for n, p in catalog.SLASH_PROFILES.items()], "entity string, title string, type string, query string, audience array<string>")
    sums = rows.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions")).join(F.broadcast(profiles), "entity", "left").where("title IS NOT NULL OR n_sessions >= 2")
    label = F.concat(F.lit("/"), F.col("entity"))
    rows = rows.join(sums, "entity")
    summary = F.concat(label, F.lit(" appeared in "), num("n"), F.lit(" transcript signal(s) across "), num("n_sessions"), F.lit(" session(s), suggesting a repeatable agent workflow."))
    outline = F.array(F.concat(F.lit("What was tedious before "), label), *map(F.lit, ("The steps it stands for, one by one", "Two or three days of using it", "A version for others, with nothing private in it", "When not to reach for it")))
    return _finish(rows, 5, "entity", F.coalesce("title", F.concat(F.lit("How I use "), label, F.lit(" in real agent workflows"))), summary, F.coalesce("type", F.lit("blog_post")), F.lit("write_now"), F.when(F.col("n_sessions") >= 2, 0.82).otherwise(0.72), "slash_command_usage", F.coalesce("audience", _words(("agent builders", "operators"))), _words(("A named command can be shown, copied and tried at once.", "It came up again and again without anybody planning to write about it.")), F.coalesce("query", F.concat(label, F.lit(" agent workflows slash commands"))), outline)


def private_build(found: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "excerpt", "command")
    rows = found.where((F.col("list") == "failure") & matches(text, catalog.PRIVATE) & matches(text, catalog.BUILD)).withColumn("one", F.lit(0))
    title, trigger, summary, audience, why, query, outline, confidence = catalog.PRIVATE_BUILD
    return _finish(rows, 6, "one", F.lit(title), F.lit(summary), F.lit("case_study"), F.lit("needs_context"), F.lit(confidence), trigger, _words(audience), _words(why), F.lit(query), _words(outline))


def workflow_rows(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Evidence of each workflow pattern that has enough of it, with the pattern's profile."""
    profiles = spark.createDataFrame([(n, *w[2:6], list(w[6]), list(w[7]), list(w[8]), *w[9:]) for n, w in enumerate(catalog.WORKFLOWS)], "workflow int, least int, title string, type string, query string, audience array<string>, why array<string>, outline array<string>, recommend string, sure double, label string")
    rows = as_workflow(found.where("list = 'call' AND size(workflows) > 0")).withColumn("workflow", F.explode("workflows"))
    sums = rows.groupBy("workflow").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("n_sessions")).join(F.broadcast(profiles), "workflow").where("n >= least")
    return rows.join(F.broadcast(sums), "workflow")  # a row per pattern


def workflow_ideas(rows: DataFrame) -> DataFrame:
    summary = F.concat(F.lit("Matched "), num("n"), F.lit(" command-level workflow signal(s) across "), num("n_sessions"), F.lit(" session(s), suggesting a repeatable operating loop."))
    return _finish(rows, 7, "workflow", F.col("title"), summary, F.col("type"), F.col("recommend"), F.col("sure"), "workflow_command_cluster", F.col("audience"), F.col("why"), F.col("query"), F.col("outline"))


#: Names that a sketch keeps count of, and those that it proposes as the most used.
TRACKED, CANDIDATES = 10_000, 200


def _counted(rows: DataFrame, most: int) -> DataFrame:
    """name, n, first: the names of the rows used most, by counting each."""
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("first")).orderBy(F.col("n").desc(), "first").limit(most)


def most_used(rows: DataFrame, most: int) -> DataFrame:
    """As ``_counted``, with a shuffle that doesn't grow with the number of names.

    A mergeable frequent-items sketch proposes candidates; a name that is none of them occurs at most as often as the
    sketch's error or its last candidate's estimate allows. The candidates are counted exactly, and if the last name
    wanted occurs more often than that, no other can be among them. Otherwise every name is counted.
    """
    told = rows.agg(F.count("name").alias("n"), F.expr(f"approx_top_k(name, {CANDIDATES}, {TRACKED})").alias("top")).first()
    names = [t.item for t in told.top or [] if t.item is not None]  # at most CANDIDATES
    if not names:
        return _counted(rows, most)
    found = _counted(rows.where(F.col("name").isin(names)), most)
    if sum(t["count"] for t in told.top) == told.n:  # the sketch has dropped nothing: these are all names
        return found
    error = told.n * 3.5 * 0.75 / TRACKED  # a name that the sketch leaves out for doubt may have twice as many
    others = max(told.top[-1]["count"] if len(names) == CANDIDATES else 0, 2 * error)
    least = found.agg(F.min("n").alias("n"), F.count("*").alias("names")).first()
    return found if least.names == most and least.n > others else _counted(rows, most)


def ranked_names(rows: DataFrame, most: int = 10) -> DataFrame:
    """name, n, place: the names used most; of equal ones the one met first."""
    sums = most_used(rows, most)
    return sums.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "first"))).select("name", "n", "place")  # at most ``most`` rows


def ranking(found: DataFrame, number: int, profile: tuple) -> DataFrame:
    lst, title, trigger, opening, prefix, audience, why, query, outline, confidence = profile
    if lst == "executable":
        rows = as_workflow(found.where("list = 'call'")).withColumn("name", F.col("program"))
        rows = rows.where(~F.col("name").isin(*catalog.CONTENT_IGNORE) & matches(F.col("name"), NAME_PATTERN))
    else:
        rows = found.where(F.col("list") == lst).withColumn("name", F.col("entity"))
        if lst == "slash":
            rows = rows.where(F.substring("name", 1, 1).rlike("^[a-z]"))
    top = ranked_names(rows)
    listed = top.agg(F.array_sort(F.collect_list(F.struct("place", "name", "n"))).alias("top")).where("size(top) >= 3")
    summary = listed.select(F.concat(F.lit(opening), F.array_join(F.transform("top", lambda t: F.concat(F.lit(prefix), t["name"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), ", ")).alias("words"))
    shown = rows.join(F.broadcast(top), "name").withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy(*ORDER))).where("nth <= 2")
    shown = shown.orderBy("place", "nth").limit(catalog.KEPT_EVIDENCE).crossJoin(F.broadcast(summary)).withColumn("one", F.lit(0))  # one row of words
    return _finish(shown, number, "one", F.lit(title), F.col("words"), F.lit("listicle"), F.lit("write_now"), F.lit(confidence), trigger, _words(audience), _words(why), F.lit(query), _words(outline), ["place", "nth"])


def roundup(rows: DataFrame) -> DataFrame:
    """One proposal over the workflows, if two or more have evidence; it dates from its files."""
    title, trigger, opening, audience, why, query, outline, confidence = catalog.ROUNDUP
    secret = rows.groupBy("workflow").agg(F.max(private(rows)).alias("secret"))  # partial sums: calls stay where they are
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("workflow").orderBy(*ORDER))).where("nth <= 3").join(secret, "workflow")  # a rank cut before the shuffle
    hide = lambda c: F.when(F.col("secret"), F.lit(catalog.HIDDEN)).otherwise(F.col(c))
    first = first.withColumns({"excerpt": hide("excerpt"), "command": hide("command"), "occurred_at": F.lit(""), "event_time": F.coalesce("mtime", "event_time")})
    labels = first.groupBy().agg(F.array_sort(F.collect_set(F.struct("workflow", "label"))).alias("found")).where("size(found) >= 2")
    words = labels.select(F.concat(F.lit(opening), F.array_join(F.transform("found", lambda f: f["label"]), ", ")).alias("words"))
    shown = first.orderBy("workflow", "nth").limit(catalog.KEPT_EVIDENCE).crossJoin(F.broadcast(words)).withColumn("one", F.lit(0))
    return _finish(shown, 11, "one", F.lit(title), F.col("words"), F.lit("roundup"), F.lit("write_now"), F.lit(confidence), trigger, _words(audience), _words(why), F.lit(query), _words(outline), ["workflow", "nth"])


def ideas(spark: SparkSession, found: DataFrame) -> DataFrame:
    """All content proposals, in their order."""
    rows = workflow_rows(spark, found)
    out = slash_ideas(spark, found).unionByName(private_build(found)).unionByName(workflow_ideas(rows))
    for n, profile in enumerate(catalog.RANKINGS):
        out = out.unionByName(ranking(found, 8 + n, profile))
    return out.unionByName(roundup(rows)).select(*COLUMNS)


def privacy(is_private: bool) -> dict:
    """The privacy section of a content proposal."""
    anonymise = ["people's names", "addresses and numbers", "credentials", "whose business it is", *(["what messages say", "who is in the thread"] if is_private else [])]
    blocked = ["secrets as they are", "data of clients", "family and health", *(["messages as they are", "address books"] if is_private else [])]
    return {"risk_level": "high" if is_private else "low", "must_anonymize": anonymise, "safe_public_abstraction": "Tell how the workflow goes, with made-up examples in place of the real ones.", "blocked_details": blocked, "content_notice": catalog.PRIVACY_NOTICE}


#: What every content proposal says, whatever it is about.
USEFUL = ("It happened in real sessions.", "After review it can become a guide, a case or a look behind the scenes.")
WHY_NOW = "People are talking about agents that work with local data."
PURPOSE = "Before writing: what words readers use, what they object to, what exists already."
ASKED = ("Is this the right angle?", "What has to stay private or be changed?", "Is the search worth running first?")


def content_document(row, base: dict) -> dict:
    """A content proposal as a document."""
    d = json.loads(row.details)
    same = {new: d[old] for new, old in (("content_type", "content_type"), ("recommendation", "recommendation"), ("audience", "audience"), ("why_interesting", "why"), ("rough_outline", "outline"))}
    return base | same | {
        "confidence": round(d["confidence"], 2), "privacy": privacy(d["private"]), "reader_usefulness": list(USEFUL),
        "trigger": {"kind": d["trigger"], "real_workflow_or_moment": row.summary}, "timeliness": {"why_now": WHY_NOW, "last30days_recommended": True},
        "last30days": {"should_run": True, "suggested_search_query": d["query"], "purpose": PURPOSE}, "review": {"needed_from_reviewer": list(ASKED), "next_action": "Staged for an editor; nothing is written or published by itself."},
        "apply_policy": {"mode": "manual_review_required", "notes": "Ideas only: to be reviewed before any research, writing or publishing."},
    }
