"""Queries over transcripts rendered from the events whose calls are programs and whose outputs have many shapes.

Each click of a user is a call in the user's file and the line after it its result. What a call is and what comes back
follows from the event's number ``k``: a program with one or two command strings, a program that only speaks of a tool, or
a plain command line; an output as a text, a list of blocks and bare strings, an object, a number or nothing. The lines go
through the whole engine; the SQL works out from the events what it must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.config import Settings
from tracemill.mined_queries import Query, _once
from tracemill.operators import normalize, routes
from tracemill.plans.scan import mine
from tracemill.sources import shared, transcripts

SETTINGS = Settings()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Tools whose source lies in the tree.
TREE = (("beacon-pp-cli", "/tools/library/beacon"), ("dyno-pp-cli", "/tools/library/dyno"))

#: The rows that lines and SQL are made from.
SHAPES = """
WITH told AS (
  SELECT user_id, event_id, ts, coalesce(CAST({k} AS INTEGER), 0) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'click'),
calls AS (
  SELECT *, k % 4 AS kind, CAST(2 * nth - 1 AS INTEGER) AS line, 'item ' || CAST(k AS VARCHAR) AS words, CAST(k % 3 AS VARCHAR) AS code FROM told)"""


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, SHAPES.format(k="json_extract_string(props, '$.k')") + sql
        return f

    return add


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    rows = events.select("user_id", "event_id", "ts", k.alias("k"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("nth"))
    return rows.select("*", (F.col("k") % 4).alias("kind"), F.concat(F.lit("item "), F.col("k").cast("string")).alias("words"), (F.col("k") % 3).cast("string").alias("code"))


def _input() -> Column:
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    number = F.col("k").cast("string")
    return (
        F.when(F.col("kind") == 0, text('// one call\nconst r = await run({cmd: "ledger-pp-cli get ', number, '"})'))
        .when(F.col("kind") == 1, text("await Promise.all([run({command: 'beacon-pp-cli list'}), run({\"cmd\": \"cairn-pp-cli show\\ntrue\"})])"))
        .when(F.col("kind") == 2, text('// first\n\n// second\nlet note = "ghost-pp-cli ', number, '"; export default note'))
        .otherwise(text("dyno-pp-cli list ", number))
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, path, mtime, session_ord, line, raw."""
    rows = calls(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    named = lambda **c: F.struct(*(v.alias(n) for n, v in c.items()))
    call_id = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    ended = F.concat(F.lit("beacon-pp-cli said so\n"), F.lit("Process exited with code "), F.col("code"))
    asks = F.to_json(F.struct(F.lit("response_item").alias("type"), stamp, named(type=F.lit("custom_tool_call"), name=F.lit("exec"), call_id=call_id, input=_input()).alias("payload")))
    back = F.to_json(F.struct(F.lit("response_item").alias("type"), stamp, named(type=F.lit("custom_tool_call_output"), call_id=call_id, output=F.array(named(type=F.lit("output_text"), text=ended))).alias("payload")))
    both = rows.select("user_id", F.posexplode(F.array(asks, back)).alias("p", "raw"), "nth")
    path = F.concat(F.lit("/programs/u"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    return both.select(F.lit("codex").alias("source"), path.alias("path"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("mtime"), F.col("user_id").cast("long").alias("session_ord"), (2 * F.col("nth") - 1 + F.col("p")).cast("int").alias("line"), "raw")


def evidence_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _once(spark, sf_dir, "programs", lambda: mine(shared.keep(lines(spark, sf_dir), "programs"), SETTINGS))[1]


#: A file whose calls show nothing has no signal. Of two tools of a failed call the one that the output names is blamed.
FOUND = """,
ran AS (
  SELECT *, unnest(CASE kind WHEN 0 THEN ['ledger-pp-cli'] WHEN 1 THEN ['beacon-pp-cli', 'cairn-pp-cli'] WHEN 3 THEN ['dyno-pp-cli'] ELSE CAST([] AS VARCHAR[]) END) AS entity FROM calls),
seen AS (
  SELECT user_id, line, entity, 'pp_cli_invocation' AS kind FROM ran
  UNION ALL SELECT user_id, line + 1, entity, 'tool_failure' FROM ran WHERE code <> '0' AND (kind <> 1 OR entity = 'beacon-pp-cli'))"""


@query(FOUND + " SELECT '/programs/u' || CAST(user_id AS VARCHAR) || '.jsonl' AS path, CAST(line AS INTEGER) AS line, entity, kind FROM seen")
def program_calls(spark, sf_dir):
    """Tools that programs run, by their command strings, and those that plain lines run; code that only names one runs none."""
    return evidence_of(spark, sf_dir).where("list = 'cli'").select("path", "line", "entity", "kind")


@query(
    FOUND
    + f""", sums AS (SELECT entity, count(*) FILTER (kind = 'tool_failure') AS failures FROM seen GROUP BY entity)
SELECT entity AS target_name, CAST(failures AS BIGINT) AS failures, t.directory FROM sums LEFT JOIN (VALUES {", ".join(f"('{n}', '{d}')" for n, d in TREE)}) t(name, directory) ON t.name = entity
WHERE failures > 0 AND (t.directory IS NOT NULL OR entity = 'dyno-pp-cli')"""
)
def tools_of_a_tree(spark, sf_dir):
    """Flagged tools where a source tree is at hand: names seen in programs alone must resolve there."""
    tree = spark.createDataFrame(list(TREE), "entity string, directory string")
    found = routes.tools(evidence_of(spark, sf_dir), SETTINGS, tree)
    failures = F.regexp_extract("summary", r"(\d+) failure", 1).cast("long")
    directory = F.nullif(F.regexp_extract("suggested_action", r"Its source is at (.*)\.$", 1), F.lit(""))
    return found.select("target_name", failures.alias("failures"), directory.alias("directory"))


@query(""", outputs AS (
  SELECT event_id, 'claude' AS source, CASE k % 6 WHEN 0 THEN words WHEN 1 THEN words || chr(10) || 'bare' || chr(10) || 'inner' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN words ELSE '' END AS output FROM calls WHERE user_id % 2 = 0
  UNION ALL SELECT event_id, 'codex', CASE k % 6 WHEN 0 THEN words WHEN 1 THEN words || 'bare' WHEN 2 THEN words WHEN 3 THEN CAST(k AS VARCHAR) WHEN 4 THEN words || code ELSE '' END FROM calls WHERE user_id % 2 = 1)
SELECT event_id, source, output FROM outputs""")
def output_shapes(spark, sf_dir):
    """What results say, whatever their shape: texts, blocks, bare strings, objects, numbers, nothing; in both dialects."""
    rows = calls(spark, sf_dir)
    words, k6 = F.to_json(F.array("words")), F.col("k") % 6
    quoted = F.substring(words, F.lit(2), F.length(words) - 2)  # the text as JSON
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    ours = (
        F.when(k6 == 0, quoted)
        .when(k6 == 1, text('[{"type":"text","text":', quoted, '},"bare",{"type":"image","text":"no"},{"type":"tool_result","content":"inner"},{"type":"text","text":""}]'))
        .when(k6 == 2, text('{"text":', quoted, "}"))
        .when(k6 == 3, F.col("k").cast("string"))
        .when(k6 == 4, text('[{"type":"tool_result","text":"","content":', quoted, "}]"))
        .otherwise(F.lit("null"))
    )
    theirs = (
        F.when(k6 == 0, quoted)
        .when(k6 == 1, text('[{"type":"output_text","text":', quoted, '},"bare",{"type":"image","text":"no"}]'))
        .when(k6 == 2, text('{"text":"","output":', quoted, "}"))
        .when(k6 == 3, F.col("k").cast("string"))
        .when(k6 == 4, text('[{"type":"input_text","text":', quoted, '},{"type":"text","text":"', F.col("code"), '"}]'))
        .otherwise(F.lit("null"))
    )
    claude = text('{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"', F.col("event_id").cast("string"), '","content":', ours, "}]}}")
    codex = text('{"type":"response_item","payload":{"type":"function_call_output","call_id":"', F.col("event_id").cast("string"), '","output":', theirs, "}}")
    raw = F.when(F.col("user_id") % 2 == 0, claude).otherwise(codex)
    shown = rows.select(F.when(F.col("user_id") % 2 == 0, "claude").otherwise("codex").alias("source"), F.lit("/x.jsonl").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(0).cast("long").alias("session_ord"), F.lit(1).alias("line"), raw.alias("raw"))
    found = normalize.normalized(transcripts.records(shown)).select("source", F.explode("results").alias("r"))
    return found.select(F.col("r.call_id").cast("long").alias("event_id"), "source", F.col("r.output").alias("output"))
