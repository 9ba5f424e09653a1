"""Queries that run the whole transcript engine over transcripts rendered from the events table, and their SQL.

A user's week is a file, its events in time are lines: a sign-up is something the user says, a view something the agent
says, a click a call, an error or a purchase a result, a header or a broken line. ``SCENES`` has their words. Even users
write one dialect, odd users the other. The rendered lines go through ``transcripts``, ``normalize``, ``evidence``,
``routes`` and ``content`` as those of a scan do; the SQL works out what is seen and proposed from the events alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill import catalog
from tracemill.config import Settings
from tracemill.operators import content, routes
from tracemill.plans import lifecycle
from tracemill.plans.scan import health_warnings, mine, parse_stats, propose
from tracemill.sources import shared, transcripts

#: event type, variant (k modulo the type's number of variants), text or output, tool, command, flag of a result
SCENES = (
    ("signup", 0, "No, that's wrong. Mail bob@example.com  instead", "", "", None),
    ("signup", 1, "Please continue with the next part", "", "", None),
    ("signup", 2, "/investigate the log\n/gstack now", "", "", None),
    ("signup", 3, "<system-reminder> never do this", "", "", None),
    ("signup", 4, "actually use the other one", "", "", None),
    ("signup", 5, "/last30days and /Nope", "", "", None),
    ("signup", 6, "[10:01] you missed it [10:02] yes", "", "", None),
    ("signup", 7, "fine " * 90 + "instead", "", "", None),
    ("view", 0, "I found no matching records, moving on", "", "", None),
    ("view", 1, "Next I will look at the logs", "", "", None),
    ("view", 2, "The search returned zero rows", "", "", None),
    ("click", 0, "", "Bash", "alpha-pp-cli list --k 1", None),
    ("click", 1, "", "Bash", "alpha-pp-cli list --verbose", None),
    ("click", 2, "", "Bash", "cd /x && beta-pp-cli get --json item", None),
    ("click", 3, "", "Bash", "git status", None),
    ("click", 4, "", "mcp", "", None),
    ("click", 5, "", "Skill", "", None),
    ("click", 6, "", "Bash", "gog gmail search inbox", None),
    ("click", 7, "", "Bash", "for x in alpha-pp-cli beta-pp-cli; do $x --help; done", None),
    ("click", 8, "", "Bash", "echo alpha-pp-cli", None),
    ("click", 9, "", "Bash", "curl https://api.example.com/api/issues/7", None),
    ("click", 10, "", "Bash", "psql -c 'select 1'", None),
    ("click", 11, "", "Bash", "kubectl get pods", None),
    ("error", 0, "unknown option --x", "", "", True),
    ("error", 1, "Process exited with code 2\nalpha-pp-cli: not found", "", "", None),
    ("error", 2, "Process exited with code 0\nOutput:\nno error at all", "", "", None),
    ("error", 3, "request timed out after 30s", "", "", None),
    ("error", 4, "[]", "", "", None),
    ("error", 5, "error: missing required email index", "", "", None),
    ("error", 6, "alpha-pp-cli: ok\nx\ny\nz\nbeta-pp-cli: unknown option --q", "", "", True),
    ("error", 7, "", "", "", True),
    ("purchase", 0, "header", "", "", None),
    ("purchase", 1, "Script completed\nWall time 1s\nOutput:\n", "", "", False),
    ("purchase", 2, "broken", "", "", None),
    ("purchase", 3, "thinking", "", "", None),
)
VARIANTS = {t: sum(s[0] == t for s in SCENES) for t in ("signup", "view", "click", "error", "purchase")}
SETTINGS = Settings()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, path, mtime, session_ord, line, raw: the events as numbered JSON lines of both dialects."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.floor(F.unix_seconds("ts") / 604800)
    session = F.concat(F.col("user_id").cast("string"), F.lit("-w"), week.cast("string"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    rows = events.select("event_id", "user_id", "ts", "event_type", k.alias("k"), session.alias("stem"), (F.col("user_id") * 100000 + week).alias("session_ord"))
    number = F.lit(1)
    for name, n in VARIANTS.items():
        number = F.when(F.col("event_type") == name, F.lit(n)).otherwise(number)
    scenes = spark.createDataFrame(SCENES, "event_type string, variant int, words string, tool string, command string, flag boolean")
    rows = rows.withColumn("variant", (F.col("k") % number).cast("int")).join(F.broadcast(scenes), ["event_type", "variant"])  # a row per scene
    claude = F.col("user_id") % 2 == 0
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    call_id = F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string"))
    tool = F.when(F.col("tool") == "mcp", F.concat(F.lit("mcp__s"), (F.col("k") % 7).cast("string"), F.lit("__get_items"))).otherwise(F.col("tool"))
    skill = F.when(F.col("tool") == "Skill", F.concat(F.lit("skill"), (F.col("event_id") % 5).cast("string")))
    named = lambda **c: F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in c.items()))
    session_id, cwd = F.concat(F.lit("h"), F.col("event_id").cast("string")), F.concat(F.lit("/work/p"), (F.col("k") % 5).cast("string"))

    def ours(kind, role, body, **more):
        return F.to_json(F.struct(F.lit(kind).alias("type"), stamp, named(role=role, content=body).alias("message"), *((v.alias(n)) for n, v in more.items())))

    def theirs(kind="response_item", **payload):
        return F.to_json(F.struct(F.lit(kind).alias("type"), stamp, named(**payload).alias("payload")))

    is_type = lambda t: F.col("event_type") == t
    special = lambda n: is_type("purchase") & (F.col("variant") == n)
    given = named(command=F.nullif(F.col("command"), F.lit("")), skill=skill)
    first = (
        F.when(special(0), ours("system", "system", F.lit(""), sessionId=session_id, cwd=cwd))
        .when(special(3), ours("assistant", "assistant", F.lit("")))
        .when(is_type("signup"), ours("user", "user", F.col("words")))
        .when(is_type("view"), ours("assistant", "assistant", F.array(named(type="text", text=F.col("words")))))
        .when(is_type("click"), ours("assistant", "assistant", F.array(named(type="tool_use", id=call_id, name=tool, input=given))))
        .otherwise(ours("user", "user", F.array(named(type="tool_result", tool_use_id=call_id, content=F.col("words"), is_error=F.col("flag")))))
    )
    second = (
        F.when(special(0), theirs("session_meta", id=session_id, cwd=cwd))
        .when(special(3), theirs(type="reasoning", text="hm"))
        .when(is_type("signup"), theirs(type="message", role="user", content=F.array(named(type="input_text", text=F.col("words")))))
        .when(is_type("view"), theirs(type="agent_message", message=F.col("words")))
        .when(is_type("click"), theirs(type="function_call", call_id=call_id, name=tool, arguments=F.to_json(named(cmd=F.col("command")))))
        .otherwise(theirs(type="function_call_output", call_id=call_id, output=F.col("words"), is_error=F.col("flag")))
    )
    raw = F.when(special(2), "{broken").when(claude, first).otherwise(second)
    path = F.concat(F.when(F.col("user_id") % 10 == 3, "/subagents/").otherwise("/files/"), "stem", F.lit(".jsonl"))
    line = F.row_number().over(W.partitionBy("stem").orderBy("ts", "event_id"))
    return rows.select(F.when(claude, "claude").otherwise("codex").alias("source"), path.alias("path"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("mtime"), "session_ord", line.alias("line"), raw.alias("raw"))


_made: dict[tuple, tuple[DataFrame, ...]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Tables in the shared folder, made once for each state of the events that a session sees."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    at = (spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen(), name)
    if at not in _made:
        _made[at] = make()
    return _made[at]


def mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, evidence, session index), written once to the shared folder, as a scan does before its routes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _once(spark, sf_dir, "mined", lambda: mine(shared.keep(rendered(spark, sf_dir), "lines"), SETTINGS))


def forget() -> None:
    """Mine anew from now on."""
    _made.clear()


def _text(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, (bool, int)) else "'" + value.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_text(pattern)})"


def _in(words) -> str:
    return "(" + ", ".join(map(_text, sorted(words))) + ")"


#: Collapsed white space; of what could be redacted these words hold an address only.
def _shown(column: str, limit: int) -> str:
    flat = f"trim(regexp_replace(regexp_replace({column}, {_text(catalog.REDACTIONS[0][0])}, '<email>', 'g'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(left({flat}, {limit - 1})) || '...' END"


EVIDENCE = f"""
WITH scenes(event_type, variant, words, tool, command, flag) AS (VALUES {", ".join("(" + ", ".join(map(_text, s)) + ")" for s in SCENES)}),
raw_lines AS (
  SELECT CAST(user_id AS VARCHAR) || '-w' || CAST(CAST(floor(epoch(ts) / 604800) AS BIGINT) AS VARCHAR) AS stem, event_id, user_id, ts, event_type,
    user_id * 100000 + CAST(floor(epoch(ts) / 604800) AS BIGINT) AS session_ord, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events),
told AS (
  SELECT l.*, s.variant, s.words, s.flag, s.command, CASE s.tool WHEN 'mcp' THEN 'mcp__s' || CAST(k % 7 AS VARCHAR) || '__get_items' ELSE s.tool END AS tool,
    CAST(row_number() OVER (PARTITION BY stem ORDER BY ts, event_id) AS INTEGER) AS line,
    CASE WHEN user_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS source,
    CASE WHEN user_id % 10 = 3 THEN '/subagents/' ELSE '/files/' END || stem || '.jsonl' AS path, 'c' || CAST(event_id % 2 AS VARCHAR) AS call_id,
    l.event_type = 'purchase' AND s.variant = 0 AS header
  FROM raw_lines l JOIN scenes s ON l.event_type = s.event_type AND s.variant = l.k % CASE l.event_type {" ".join(f"WHEN '{t}' THEN {n}" for t, n in VARIANTS.items())} END),
rows_ AS (SELECT * FROM told WHERE NOT (event_type = 'purchase' AND variant = 2)),
flags AS (
  SELECT *, event_type IN ('click', 'view') AS step, event_type IN ('click', 'view') OR (event_type = 'purchase' AND variant = 3) AS agent,
    event_type = 'signup' AND NOT contains(path, '/subagents/') AND NOT {_has("words", catalog.LEADING_TAG)} AS typed,
    {_has("words", catalog.EMPTY_SEEN)} AS seen FROM rows_),
context AS (
  SELECT *,
    coalesce(last_value(CASE WHEN header THEN 'h' || CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY stem ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), stem) AS session_id,
    coalesce(last_value(CASE WHEN header THEN 'h' || CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER w, stem) AS last_session,
    coalesce(last_value(CASE WHEN header THEN '/work/p' || CAST(k % 5 AS VARCHAR) END IGNORE NULLS) OVER w, '') AS cwd,
    min(ts) OVER w AS started, max(ts) OVER w AS ended,
    bool_or(agent) OVER (PARTITION BY stem ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS responded,
    coalesce(bool_or(typed) OVER (PARTITION BY stem ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS typed_before,
    coalesce(bool_or(typed) OVER (PARTITION BY stem, event_type, words ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS said_before,
    min(CASE WHEN step THEN line END) OVER (PARTITION BY stem ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line
  FROM flags WINDOW w AS (PARTITION BY stem ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bound AS (
  SELECT c.*, n.seen AS next_seen,
    CASE WHEN c.event_type = 'click' THEN c.tool ELSE last_value(CASE WHEN c.event_type = 'click' THEN c.tool END IGNORE NULLS) OVER earlier END AS call_tool,
    CASE WHEN c.event_type = 'click' THEN c.command ELSE last_value(CASE WHEN c.event_type = 'click' THEN c.command END IGNORE NULLS) OVER earlier END AS call_command
  FROM context c LEFT JOIN context n ON n.stem = c.stem AND n.line = c.next_line
  WINDOW earlier AS (PARTITION BY c.stem, c.call_id, c.event_type NOT IN ('click', 'error') AND NOT (c.event_type = 'purchase' AND c.variant = 1) ORDER BY c.line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
facts AS (
  SELECT *, (event_type = 'error' OR (event_type = 'purchase' AND variant = 1)) AND call_tool IS NOT NULL AS is_result, string_split(call_command, ' ') AS cw,
    CASE WHEN call_command LIKE 'echo%' OR call_command IS NULL OR (source = 'claude' AND call_tool <> 'Bash') THEN [] ELSE list_sort(list_distinct(regexp_extract_all(call_command, '[a-z]+-pp-cli'))) END AS clis,
    {_has("words", catalog.BAD_EXIT)} AS bad, {_has("words", catalog.GOOD_EXIT)} AS good, {_has("words", catalog.HANG_WORDS)} AS stalled, {_has("words", catalog.FAILURE_WORDS)} AS worded,
    trim(regexp_replace(regexp_replace(words, {_text(catalog.RUNNER_HEAD)}, ''), {_text(catalog.EXIT_HEAD)}, ''), ' ' || chr(10)) AS body,
    source = 'codex' OR call_tool = 'Bash' AS bash FROM bound),
judged AS (
  SELECT *, is_result AND words <> '' AND CASE WHEN flag IS NOT NULL THEN flag WHEN len(clis) > 0 OR call_tool LIKE 'mcp@_@_%' ESCAPE '@' OR bad THEN bad ELSE NOT good AND worded END AS failed,
    CASE WHEN call_tool LIKE 'mcp@_@_%' ESCAPE '@' THEN len(list_intersect(string_split(string_split(call_tool, '__')[-1], '_'), {"[" + ", ".join(map(_text, sorted(catalog.MUTATION_VERBS))) + "]"})) = 0
      WHEN call_command = '' OR contains(call_command, ';') OR contains(call_command, '&&') THEN false
      WHEN cw[1] IN {_in(catalog.EMPTY_IGNORE)} OR cw[2] IN {_in(catalog.MUTATION_VERBS)} OR cw[3] IN {_in(catalog.MUTATION_VERBS)} THEN false
      WHEN cw[1] = 'curl' THEN NOT list_contains(cw, '-d') AND NOT list_contains(cw, '-o')
      ELSE len(clis) > 0 OR list_contains(cw, '--json') OR (cw[1] = 'psql' AND list_contains(cw, '-c')) OR cw[1] IN {_in(catalog.FETCH_VERBS)} OR cw[2] IN {_in(catalog.FETCH_VERBS)} OR coalesce(cw[3] IN {_in(catalog.FETCH_VERBS)}, false) END AS wants
  FROM facts),
found AS (
  SELECT *, is_result AND NOT failed AND words <> '' AND bash AND stalled AND NOT good AND NOT {_has("words", catalog.COMPLETED)} AND NOT (contains(call_command, '--help') AND NOT {_has("words", catalog.STRONG_FRICTION)}) AS hung,
    is_result AND NOT bad AND NOT worded AND NOT stalled AND NOT coalesce(flag, false) AND len(clis) <= 1 AND wants AND next_line IS NOT NULL AND NOT next_seen AND (body = '' OR {_has("body", catalog.EMPTY_SHAPE)}) AS quiet,
    CASE WHEN NOT (failed AND bash) THEN [] WHEN len(clis) <= 1 THEN clis ELSE blamed END AS blamed_clis
  FROM (SELECT *, CASE WHEN len(near) = 0 AND source = 'claude' THEN clis ELSE near END AS blamed FROM (SELECT *,
    list_filter(clis, lambda c: len(list_filter(range(1, len(string_split(words, chr(10))) + 1), lambda i: contains(string_split(words, chr(10))[i], c)
      AND regexp_matches(array_to_string(string_split(words, chr(10))[greatest(i - 1, 1):i + 2], chr(10)), {_text("(?:" + catalog.BAD_EXIT + ")|(?:" + catalog.CLI_FRICTION + ")")}))) > 0) AS near FROM judged))),
seen_ AS (
  SELECT 'slash' AS list, u.entity, '{catalog.SLASH}' AS kind, '/' || u.entity AS words, '' AS tool_name, '' AS command, session_id AS session, 0 AS phase, 0 AS sub, u.n - 1 AS pos, 0 AS cli_pos, f.* EXCLUDE (words, command, session_id)
    FROM found f, LATERAL (SELECT unnest(x) AS entity, generate_subscripts(x, 1) AS n FROM (SELECT regexp_extract_all(f.words, {_text(catalog.SLASH_COMMAND)}, 1) AS x)) u WHERE event_type = 'signup'
  UNION ALL BY NAME SELECT 'correction' AS list, '' AS entity, '{catalog.CORRECTION}' AS kind, words, '' AS tool_name, '' AS command, session_id AS session, 0 AS phase, 1 AS sub, 0 AS pos, 0 AS cli_pos, * EXCLUDE (words, command, session_id)
    FROM found WHERE typed AND responded AND typed_before AND NOT said_before AND len(regexp_extract_all(words, {_text(catalog.CLOCK)})) < 2
      AND ((length(words) <= 2000 AND {_has("left(words, 360)", catalog.STRONG_CUE)}) OR (length(words) <= 400 AND {_has("left(words, 360)", catalog.WEAK_CUE)}))
  UNION ALL BY NAME SELECT 'call' AS list, '' AS entity, 'call' AS kind, '' AS words, call_tool AS tool_name, call_command AS command, session_id AS session, 0 AS phase, 2 AS sub, 0 AS pos, 0 AS cli_pos, * EXCLUDE (words, command, session_id) FROM found WHERE event_type = 'click'
  UNION ALL BY NAME SELECT 'skill' AS list, 'skill' || CAST(event_id % 5 AS VARCHAR) AS entity, '{catalog.SKILL}' AS kind, 'Skill(skill' || CAST(event_id % 5 AS VARCHAR) || ')' AS words, 'Skill' AS tool_name, '' AS command, session_id AS session, 0 AS phase, 2 AS sub, 0 AS pos, 0 AS cli_pos, * EXCLUDE (words, command, session_id) FROM found WHERE tool = 'Skill' AND source = 'claude'
  UNION ALL BY NAME SELECT 'cli' AS list, u.entity, '{catalog.INVOCATION}' AS kind, call_command AS words, call_tool AS tool_name, call_command AS command, session_id AS session, 0 AS phase, 2 AS sub, 0 AS pos, u.n - 1 AS cli_pos, f.* EXCLUDE (words, command, session_id)
    FROM found f, LATERAL (SELECT unnest(f.clis) AS entity, generate_subscripts(f.clis, 1) AS n) u WHERE event_type = 'click'
  UNION ALL BY NAME SELECT 'failure' AS list, '' AS entity, '{catalog.FAILURE}' AS kind, words, call_tool AS tool_name, call_command AS command, session_id AS session, 0 AS phase, 2 AS sub, 0 AS pos, 0 AS cli_pos, * EXCLUDE (words, command, session_id) FROM found WHERE failed
  UNION ALL BY NAME SELECT 'cli' AS list, u.entity, '{catalog.FAILURE}' AS kind, words, call_tool AS tool_name, call_command AS command, session_id AS session, 0 AS phase, 2 AS sub, 0 AS pos, u.n - 1 AS cli_pos, f.* EXCLUDE (words, command, session_id)
    FROM found f, LATERAL (SELECT unnest(f.blamed_clis) AS entity, generate_subscripts(f.blamed_clis, 1) AS n) u WHERE failed
  UNION ALL BY NAME SELECT 'cli' AS list, u.entity, '{catalog.HANG}' AS kind, words, 'Bash' AS tool_name, call_command AS command, session_id AS session, 0 AS phase, 2 AS sub, 0 AS pos, u.n - 1 AS cli_pos, f.* EXCLUDE (words, command, session_id)
    FROM found f, LATERAL (SELECT unnest(f.clis) AS entity, generate_subscripts(f.clis, 1) AS n) u WHERE hung
  UNION ALL BY NAME SELECT 'empty' AS list, '' AS entity, '{catalog.EMPTY}' AS kind, coalesce(nullif(body, ''), '(empty stdout)') AS words, call_tool AS tool_name, call_command AS command, last_session AS session, 1 AS phase, 2 AS sub, 0 AS pos, 0 AS cli_pos, * EXCLUDE (words, command, session_id) FROM found WHERE quiet
  UNION ALL BY NAME SELECT 'cli' AS list, u.entity, '{catalog.EMPTY}' AS kind, coalesce(nullif(body, ''), '(empty stdout)') AS words, call_tool AS tool_name, call_command AS command, last_session AS session, 1 AS phase, 2 AS sub, 0 AS pos, u.n - 1 AS cli_pos, f.* EXCLUDE (words, command, session_id)
    FROM found f, LATERAL (SELECT unnest(f.clis) AS entity, generate_subscripts(f.clis, 1) AS n) u WHERE quiet),
shown AS (
  SELECT list, entity, kind, source, path, stem, line, session AS session_id, tool_name, {_shown("command", catalog.COMMAND_CHARS)} AS command, {_shown("words", catalog.EXCERPT_CHARS)} AS excerpt,
    strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS occurred_at, ts, session_ord, phase, sub, pos, cli_pos, last_session, cwd, started, ended FROM seen_),
ev AS (SELECT * FROM shown WHERE path IN (SELECT path FROM shown WHERE list <> 'call'))
"""
ORDER_SQL = "session_ord, phase, line, sub, pos, cli_pos"
REF_SQL = "source || ':' || path || ':' || CAST(line AS VARCHAR) || ':' || kind"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = EVIDENCE + sql
        return f

    return add


@query("SELECT list, entity, kind, source, path, line, session_id, tool_name, command, excerpt, occurred_at FROM ev")
def mined_evidence(spark, sf_dir):
    """All that the detectors see."""
    return mined(spark, sf_dir)[1].select("list", "entity", "kind", "source", "path", "line", "session_id", "tool_name", "command", "excerpt", "occurred_at")


@query("""SELECT source, path, any_value(last_session) AS session_id, any_value(cwd) AS cwd, strftime(any_value(started), '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at, strftime(any_value(ended), '%Y-%m-%dT%H:%M:%S.%fZ') AS ended_at,
  count(*) FILTER (list = 'call') AS tool_call_count, coalesce(array_to_string(list_sort(list_distinct(list(entity) FILTER (list = 'cli'))), ','), '') AS clis, coalesce(array_to_string(list_sort(list_distinct(list(entity) FILTER (list = 'skill'))), ','), '') AS skills,
  coalesce(array_to_string(list_sort(list_distinct(list(entity) FILTER (list = 'slash'))), ','), '') AS slashes, count(*) FILTER (list = 'failure') AS failure_count, count(*) FILTER (list = 'empty') AS silent_empty_count, count(*) FILTER (list = 'correction') AS correction_count
FROM ev GROUP BY source, path""")
def session_index(spark, sf_dir):
    """One row per file that has a signal."""
    names = lambda c: F.array_join(c, ",")
    return mined(spark, sf_dir)[2].select("source", "path", "session_id", "cwd", "started_at", "ended_at", "tool_call_count", names("pp_cli_names").alias("clis"), names("skill_names").alias("skills"), names("slash_commands").alias("slashes"), "failure_count", "silent_empty_count", "correction_count")


@query("""SELECT source, count(*) AS files, CAST(sum(calls) AS BIGINT) AS tool_calls, count(*) >= 5 AND sum(calls) = 0 AS stale
FROM (SELECT source, path, count(*) FILTER (event_type = 'click') AS calls FROM told GROUP BY source, path) GROUP BY source""")
def scan_health(spark, sf_dir):
    """Files and calls by dialect, and whether its parser may be stale."""
    files = rendered(spark, sf_dir).select("source", "path").distinct()
    stats = parse_stats(mined(spark, sf_dir)[0], files)
    stale = health_warnings(stats).select("source", F.lit(True).alias("stale"))
    return stats.join(stale, "source", "left").select("source", "files", "tool_calls", F.coalesce("stale", F.lit(False)).alias("stale"))


def _kept(name: str, rows: str, group: str, order: str, route: str, kind: str, target: str) -> str:
    """name: group, refs, n_kept, kept_sessions, latest and the key of the first twelve rows of each group."""
    return f"""
{name}_kept AS (SELECT {group} AS name, count(*) AS n_kept, count(DISTINCT session_id) AS kept_sessions, max(ts) AS latest,
    left(sha256('{route}' || chr(0) || '{kind}' || chr(0) || {target} || chr(0) || string_agg({REF_SQL}, chr(0) ORDER BY nth)), 20) AS proposal_key
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS nth FROM {rows}) WHERE nth <= {catalog.KEPT_EVIDENCE} GROUP BY {group})"""


BETWEEN, HEAD_END = r"\s*(?:&&|\|\||;|\|)\s*", r"&&|\|\||;|\|"
FRICTION = """count(*) FILTER (list = 'failure') AS failures, count(*) FILTER (list = 'empty') AS empties, count(DISTINCT CASE WHEN list = 'failure' THEN session_id END) AS failure_sessions,
    count(DISTINCT CASE WHEN list = 'empty' THEN session_id END) AS empty_sessions, count(DISTINCT session_id) AS n_sessions"""
PROPOSALS = (
    f""",
cli AS (SELECT *, CASE kind WHEN '{catalog.FAILURE}' THEN 1 WHEN '{catalog.HANG}' THEN 2 WHEN '{catalog.EMPTY}' THEN 3 ELSE 4 END AS rank FROM ev WHERE list = 'cli' AND NOT (kind = '{catalog.EMPTY}' AND contains(path, '/subagents/'))),
uses AS (SELECT path, entity, session_id, count(*) FILTER (rank = 4) AS uses, bool_or(rank < 4) AS trouble FROM cli GROUP BY ALL),
shapes AS (SELECT path, entity, session_id, trim(regexp_extract(rest, '^([^-]*)', 1)) AS sub, list_sort(list_distinct(regexp_extract_all(rest, '--[a-z]+'))) AS flags
  FROM (SELECT *, regexp_extract(command, entity || '([^;&]*)', 1) AS rest FROM cli WHERE rank = 4)),
varied AS (SELECT DISTINCT path, entity, session_id FROM shapes WHERE sub <> '' GROUP BY path, entity, session_id, sub HAVING count(DISTINCT flags) > 1),
retried AS (SELECT entity, max(uses) AS retries FROM uses LEFT JOIN (SELECT *, true AS varied FROM varied) USING (path, entity, session_id) WHERE uses >= {catalog.RETRIES} AND (trouble OR varied) GROUP BY entity),
tool_sums AS (SELECT entity AS name, count(*) FILTER (rank = 1) AS f, count(*) FILTER (rank = 2) AS h, count(*) FILTER (rank = 3) AS e, coalesce(any_value(retries), 0) AS r FROM cli LEFT JOIN retried USING (entity) GROUP BY entity),"""
    + _kept("tool", "cli", "entity", f"rank, {ORDER_SQL}", "tool", "tool", "entity")
    + f""",
tools AS (SELECT 0 AS gen_route, 'tool' AS route, 'tool' AS target_kind, name AS target_name, 'Review ' || name || ' friction from real CLI use' AS title,
    name || ': ' || concat_ws(', ', CASE WHEN f > 0 THEN CAST(f AS VARCHAR) || ' failure signal(s)' END, CASE WHEN h > 0 THEN CAST(h AS VARCHAR) || ' hang/timeout signal(s)' END, CASE WHEN e > 0 THEN CAST(e AS VARCHAR) || ' swallowed empty result(s)' END,
      CASE WHEN r > 0 THEN 'retried up to ' || CAST(r AS VARCHAR) || 'x in one session before it worked' END) || ' across ' || CAST(kept_sessions AS VARCHAR) || ' session(s).' AS summary, n_kept, latest, proposal_key
  FROM tool_sums JOIN tool_kept USING (name) WHERE f + h + e + r > 0),
used AS (SELECT path, entity, min(line) AS first_line FROM ev WHERE list = 'skill' GROUP BY path, entity),
after_use AS (SELECT e.* EXCLUDE (entity), u.entity FROM ev e JOIN used u ON e.path = u.path AND e.line > u.first_line WHERE e.list = 'correction'),
skill_rows AS (SELECT *, 1 AS turn FROM after_use UNION ALL BY NAME SELECT *, 0 AS turn FROM ev WHERE list = 'skill' AND (path, entity) IN (SELECT path, entity FROM after_use)),
skill_sums AS (SELECT entity AS name, count(DISTINCT session_id) AS n FROM skill_rows GROUP BY entity),"""
    + _kept("skill", "skill_rows", "entity", "session_ord, turn, phase, line, sub, pos, cli_pos", "skill_improvement", "skill", "entity")
    + f""",
skills AS (SELECT 1 AS gen_route, 'skill_improvement' AS route, 'skill' AS target_kind, name AS target_name, 'Review ' || name || ' skill after user correction' AS title,
    'The ' || name || ' skill was invoked in ' || CAST(n AS VARCHAR) || ' session(s) that also contained user correction signal(s).' AS summary, n_kept, latest, proposal_key FROM skill_sums JOIN skill_kept USING (name)),
memory_rows AS (SELECT * FROM (SELECT *, coalesce(nullif(cwd, ''), 'unknown-project') AS project, row_number() OVER (PARTITION BY path ORDER BY {ORDER_SQL}) AS own FROM ev WHERE list = 'correction' AND path NOT IN (SELECT path FROM ev WHERE list = 'skill')) WHERE own <= {catalog.CORRECTIONS_A_SESSION}),
memory_sums AS (SELECT project AS name, count(*) AS n FROM memory_rows GROUP BY project),"""
    + _kept("memory", "memory_rows", "project", ORDER_SQL, "memory_context", "memory_or_runbook", "project")
    + f""",
memory AS (SELECT 2 AS gen_route, 'memory_context' AS route, 'memory_or_runbook' AS target_kind, name AS target_name, 'Review durable corrections for ' || string_split(name, '/')[-1] AS title,
    CAST(n AS VARCHAR) || ' correction signal(s) in sessions under ' || name || ' were not tied to a specific invoked skill.' AS summary, n_kept, latest, proposal_key FROM memory_sums JOIN memory_kept USING (name)),
trouble AS (SELECT *, CAST(list = 'empty' AS INTEGER) AS rank FROM ev WHERE list IN ('failure', 'empty') AND NOT contains(path, '/subagents/')),
backlog_rows AS (SELECT * FROM (SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array(command, {_text(BETWEEN)}), lambda p: string_split(p, ' ')[1]), lambda x: x NOT IN {_in(catalog.BACKLOG_IGNORE)} AND NOT starts_with(x, '-') AND NOT starts_with(x, '<'))[1], '') AS program FROM trouble
  WHERE (list = 'failure' AND {_has("excerpt", catalog.TOOLING_FRICTION)}) OR (list = 'empty' AND NOT starts_with(tool_name, 'mcp__'))) WHERE program <> '' AND NOT ends_with(program, '{catalog.TRACKED_SUFFIX}')),
backlog_sums AS (SELECT program AS name, {FRICTION} FROM backlog_rows GROUP BY program HAVING (failures >= 3 AND failure_sessions >= 2) OR (empties >= 3 AND empty_sessions >= 2)),"""
    + _kept("backlog", "backlog_rows", "program", f"rank, {ORDER_SQL}", "backlog", "tooling", "program")
    + f""",
backlog AS (SELECT 3 AS gen_route, 'backlog' AS route, 'tooling' AS target_kind, name AS target_name, 'Investigate repeated ' || name || ' command friction' AS title,
    name || ' had ' || concat_ws(', ', CASE WHEN failures > 0 THEN CAST(failures AS VARCHAR) || ' command-interface failure(s)' END, CASE WHEN empties > 0 THEN CAST(empties AS VARCHAR) || ' swallowed empty result(s)' END) || ' across ' || CAST(n_sessions AS VARCHAR) || ' session(s).' AS summary, n_kept, latest, proposal_key
  FROM backlog_sums JOIN backlog_kept USING (name)),
server_rows AS (SELECT *, string_split(tool_name, '__')[2] AS server FROM trouble WHERE starts_with(tool_name, 'mcp__')),
server_sums AS (SELECT server AS name, {FRICTION}, list_sort(list_distinct(list(tool_name))) AS names FROM server_rows GROUP BY server HAVING failures + empties >= 3 AND n_sessions >= 2),"""
    + _kept("server", "server_rows", "server", f"rank, {ORDER_SQL}", "tool", "mcp_server", "'mcp:' || server")
    + """,
servers AS (SELECT 4 AS gen_route, 'tool' AS route, 'mcp_server' AS target_kind, 'mcp:' || name AS target_name, 'Review mcp:' || name || ' friction from real use' AS title,
    'MCP server ' || name || ': ' || concat_ws(', ', CASE WHEN failures > 0 THEN CAST(failures AS VARCHAR) || ' failed tool call(s)' END, CASE WHEN empties > 0 THEN CAST(empties AS VARCHAR) || ' swallowed empty result(s)' END) || ' across ' || CAST(n_sessions AS VARCHAR) || ' session(s) ('
      || array_to_string(names[1:4], ', ') || CASE WHEN len(names) > 4 THEN '...' ELSE '' END || ').' AS summary, n_kept, latest, proposal_key FROM server_sums JOIN server_kept USING (name)),
props AS (SELECT * FROM tools UNION ALL BY NAME SELECT * FROM skills UNION ALL BY NAME SELECT * FROM memory UNION ALL BY NAME SELECT * FROM backlog UNION ALL BY NAME SELECT * FROM servers)
"""
)
SHOWN = "strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest, CAST(n_kept AS INTEGER) AS n_kept"


def _route(number: int) -> str:
    return PROPOSALS + f"SELECT route, target_kind, target_name, title, summary, proposal_key, {SHOWN} FROM props WHERE gen_route = {number}"


def _proposals(rows: DataFrame) -> DataFrame:
    return rows.select("route", "target_kind", "target_name", "title", "summary", "proposal_key", F.date_format("latest_evidence", "yyyy-MM-dd HH:mm:ss").alias("latest"), F.size("evidence").alias("n_kept"))


@query(_route(0))
def tool_friction(spark, sf_dir):
    """Tracked tools that fail, hang, come back empty or are retried."""
    return _proposals(routes.tools(mined(spark, sf_dir)[1], SETTINGS, None))


@query(_route(1))
def skill_corrections(spark, sf_dir):
    """Skills whose sessions hold corrections after their first use."""
    return _proposals(routes.skills(mined(spark, sf_dir)[1]))


@query(_route(2))
def project_corrections(spark, sf_dir):
    """Corrections by project where no skill was in use, three of a session."""
    _, found, index = mined(spark, sf_dir)
    return _proposals(routes.memory(found, index))


@query(_route(3))
def backlog_friction(spark, sf_dir):
    """Other programs that fail or come back empty again and again."""
    return _proposals(routes.backlog(mined(spark, sf_dir)[1], SETTINGS))


@query(_route(4))
def mcp_friction(spark, sf_dir):
    """Tool servers whose calls fail or come back empty three times in two sessions."""
    return _proposals(routes.servers(mined(spark, sf_dir)[1], SETTINGS))


def improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, index = mined(spark, sf_dir)
    return _once(spark, sf_dir, "improvements", lambda: (shared.keep(propose(spark, found, index, SETTINGS), "proposals"),))[0].withColumn("latest_evidence_at", F.col("latest_evidence"))


@query(PROPOSALS + "SELECT CAST(gen_route AS INTEGER) AS gen_route, target_name, proposal_key FROM (SELECT *, row_number() OVER (PARTITION BY proposal_key ORDER BY gen_route, target_name) AS nth FROM props) WHERE nth = 1")
def improvement_proposals(spark, sf_dir):
    """All routes in their order, each key once."""
    return improvements(spark, sf_dir).select("gen_route", "target_name", "proposal_key")


#: What earlier runs left: (target, decision, time of it) and (target, number, run).
RESOLVED = (("tool:mcp:s1", "fixed", "2000-01-01T00:00:00+00:00"), ("tool:mcp:s2", "fixed", "2999-01-01T00:00:00+00:00"), ("tool:mcp:s3", "ignored", "2000-01-01T00:00:00+00:00"), ("tool:alpha-pp-cli", "fixed", "2024-01-05T00:00:00+00:00"), ("backlog:psql", "wontfix", "2024-01-05T00:00:00+00:00"), ("tool:mcp:s9", "fixed", "2024-01-05T00:00:00+00:00"))
RUNS = (
    *(("tool:mcp:s1", n, r) for n, r in enumerate(("19990101T000000Z", "20010101T000000Z"))), *(("tool:mcp:s4", n, r) for n, r in enumerate(("r1", "20010101T000000Z", "20010102T000000Z"))), *(("tool:mcp:s5", d, f"200101{d + 1:02d}T000000Z") for d in range(12)),
    *(("tool:alpha-pp-cli", n, r) for n, r in enumerate(("r1", "20240104T000000Z", "20240106T000000Z"))), *(("backlog:kubectl", n, r) for n, r in enumerate(("20240104T000000Z", "20240106T000000Z"))),
)
THIS_RUN = "20300101T000000Z"
JUDGED = (
    PROPOSALS
    + f""",
resolved(target, decision, fixed_at) AS (VALUES {", ".join(f"('{t}', '{d}', TIMESTAMP '{at[:19].replace('T', ' ')}')" for t, d, at in RESOLVED)}),
runs(target, nth, run_id) AS (VALUES {", ".join(f"('{t}', {n}, '{r}')" for t, n, r in RUNS)}),
prior AS (SELECT target, count(*) AS n FROM runs LEFT JOIN resolved USING (target) WHERE fixed_at IS NULL OR try_strptime(run_id, '%Y%m%dT%H%M%SZ') > fixed_at GROUP BY target),
known AS (SELECT min(proposal_key) AS key FROM props WHERE gen_route = 3),
settling AS (SELECT p.*, p.route || ':' || target_name AS target, decision, fixed_at, coalesce(n, 0) AS prior, coalesce(decision = 'fixed' AND date_trunc('second', latest) > fixed_at, false) AS regression, proposal_key IN (SELECT key FROM known) AS known
  FROM props p LEFT JOIN resolved r ON r.target = p.route || ':' || target_name LEFT JOIN prior ON prior.target = p.route || ':' || target_name)
"""
)


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(history, proposals with recurrence and disposition) under the state above; the least key of the backlog is known."""
    runs: dict[str, list[str]] = {}
    for target, _, run_id in RUNS:
        runs.setdefault(target, []).append(run_id)
    history = lifecycle.history_table(spark, {"target_run_history": runs})
    resolutions = lifecycle.resolution_table(spark, {t: {"decision": d, "resolved_at": at, "pr": "", "note": "", "by": ""} for t, d, at in RESOLVED})
    found = improvements(spark, sf_dir)
    known = found.where("gen_route = 3").agg(F.min("proposal_key").alias("key")).where("key IS NOT NULL")
    return history, lifecycle.disposition(lifecycle.recurrence(found, history, resolutions), resolutions, known)


@query(JUDGED + "SELECT target, regression, decision IS NOT NULL AND NOT regression AS settled, NOT known AND (decision IS NULL OR regression) AS emitted FROM settling")
def resolution_filter(spark, sf_dir):
    """Resolutions come before known keys: what is settled, what came back, what is new."""
    return judged(spark, sf_dir)[1].select("target", "regression", "settled", "emitted")


@query(JUDGED + """SELECT target, CAST(prior + 1 AS INTEGER) AS recurrence, summary || CASE WHEN prior > 0 THEN ' Recurring: also flagged in ' || CAST(prior AS VARCHAR) || ' previous run(s).' ELSE '' END
  || CASE WHEN regression THEN ' Regression after recorded fix (fixed ' || strftime(fixed_at, '%Y-%m-%dT%H:%M:%S+00:00') || ').' ELSE '' END AS summary, CAST(row_number() OVER (ORDER BY prior DESC, n_kept DESC, gen_route, target_name) AS INTEGER) AS place FROM settling""")
def recurrence_sort(spark, sf_dir):
    """How often each target was flagged before, and the order of review."""
    rows = lifecycle.ranked(judged(spark, sf_dir)[1]).select("target", F.col("recurrence").cast("int").alias("recurrence"), "summary")
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.monotonically_increasing_id())))  # a row per target


@query(JUDGED + f""", touched AS (SELECT target, nth, run_id FROM runs UNION ALL SELECT target, 1000, '{THIS_RUN}' FROM settling WHERE decision IS NULL OR regression),
kept_runs AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY nth DESC) AS back FROM touched)
SELECT target, run_id, CAST(row_number() OVER (PARTITION BY target ORDER BY nth) - 1 AS INTEGER) AS nth FROM kept_runs WHERE back <= {catalog.HISTORY_RUNS}""")
def history_last10(spark, sf_dir):
    """The runs on record after this one."""
    history, found = judged(spark, sf_dir)
    return lifecycle.history_after(history, found, THIS_RUN).select("target", "run_id", F.col("nth").cast("int").alias("nth"))


def _idea(rows: DataFrame) -> DataFrame:
    detail = lambda n: F.get_json_object("details", f"$.{n}")
    return rows.select("title", "summary", "proposal_key", F.size("evidence").alias("n_kept"), F.date_format("latest_evidence", "yyyy-MM-dd HH:mm:ss").alias("latest"), detail("recommendation").alias("recommendation"), F.round(detail("confidence").cast("double"), 2).alias("confidence"), (detail("private") == "true").alias("private"), detail("trigger").alias("trigger"))


def _idea_sql(rows: str, group: str, order: str, recommendation: str, confidence: str, trigger: str) -> str:
    """From rows with title and summary: one idea per group, keyed by all its evidence."""
    private = f"bool_or({_has("excerpt || ' ' || command", catalog.PRIVATE)})"
    demoted = f"{private} AND {recommendation} = 'write_now'"
    return f"""SELECT any_value(title) AS title, any_value(summary) AS summary, left(sha256('content_idea' || chr(0) || any_value(title) || chr(0) || string_agg({REF_SQL}, chr(0) ORDER BY {order})), 20) AS proposal_key,
  CAST(least(count(*), {catalog.KEPT_EVIDENCE}) AS INTEGER) AS n_kept, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, CASE WHEN {demoted} THEN 'needs_context' ELSE {recommendation} END AS recommendation,
  CASE WHEN {demoted} THEN least(0.72, {confidence}) ELSE CAST({confidence} AS DOUBLE) END AS confidence, {private} AS private, '{trigger}' AS trigger FROM {rows} GROUP BY {group}"""


PROFILES = ", ".join("(" + ", ".join((_text(n), _text(p[0]))) + ")" for n, p in catalog.SLASH_PROFILES.items())


@query(
    f""", profiles(entity, known) AS (VALUES {PROFILES}),
slash_sums AS (SELECT entity, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM ev WHERE list = 'slash' GROUP BY entity),
slash_rows AS (SELECT e.*, n_sessions, coalesce(known, 'How I use /' || entity || ' in real agent workflows') AS title, '/' || entity || ' appeared in ' || CAST(n AS VARCHAR) || ' transcript signal(s) across ' || CAST(n_sessions AS VARCHAR) || ' session(s), suggesting a repeatable agent workflow.' AS summary
  FROM ev e JOIN slash_sums USING (entity) LEFT JOIN profiles USING (entity) WHERE list = 'slash' AND (known IS NOT NULL OR n_sessions >= 2))
"""
    + _idea_sql("slash_rows", "entity", ORDER_SQL, "'write_now'", "CASE WHEN any_value(n_sessions) >= 2 THEN 0.82 ELSE 0.72 END", "slash_command_usage")
)
def slash_ideas(spark, sf_dir):
    """Slash commands worth writing about."""
    return _idea(content.slash_ideas(spark, mined(spark, sf_dir)[1]))


@query(
    f""", private_rows AS (SELECT *, {_text(catalog.PRIVATE_BUILD[0])} AS title, {_text(catalog.PRIVATE_BUILD[2])} AS summary FROM ev
  WHERE list = 'failure' AND {_has("excerpt || ' ' || command", catalog.PRIVATE)} AND {_has("excerpt || ' ' || command", catalog.BUILD)})
"""
    + _idea_sql("private_rows", "ALL", ORDER_SQL, "'needs_context'", str(catalog.PRIVATE_BUILD[7]), catalog.PRIVATE_BUILD[1]).replace(" GROUP BY ALL", " HAVING count(*) > 0")
)
def private_build(spark, sf_dir):
    """Failures while something private was built."""
    return _idea(content.private_build(mined(spark, sf_dir)[1]))


WORKFLOW_ROWS = f""", patterns(workflow, pattern, least, title, advice, sure, label) AS (VALUES {", ".join("(" + ", ".join((str(n), _text(w[1]), str(w[2]), _text(w[3]), _text(w[9]), str(w[10]), _text(w[11]))) + ")" for n, w in enumerate(catalog.WORKFLOWS))}),
hits AS (SELECT e.* EXCLUDE (kind, excerpt), '{catalog.WORKFLOW}' AS kind, command AS excerpt, p.* FROM ev e JOIN patterns p ON regexp_matches(e.command, p.pattern) WHERE list = 'call'),
workflow_sums AS (SELECT workflow, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM hits GROUP BY workflow),
workflow_rows AS (SELECT h.*, 'Matched ' || CAST(n AS VARCHAR) || ' command-level workflow signal(s) across ' || CAST(n_sessions AS VARCHAR) || ' session(s), suggesting a repeatable operating loop.' AS summary FROM hits h JOIN workflow_sums USING (workflow) WHERE n >= least)
"""


@query(WORKFLOW_ROWS + _idea_sql("workflow_rows", "workflow", ORDER_SQL, "any_value(advice)", "any_value(sure)", "workflow_command_cluster"))
def workflow_clusters(spark, sf_dir):
    """Calls that match a workflow's pattern often enough."""
    return _idea(content.workflow_ideas(content.workflow_rows(spark, mined(spark, sf_dir)[1])))


@query(
    WORKFLOW_ROWS
    + f""", marked AS (SELECT *, bool_or({_has("excerpt || ' ' || command", catalog.PRIVATE)}) OVER (PARTITION BY workflow) AS secret, row_number() OVER (PARTITION BY workflow ORDER BY {ORDER_SQL}) AS nth FROM workflow_rows),
three AS (SELECT * EXCLUDE (title, summary, excerpt, command, ts), CASE WHEN secret THEN {_text(catalog.HIDDEN)} ELSE excerpt END AS excerpt, CASE WHEN secret THEN {_text(catalog.HIDDEN)} ELSE command END AS command, TIMESTAMP '2024-06-01 00:00:00' AS ts FROM marked WHERE nth <= 3),
round_rows AS (SELECT *, {_text(catalog.ROUNDUP[0])} AS title, {_text(catalog.ROUNDUP[2])} || (SELECT string_agg(label, ', ' ORDER BY workflow) FROM (SELECT DISTINCT workflow, label FROM three)) AS summary FROM three WHERE (SELECT count(DISTINCT workflow) FROM three) >= 2)
"""
    + _idea_sql("round_rows", "ALL", "workflow, nth", "'write_now'", str(catalog.ROUNDUP[7]), catalog.ROUNDUP[1]).replace(" GROUP BY ALL", " HAVING count(*) > 0")
)
def workflow_roundup(spark, sf_dir):
    """One idea over the workflows, dated by their files."""
    return _idea(content.roundup(content.workflow_rows(spark, mined(spark, sf_dir)[1])))


def _ranking_sql(profile: tuple) -> str:
    lst, title, trigger, opening, prefix, *_, confidence = profile
    if lst == "executable":
        rows = f"SELECT * EXCLUDE (kind, excerpt), '{catalog.WORKFLOW}' AS kind, command AS excerpt FROM (SELECT *, string_split(trim(regexp_split_to_array(command, {_text(HEAD_END)})[1]), ' ')[1] AS name FROM ev WHERE list = 'call') WHERE name NOT IN {_in(catalog.CONTENT_IGNORE)} AND regexp_matches(name, '^[A-Za-z][A-Za-z0-9._-]*$')"
    else:
        rows = f"SELECT *, entity AS name FROM ev WHERE list = '{lst}'"
    return (
        f""", named AS ({rows}), ordered AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS met FROM named),
top AS (SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(met)) AS place FROM ordered GROUP BY name ORDER BY n DESC, min(met) LIMIT 10),
two AS (SELECT * FROM (SELECT o.*, place, row_number() OVER (PARTITION BY name ORDER BY met) AS nth FROM ordered o JOIN top USING (name)) WHERE nth <= 2 AND (SELECT count(*) FROM top) >= 3 ORDER BY place, nth LIMIT {catalog.KEPT_EVIDENCE}),
top_rows AS (SELECT *, {_text(title)} AS title, {_text(opening)} || (SELECT string_agg('{prefix}' || name || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY place) FROM top) AS summary FROM two)
"""
        + _idea_sql("top_rows", "ALL", "place, nth", "'write_now'", str(confidence), trigger).replace(" GROUP BY ALL", " HAVING count(*) > 0")
    )


def _ranking(number: int) -> Query:
    return lambda spark, sf_dir: _idea(content.ranking(mined(spark, sf_dir)[1], 8 + number, catalog.RANKINGS[number]))


for _number, _name in enumerate(("top_skills", "top_slash_commands", "top_programs")):
    QUERIES[_name], SQL[_name] = _ranking(_number), EVIDENCE + _ranking_sql(catalog.RANKINGS[_number])
