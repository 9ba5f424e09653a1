"""One scan: files to records, evidence, proposals, and what is staged for review. Nothing is ever applied."""

from __future__ import annotations

import datetime as dt
import json
import sys
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import catalog
from tracemill.config import Settings
from tracemill.operators import content, evidence, normalize, routes
from tracemill.plans import lifecycle, packet, session_index
from tracemill.plans.commit import Commit, recover
from tracemill.sources import control, shared, transcripts

@dataclass(frozen=True)
class Options:
    homes: tuple[Path | str, ...]
    output: Path
    source: str = "all"
    route: str = "improvement"
    everything: bool = False
    since_days: float | None = None
    max_sessions: int = 0
    include_seen: bool = False
    include_resolved: bool = False
    full: bool = False
    source_tree: Path | None = None
    config: Path | None = None
    dry_run: bool = False


def since(options: Options, state: dict) -> dt.datetime | None:
    """All, else the last days asked for, else from the last scan on, else one day."""
    if options.everything:
        return None
    day = dt.timedelta(days=1)
    now = dt.datetime.now(dt.timezone.utc)
    if options.since_days is not None:
        return now - options.since_days * day
    return control.parse_time(state.get("last_scan_started_at")) or now - day


def mine(lines: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls of all files, evidence, session index) of numbered lines. Sessions without a signal leave the evidence.

    Anything but a call is a signal, so only calls are held against the index; a reader of another list opens its files alone.
    """
    rows = normalize.with_context(normalize.normalized(transcripts.records(lines)), settings)
    found = shared.keep(evidence.evidence(rows, settings), "evidence", ("list",))
    index = shared.keep(evidence.sessions(found), "sessions")
    calls = found.where("list = 'call'")
    return calls.select("path"), found.where("list <> 'call'").unionByName(calls.join(index.select("path"), "path", "left_semi")), index


def parse_stats(calls: DataFrame, files: DataFrame) -> DataFrame:
    """source, files, tool_calls, from a row per call and a row per file."""
    calls = calls.groupBy("path").agg(F.count("*").alias("n"))
    return files.join(calls, "path", "left").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("tool_calls"))


def health_warnings(stats: DataFrame, least: int = 5) -> DataFrame:
    """A source whose files read well and hold no call: its format may have moved on."""
    words = F.concat("source", F.lit(": "), F.col("files").cast("string"), F.lit(" transcript(s) scanned but 0 tool calls parsed - the parser may be stale for this source's current format."))
    return stats.where((F.col("files") >= least) & (F.col("tool_calls") == 0)).select("source", words.alias("warning"))


def propose(spark: SparkSession, found: DataFrame, index: DataFrame, settings: Settings, route: str = "improvement", tree: list[tuple[str, str]] | None = None) -> DataFrame:
    """Proposals of the routes asked for, each key once."""
    sources = None if tree is None else spark.createDataFrame(tree, "entity string, directory string")
    parts = []
    if route in ("all", "improvement"):
        parts.append(routes.improvements(found, index, settings, sources))
    if route in ("all", "content_idea"):
        parts.append(content.ideas(spark, found))
    return lifecycle.first_of_key(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0])


def document(row, created: str) -> dict:
    """A proposal as it is stored."""
    idea = row.route == "content_idea"
    out = {
        "schema_version": catalog.SCHEMA_VERSION, "proposal_id": f"{'content' if idea else 'imp'}-{row.proposal_key}", "proposal_key": row.proposal_key, "created_at": created,
        "latest_evidence_at": control.iso(row.latest_evidence_at.astimezone(dt.timezone.utc)), "status": "proposed", "route": row.route, "title": row.title, "summary": row.summary,
        "target": {"kind": row.target_kind, "name": row.target_name}, "evidence": [{k: e[k] for k in packet.EVIDENCE_FIELDS} for e in row.evidence], "suggested_action": row.suggested_action,
    }
    if idea:
        out = content.content_document(row, out)
    else:
        out |= {"impact": list(row.impact), "apply_policy": {"mode": "manual_approval_required", "notes": "A scan stages what it proposes; a person decides what becomes of it."}}
    if row.recurrence > 1:
        out["recurrence"] = row.recurrence
    if row.decision:
        out["resolution"] = {k: getattr(row, k) for k in ("decision", "resolved_at", "pr", "note", "by")}
    if row.regression:
        out["regression"] = {"target": row.target, "pr": row.pr, "fixed_at": row.resolved_at, "latest_evidence_at": out["latest_evidence_at"]}
    if row.settled and not row.suppressed:
        out["included_resolved"] = True
    return out


def run(spark: SparkSession, options: Options) -> int:
    """A whole scan; 2 if the registry of resolutions can't be read. The session's settings are left as they were."""
    with shared.settings_of(spark, spark__sql__session__timeZone="UTC", spark__sql__variant__allowDuplicateKeys="true"):
        return _run(spark, options)


def _run(spark: SparkSession, options: Options) -> int:
    settings = replace(Settings().with_overrides(control.load_config(options.config) if options.config else {}), full=options.full)
    if not options.dry_run:
        recover(options.output)  # what a crashed run has left is finished or dropped before its state is read
    state = control.load_state(options.output)
    try:
        resolutions = control.Registry.load(options.output).documents()
    except ValueError as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    begun, window = control.now(), since(options, state)  # the cursor is taken before the files are listed
    run_id = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    files = transcripts.choose(transcripts.discover(spark, list(options.homes), options.source), window, options.max_sessions)
    calls, found, index = mine(transcripts.read_lines(spark, files), settings)
    stats = parse_stats(calls, transcripts.file_table(files))
    n_files = files.files.count()
    warned = [r.warning for r in health_warnings(stats).orderBy("source").collect()]
    for warning in warned:
        print(f"warning: {warning}", file=sys.stderr)
    table = lifecycle.resolution_table(spark, resolutions)
    history = lifecycle.history_table(spark, state)
    detected = propose(spark, found, index, settings, options.route, control.source_tree(options.source_tree, settings.suffix))
    detected = lifecycle.recurrence(detected, history, table).withColumn("latest_evidence_at", F.coalesce("latest_evidence", F.lit(begun).cast("timestamp")))
    seen = spark.createDataFrame([(str(k),) for k in state.get("seen_proposal_keys") or []], "key string")
    judged = lifecycle.ranked(lifecycle.disposition(detected, table, seen, options.include_seen, options.include_resolved)).collect()  # proposals are few: a row per target
    documents = [(r, document(r, begun)) for r in judged]
    proposals = [d for r, d in documents if r.emitted]
    regressions = [d for r, d in documents if r.regression]
    suppressed = [{"proposal_id": d["proposal_id"], "target": r.target, "decision": r.decision, "resolved_at": r.resolved_at, "pr": r.pr} for r, d in documents if r.suppressed]
    ordered = index.orderBy("session_ord")
    n_sessions = index.count()
    result = {
        "schema_version": catalog.SCHEMA_VERSION, "run_id": run_id, "started_at": begun, "source": options.source, "since": window.isoformat() if window else None, "files_scanned": n_files,
        "sessions_with_signals": n_sessions, "proposal_count": len(proposals), "resolved_suppressed_count": len(suppressed), "resolved_suppressed_targets": sorted({s["target"] for s in suppressed}),
        "regression_count": len(regressions), "regressions": [{"proposal_id": d["proposal_id"], **d["regression"]} for d in regressions],
        "parse_stats": {r.source: {"files": r.files, "tool_calls": int(r.tool_calls)} for r in stats.collect()}, "parser_warnings": warned, "output_root": str(options.output),
    }
    if options.dry_run:
        print(json.dumps({**result, "proposals": proposals}, ensure_ascii=False, indent=2))
        return 0
    shown = [r.asDict() for r in ordered.select(*session_index.FIELDS).limit(catalog.PACKET_SESSIONS).collect()]
    commit = Commit(options.output, run_id)
    session_index.stage_new(spark, ordered, options.output, commit)
    for found_one in proposals:
        commit.write_json(f"proposals/{run_id}/{found_one['proposal_id']}.json", found_one)
    packet_place = f"review-packets/{run_id}.md"
    packet_path = options.output / packet_place
    commit.write_text(packet_place, packet.render(run_id, shown, n_sessions, proposals, warned, suppressed, regressions, options.full))
    after = lifecycle.history_after(history, spark.createDataFrame([(r.target, r.settled) for r in judged], "target string, settled boolean"), run_id).orderBy("target", "nth").collect()
    runs: dict[str, list[str]] = {}
    for r in after:
        runs.setdefault(r.target, []).append(r.run_id)
    state |= {"schema_version": catalog.SCHEMA_VERSION, "target_run_history": runs, "last_scan_started_at": begun, "last_run_id": run_id, "seen_proposal_keys": sorted({*state.get("seen_proposal_keys", []), *(d["proposal_key"] for d in proposals)})}
    commit.write_json("state.json", state)
    commit.write_json(f"runs/{run_id}.json", {**result, "review_packet": str(packet_path)})
    commit.finish()
    print(f"scanned={n_files} sessions_with_signals={n_sessions} proposals={len(proposals)}")
    print(f"resolved_suppressed={len(suppressed)} targets={','.join(result['resolved_suppressed_targets']) or '-'} regressions={len(regressions)}")
    print(f"review_packet={packet_path}")
    if proposals:
        print(f"proposal_dir={options.output / 'proposals' / run_id}")
    return 0
