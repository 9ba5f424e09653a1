"""Transcripts that grow, mined line by line: what a file has said so far is kept as state, not read again.

Records are parsed and their calls told apart by the same expressions as in a batch scan. A stateful operator keyed by
file then holds what the windows of a scan look back at: the number of lines, the header so far, whether the agent and a
user have spoken, the digests of what users typed, the calls by their id. It also holds what has to wait: a result that may
turn out to be an empty one that nobody noticed comes out a second time, ``late``, when the next agent step of its file
shows that it went unnoticed. A timer settles files that have been quiet for long: what still waits is dropped (no step has
followed) and the state goes; should such a file grow again, it starts anew.

What only a file's end can tell (its last session id, directory and times) goes to a second table, a row for each batch
that touched the file; ``evidence_so_far`` joins the newest to the evidence. Both tables have a folder per batch, which a
batch that is run again writes anew, so a crash neither loses nor doubles a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.config import Settings
from tracemill.functions import text as tx
from tracemill.functions.shell import call_facts
from tracemill.operators import evidence, normalize
from tracemill.sources import transcripts
from tracemill.sources.growing import GrowingLines

CALL = "tool string, command string, clis array<string>, sole string, wants boolean"
HEADER = "lines int, sid string, cwd string, started_at string, ended_at string, agent boolean, typed boolean"
ITEM = "line int, ts string, session_id string, last_session_id string, cwd string, started_at string, ended_at string, sub int, pos int, call_id string, is_call boolean, skill string, output string, flag boolean, text string, eligible boolean"
OUT = f"path string, source string, mtime timestamp, header boolean, late boolean, {ITEM}, call {evidence.CALL}"
OUT_ROW, CALL_ROW = (Row(*(p.split(" ")[0] for p in ddl.split(", "))) for ddl in (OUT, CALL))
#: A file that nothing was added to for so long is settled.
QUIET_MS = 7 * 86400_000
#: The state store that such operators need: the value of spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def line_items(lines: DataFrame, settings: Settings) -> DataFrame:
    """What each line says and does, as rows; every line has one at least, so that lines can be counted.

    lines: source, path, mtime, at, raw. Calls come with what their command shows.
    """
    parsed = lines.withColumn("rec", F.try_parse_json(F.trim("raw"))).withColumnsRenamed({"at": "line"}).withColumn("session_ord", F.lit(0).cast("long"))
    known = tx.is_kind(F.col("rec"), "OBJECT")
    rows = normalize.marked(normalize.normalized(parsed.where(known)), settings)
    none = {n: F.lit(None).cast(t) for n, t in rows.dtypes if n not in normalize.KEYS}
    others = parsed.where(~known).select(*normalize.KEYS, *(c.alias(n) for n, c in none.items()))
    rows = rows.unionByName(others)
    said = F.coalesce("user_text", F.lit(""))
    listed = lambda name, kind: F.coalesce(name, F.array().cast(kind))
    rows = rows.withColumns({"calls": listed("calls", normalize.CALLS), "results": listed("results", normalize.RESULTS)})
    every = F.concat(F.array(evidence.item(-1, 0)), evidence.text_items(said), evidence.call_items(), evidence.result_items())
    rows = rows.select("source", "path", "mtime", F.col("line").alias("at"), "sid", "cwd_set", "ts", "agent", "typed", "own_step.seen", F.explode(every).alias("item"))
    rows = rows.select(*(c for c in rows.columns if c != "item"), "item.*")
    is_call = F.coalesce("is_call", F.lit(False))
    facts = call_facts(settings, F.when(is_call, F.col("tool")).otherwise(""), F.when(is_call, F.col("mode")).otherwise("none"), F.when(is_call, F.col("command")).otherwise(""))
    rows = rows.withColumn("facts", facts)
    return rows.select(*(c for c in rows.columns if c not in ("facts", "mode")), "facts.clis", "facts.sole", "facts.wants")


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] or name


class FileState(StatefulProcessor):
    """One file's lines, in order. Rows come sorted by nothing in particular, a batch at a time."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms
        ddl = T.StructType.fromDDL
        self.header_type, self.call_type, self.waiting_type = ddl(f"{HEADER}, source string, mtime timestamp"), ddl(CALL), ddl(f"{ITEM}, {CALL}")
        self.id_type, self.line_type = ddl("id string"), ddl("line int")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.header = handle.getValueState("header", self.header_type)
        self.calls = handle.getMapState("calls", self.id_type, self.call_type)
        self.words = handle.getMapState("words", self.id_type, self.line_type)
        self.waiting = handle.getListState("waiting", self.waiting_type)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        path = key[0]
        found = self.header.get() if self.header.exists() else None
        lines, sid, cwd, started, ended, agent, typed, source, mtime = found or (0, None, "", "", "", False, False, None, None)
        waiting = [tuple(r) for r in self.waiting.get()]
        held = len(waiting)
        before, at = False, None
        for r in sorted(rows, key=lambda r: (r.at, r.sub, r.pos)):
            if r.at != at:  # a new line; typed words count from the next one on
                typed = typed or before
                at, before, lines, source, mtime = r.at, bool(r.typed), lines + 1, r.source, r.mtime
                sid, cwd, started, ended = r.sid or sid, r.cwd_set or cwd, started or r.ts or "", r.ts or ended
                agent = agent or bool(r.agent)
                if r.seen is not None:  # an agent step
                    if not r.seen:
                        yield from (self._item(path, source, mtime, w[:16], True, w[16:]) for w in waiting)
                    waiting = []
            if r.sub < 0:
                continue
            own = (lines, r.ts, sid or _stem(path), sid or _stem(path), cwd, started, ended, r.sub, r.pos, r.call_id, r.is_call, r.skill, r.output, r.flag, r.text)
            if r.text:
                eligible = False
                digest = (hashlib.sha256(r.text.encode()).hexdigest(),)
                again = self.words.containsKey(digest)
                eligible = agent and typed and not again
                if r.typed and not again:
                    self.words.updateValue(digest, (lines,))
                yield self._item(path, source, mtime, (*own, eligible), False, (None,) * 5)
                continue
            if r.is_call:
                call = (r.tool, r.command, r.clis, r.sole, r.wants)
                if r.call_id:
                    self.calls.updateValue((r.call_id,), call)
            elif r.call_id and self.calls.containsKey((r.call_id,)):
                call = tuple(self.calls.getValue((r.call_id,)))
            else:
                continue
            yield self._item(path, source, mtime, (*own, False), False, call)
            if not r.is_call and call[4] and r.flag is not True:
                waiting.append((*own, False, *call))
        typed = typed or before
        self.header.update((lines, sid, cwd, started, ended, agent, typed, source, mtime))
        if waiting or held:
            self.waiting.put(waiting) if waiting else self.waiting.clear()
        self._settle_later(timerValues)
        yield self._header(path, source, mtime, lines, sid, cwd, started, ended)

    def _settle_later(self, times) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lines, sid, cwd, started, ended, _, _, source, mtime = self.header.get()
        for state in (self.header, self.calls, self.words, self.waiting):
            state.clear()
        yield self._header(key[0], source, mtime, lines, sid, cwd, started, ended)

    @staticmethod
    def _item(path, source, mtime, item, late, call) -> Row:
        return OUT_ROW(path, source, mtime, False, late, *item, None if call[0] is None else CALL_ROW(*call))

    @staticmethod
    def _header(path, source, mtime, lines, sid, cwd, started, ended) -> Row:
        return OUT_ROW(path, source, mtime, True, False, lines, None, None, sid or _stem(path), cwd, started, ended, *(None,) * 9, None)

    def close(self) -> None:
        pass


def mined_lines(lines: DataFrame, settings: Settings = Settings(), quiet_ms: int = QUIET_MS) -> DataFrame:
    """The items and headers of a stream of lines (source, path, mtime, at, raw); ``at`` ascends within a file."""
    items = line_items(lines, settings)
    return items.groupBy("path").transformWithState(FileState(quiet_ms), T.StructType.fromDDL(OUT), "Append", "ProcessingTime")


def found_by(items: DataFrame, settings: Settings) -> DataFrame:
    """The evidence in items as they came out of the state; of the late ones the empty results alone."""
    correction = F.coalesce(F.col("eligible") & tx.is_correction(F.col("text"), F.col("path"), settings), F.lit(False))
    step = F.when(F.col("late"), F.struct(F.col("line"), F.lit(False).alias("seen")))  # a step that took no notice
    rows = items.withColumns({"session_ord": F.lit(0).cast("long"), "next_step": step, "correction": correction})
    return evidence.found_in(rows, settings, ("late",)).where("NOT late OR phase = 1").drop("late")


def mine_growing(spark: SparkSession, root: str, source: str, store: str, checkpoint: str, settings: Settings = Settings(), quiet_ms: int = QUIET_MS, **options: str):
    """Mine what was added to the files under root since the last time; returns the finished query.

    Its tables are folders in ``store``. The session must keep its streaming state in ``STORE``.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", root)
    for name, value in options.items():
        reader = reader.option(name, value)
    lines = reader.load().withColumn("source", F.lit(source))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        found_by(rows.where("NOT header"), settings).write.mode("overwrite").parquet(f"{store}/evidence/batch={number}")
        rows.where("header").select("path", "source", "mtime", "last_session_id", *evidence.HEAD, F.col("line").alias("lines")).write.mode("overwrite").parquet(f"{store}/files/batch={number}")
        rows.unpersist()

    query = mined_lines(lines, settings, quiet_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def files_so_far(spark: SparkSession, store: str) -> DataFrame:
    """The newest row of each file."""
    rows = spark.read.parquet(f"{store}/files")
    names = [c for c in rows.columns if c not in ("path", "batch")]
    return rows.groupBy("path").agg(F.max_by(F.struct(*names), "batch").alias("f")).select("path", "f.*")


def evidence_so_far(spark: SparkSession, store: str) -> DataFrame:
    """The evidence of all lines so far, as a scan of the files would find it now."""
    found = spark.read.parquet(f"{store}/evidence")
    names = ["last_session_id", "mtime", *evidence.HEAD]
    files = files_so_far(spark, store).select("path", *names)
    kept = [c for c in found.columns if c not in (*names, "batch", "session_ord")]
    rows = found.select(*kept).join(files, "path")
    told = F.when(F.col("occurred_at") != "", F.col("event_time"))
    out = rows.withColumns({"session_id": F.when(F.col("phase") == 1, F.col("last_session_id")).otherwise(F.col("session_id")), "event_time": F.coalesce(told, "mtime", tx.path_time(F.col("path"))), "session_ord": F.unix_micros("mtime")})
    return out.select(*(c for c in found.columns if c != "batch"))
