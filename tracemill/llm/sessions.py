"""Sessions of clicks: cut where a client pauses, finishes, or has gone on for too long.

Whether a click starts a session because of its pause or of what came just before (a hard break) shows from its
predecessor alone. Whether it does because the session has lasted too long depends on where that session began, and so on
all before it. Clicks from one hard break to the next are an island. Each click points at the click that would start the
next session if a session started here: the first one of its island beyond the longest duration. (At a hard break that
pointer ends, for the break starts a session anyway.) The true starts are the heads of the islands and all that pointers
lead to from there; self-joins that double the pointers' reach mark them in a logarithmic number of rounds.

All clicks lie in one order by client, time and id, cut into range partitions wherever they fall, so that a client with
a third of all clicks is cut like any other. Among the clicks, each one also stands as a question at its time plus the
longest duration; the next click after the question is what it points at. A partition is packed into chunks of about
``CHUNK`` rows while it streams by. What crosses partitions (the last click, the last break) is one small row for each
partition, of which there are as many as ``spark.sql.shuffle.partitions`` says, whatever the input's size. Sessions that
cross chunks are put together from their pieces in order; a digest is updated piece by piece.

Defined results: rows without client, time or id are left out; of the rows that share an id one is taken, and where they
differ that of the least hash of all columns; a null arrival is timely, a null kind or value never final, a null, infinite
or undefined value counts as 0; equal times are ordered by id; other columns are ignored, whatever their names; an empty
table gives an empty result; a client with late clicks alone has no session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common
from tracemill.llm.interpolation import pack, unpack

MINUTE = 60_000_000
#: Rows of the order that are packed into one chunk, at least, but for a partition's last.
CHUNK = 1 << 14
CLICK, LATE, ASKS = 0, 1, 2
#: What is known of a pointer: that it holds, and that it leaves from a head; that it leaves from its partition's first
#: click; that it enters the partition from before; that it leads to the first click after the partition.
SURE, FROM_HEAD, FROM_FIRST, ENTERS, LEAVES = range(5)

POINTER = "struct<code: int, client: long, from_us: long, from: long, to: long>"
CHUNKS = f"part int, seq int, n int, first struct<client: long, us: long, id: long>, last struct<client: long, us: long, id: long, final: boolean>, head struct<us: long, id: long>, next struct<client: long, us: long>, before struct<client: long, n_late: long>, clicks array<binary>, pointers array<{POINTER}>"
PIECES = "part int, seq int, nth int, whole boolean, client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string, path string"
RESULT = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]


def micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds since 1970, the clock's own reading where it has no zone."""
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    since = F.col(name) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    whole = {"DAY": 86400 * 1_000_000, "HOUR": 3600 * 1_000_000, "MINUTE": MINUTE}
    return sum((F.extract(F.lit(u), since).cast("long") * n for u, n in whole.items()), (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long"))


def distinct_clicks(clicks: DataFrame, lateness: int, final_kinds: tuple[str, ...], final_value: float) -> DataFrame:
    """id, client, us, late, final, cents: one row for each click id."""
    value = F.col("value").cast("double")
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(1e16))
    rows = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("click_id").cast("long").alias("id"),
        F.col("client_id").cast("long").alias("client"),
        micros(clicks, "ts").alias("us"),
        F.coalesce(micros(clicks, "arrived_at") - micros(clicks, "ts") > lateness, F.lit(False)).alias("late"),
        F.coalesce((value >= final_value) & F.col("kind").isin(*final_kinds), F.lit(False)).alias("final"),
        F.when(sound, F.floor(value * 100 + 0.5)).otherwise(F.lit(0)).cast("long").alias("cents"),
    )
    names = rows.columns[1:]
    order = F.xxhash64(*names)
    return rows.groupBy("id").agg(*(F.min_by(n, order).alias(n) for n in names))


class _Partition:
    """Packs one sorted partition: rows come in pieces, chunks of clicks with their pointers go out."""

    def __init__(self, part: int, gap: int, longest: int):
        self.part, self.gap, self.longest = part, gap, longest
        self.seq, self.held = 0, None
        self.first = self.last = self.head = None  # first and last click; the last break that is sure
        self.lead: list[int] | None = None  # client and number of late clicks before the first click
        self.waiting = [np.empty(0, np.int64)] * 3  # questions that no click has followed yet: client, time and id of who asks

    def _points(self, client, us, ids, at, head_us, head_id, known, q) -> list:
        """Pointers from the questions q (client, time, id) to the clicks ``at``; head_*: the break before each click."""
        q_client, q_us, q_id = q
        same = client[at] == q_client
        after = lambda a_us, a_id: (q_us > a_us) | ((q_us == a_us) & (q_id >= a_id))
        sure = known[at]
        holds = same & sure & after(head_us[at], head_id[at])
        code = np.where((head_us[at] == q_us) & (head_id[at] == q_id), FROM_HEAD, SURE)
        f_us, f_id = (self.first[1], self.first[2]) if self.first else (0, 0)
        unsure = same & ~sure
        code = np.where(sure, code, np.where(~after(f_us, f_id), ENTERS, np.where((q_us == f_us) & (q_id == f_id), FROM_FIRST, SURE)))
        keep = holds | unsure
        return [code[keep], q_client[keep], q_us[keep], q_id[keep], ids[at][keep]]

    def add(self, client, us, kind, ids, cents, final) -> pa.RecordBatch | None:
        """The chunk before, once the click that follows it is known."""
        at = np.flatnonzero(kind == CLICK)
        n = len(at)
        late = np.flatnonzero(kind == LATE)
        owner = np.searchsorted(at, late) - 1
        early = late[owner < 0]
        if len(early):
            if self.held is not None:
                self.held["late"][-1] += int((client[early] == self.last[0]).sum())
            elif self.last is None:
                self.lead = self.lead or [int(client[early[0]]), 0]
                self.lead[1] += int((client[early] == self.lead[0]).sum())
        asks = np.flatnonzero(kind == ASKS)
        q = [np.concatenate([w, x]) for w, x in zip(self.waiting, (client[asks], us[asks] - self.longest, ids[asks]), strict=True)]
        to = np.concatenate([np.zeros(len(self.waiting[0]), np.int64), np.searchsorted(at, asks)])
        if n == 0:
            self.waiting = q
            return None
        c_client, c_us, c_id, c_final = client[at], us[at], ids[at], final[at]
        if self.first is None:
            self.first = (int(c_client[0]), int(c_us[0]), int(c_id[0]))
        before = self.last or (None, 0, 0, False)
        p_client, p_us, p_final = (np.r_[x, y[:-1]] for x, y in ((c_client[0] if before[0] is None else before[0], c_client), (before[1], c_us), (before[3], c_final)))
        hard = (p_client != c_client) | p_final.astype(bool) | (c_us - p_us >= self.gap)
        if before[0] is None:
            hard[0] = False  # not known here: it depends on the partitions before
        where = np.maximum.accumulate(np.where(hard, np.arange(n), -1))
        known = (where >= 0) | (self.head is not None)
        h_us = np.where(where >= 0, c_us[where], self.head[0] if self.head else 0)
        h_id = np.where(where >= 0, c_id[where], self.head[1] if self.head else 0)
        near = to < n
        pointers = self._points(c_client, c_us, c_id, to[near], h_us, h_id, known, [x[near] for x in q])
        self.waiting = [x[~near] for x in q]
        n_late = np.zeros(n, np.int64)
        mine = owner >= 0
        mine[mine] = client[late[mine]] == c_client[owner[mine]]
        np.add.at(n_late, owner[mine], 1)
        if known[-1]:
            self.head = (int(h_us[-1]), int(h_id[-1]))
        out = self._release((int(c_client[0]), int(c_us[0])))
        self.held = {"first": (int(c_client[0]), int(c_us[0]), int(c_id[0])), "head": self.head, "late": n_late, "arrays": [c_client, c_us, c_id, cents[at], c_final.astype(np.uint8), hard.astype(np.uint8)], "pointers": pointers}
        self.last = (int(c_client[-1]), int(c_us[-1]), int(c_id[-1]), bool(c_final[-1]))
        self.held["last"] = self.last
        return out

    def _release(self, following: tuple[int, int] | None) -> pa.RecordBatch | None:
        h, self.held = self.held, None
        if h is None:
            return None
        lead, self.lead = self.lead, None
        row = {"part": self.part, "seq": self.seq, "n": len(h["late"]), "first": dict(zip(("client", "us", "id"), h["first"], strict=True)) if h["first"] else None, "last": dict(zip(("client", "us", "id", "final"), h["last"], strict=True)) if h["last"] else None, "head": dict(zip(("us", "id"), h["head"], strict=True)) if h["head"] else None, "next": dict(zip(("client", "us"), following, strict=True)) if following else None, "before": dict(zip(("client", "n_late"), lead, strict=True)) if lead else None, "clicks": [pack(a) for a in (*h["arrays"], h["late"].astype(np.uint32))]}
        self.seq += 1
        columns = [pa.array([row[k]], _ARROW[k]) for k in row]
        code, *rest = h["pointers"]
        items = pa.StructArray.from_arrays([pa.array(code, pa.int32()), *(pa.array(x, pa.int64()) for x in rest[:3]), pa.array(rest[3], pa.int64(), mask=code == LEAVES)], ["code", "client", "from_us", "from", "to"])
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items))
        return pa.RecordBatch.from_arrays(columns, [*row, "pointers"])

    def finish(self) -> pa.RecordBatch | None:
        """The last chunk, with the questions that go to the first click after the partition."""
        if self.held is None and (self.lead or len(self.waiting[0])):
            none = np.empty(0, np.int64)
            self.held = {"first": None, "last": None, "head": None, "late": none, "arrays": [none] * 4 + [none.astype(np.uint8)] * 2, "pointers": [none] * 5}
        if self.held is not None:
            code = np.full(len(self.waiting[0]), LEAVES)
            self.held["pointers"] = [np.concatenate([a, b]) for a, b in zip(self.held["pointers"], (code, *self.waiting, np.zeros(len(code), np.int64)), strict=True)]
        return self._release(None)


_ARROW = {
    "part": pa.int32(), "seq": pa.int32(), "n": pa.int32(), "first": pa.struct({"client": pa.int64(), "us": pa.int64(), "id": pa.int64()}), "last": pa.struct({"client": pa.int64(), "us": pa.int64(), "id": pa.int64(), "final": pa.bool_()}),
    "head": pa.struct({"us": pa.int64(), "id": pa.int64()}), "next": pa.struct({"client": pa.int64(), "us": pa.int64()}), "before": pa.struct({"client": pa.int64(), "n_late": pa.int64()}), "clicks": pa.list_(pa.binary()),
}


def packed(rows: DataFrame, gap: int, longest: int, partitions: int) -> DataFrame:
    """The clicks as chunks, in range partitions of their order."""
    once = F.struct(F.col("us").alias("us"), F.when(F.col("late"), F.lit(LATE)).otherwise(F.lit(CLICK)).cast("byte").alias("kind"))
    asks = F.struct((F.col("us") + longest).alias("us"), F.lit(ASKS).cast("byte").alias("kind"))
    placed = rows.select("client", "id", "cents", "final", F.explode(F.when(F.col("late"), F.array(once)).otherwise(F.array(once, asks))).alias("at"))
    order = ["client", "us", "kind", "id"]
    placed = placed.select("client", "at.us", "at.kind", "id", F.when(F.col("at.kind") == CLICK, F.col("cents")).otherwise(F.lit(0)).cast("long").alias("cents"), "final")
    placed = placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]):
        state, got, size = _Partition(TaskContext.get().partitionId(), gap, longest), [], 0

        def flush():
            table = pa.Table.from_batches(got)
            return state.add(*(table.column(k).to_numpy() for k in range(6)))

        for batch in batches:
            got.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                if (out := flush()) is not None:
                    yield out
                got, size = [], 0
        if got and (out := flush()) is not None:
            yield out
        if (out := state.finish()) is not None:
            yield out

    return placed.mapInArrow(run, CHUNKS)


def _edges(chunks: DataFrame, gap: int) -> DataFrame:
    """For each partition, what it has to know of the others: whether its first click is a break, the last break before
    it, and the first click after it. One row a partition is all that is read here."""
    own = chunks.groupBy("part").agg(F.min_by("first", F.when(F.col("n") > 0, F.col("seq"))).alias("first"), F.max_by("last", F.when(F.col("n") > 0, F.col("seq"))).alias("last"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("seq"))).alias("head"), F.min(F.when(F.col("n") > 0, F.col("seq"))).alias("seq"))
    found = sorted(own.collect(), key=lambda r: r.part)
    last = head = None
    facts: dict[int, dict] = {}
    for r in found:
        facts[r.part] = fact = {"hard": True, "head_us": None, "head_id": None}
        if head:
            fact |= {"head_us": head.us, "head_id": head.id}
        if r.first is None:
            continue
        fact["hard"] = hard = last is None or last.client != r.first.client or last.final or r.first.us - last.us >= gap
        head = r.head or (r.first if hard else head)
        last = r.last
    rows, following = [], None
    for r in reversed(found):
        to = following
        f = facts[to.part] if to else {"hard": True, "head_us": None, "head_id": None}
        rows.append((r.part, facts[r.part]["hard"], facts[r.part]["head_us"], facts[r.part]["head_id"], *((to.part, to.seq, to.first.client, to.first.us, to.first.id) if to else (None,) * 5), f["hard"], f["head_us"], f["head_id"]))
        following = r if r.first is not None else following
    return chunks.sparkSession.createDataFrame(rows, "part int, hard boolean, head_us long, head_id long, n_part int, n_seq int, n_client long, n_us long, n_id long, n_hard boolean, n_head_us long, n_head_id long")


def pointers(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """from, to, part, seq, head: every pointer that holds, with the chunk it leads to and whether it leaves from a head."""
    p = chunks.select("part", "seq", F.inline("pointers")).join(edges, "part")
    code = F.col("code")
    leaves = code == LEAVES
    pick = lambda there, here: F.when(leaves, F.col(there)).otherwise(F.col(here))
    h_us, h_id = pick("n_head_us", "head_us"), pick("n_head_id", "head_id")
    reaches = ~pick("n_hard", "hard") & ((h_us < F.col("from_us")) | ((h_us == F.col("from_us")) & (h_id <= F.col("from"))))
    holds = F.when(code.isin(SURE, FROM_HEAD, FROM_FIRST), F.lit(True)).when(leaves, (F.col("client") == F.col("n_client")) & reaches).otherwise(reaches)
    head = F.when(code == SURE, F.lit(False)).when(code == FROM_HEAD, F.lit(True)).when(code == FROM_FIRST, F.col("hard")).otherwise((h_us == F.col("from_us")) & (h_id == F.col("from")))
    return p.where(holds).select("from", pick("n_id", "to").alias("to"), pick("n_part", "part").alias("part"), pick("n_seq", "seq").alias("seq"), head.alias("head"))


def marked_starts(links: DataFrame, tables: _common.Tables) -> DataFrame:
    """id, part, seq of every start that is no head: what chains of pointers lead to from the heads.

    Each round joins the pointers with themselves, which doubles their reach, and with the starts that are marked, which
    doubles how far along their chains these stand. A pointer that runs out of its island is gone.
    """
    links = tables.keep(links)
    starts = [links.where("head").select(F.lit(None).cast("long").alias("from"), "to", "part", "seq")]
    left = links.count()
    while left:
        marks = starts[0]
        for more in starts[1:]:
            marks = marks.unionByName(more)
        asked = links.select(F.col("to").alias("at"), "from").unionByName(marks.select(F.col("to").alias("at"), "from"))
        step = links.select(F.col("from").alias("at"), "to", "part", "seq")
        after = tables.keep(asked.join(step.hint("merge"), "at").select("from", "to", "part", "seq"))
        starts.append(after.where("from IS NULL"))
        links = after.where("from IS NOT NULL")
        left = links.count()
    out = starts[0]
    for more in starts[1:]:
        out = out.unionByName(more)
    return out.select(F.col("to").alias("id"), "part", "seq")


def _closed_by(final: bool, client: int, us: int, following: tuple[int, int] | None, gap: int) -> str:
    if following is None or following[0] != client:
        return "end" if final else "none"
    return "end" if final else "gap" if following[1] - us >= gap else "length"


def _cut(row: dict, gap: int) -> list[tuple]:
    """The pieces of sessions in a chunk; those that may go on outside keep their path as text."""
    client, us, ids, cents, final, hard, late = (unpack(x) for x in row["clicks"])
    out, key = [], (row["part"], row["seq"])
    if row["before"]:
        b = row["before"]
        out.append((*key, -1, False, b["client"], None, None, None, 0, b["n_late"], 0, None, None, ""))
    n = len(ids)
    if n == 0:
        return out
    start = hard.astype(bool)
    if row["seq"] == row["first_seq"]:
        start[0] = row["hard"]
    if row["starts"]:
        start |= np.isin(ids, np.array(row["starts"], np.int64))
    cuts = np.flatnonzero(start)
    begin = cuts if len(cuts) and cuts[0] == 0 else np.r_[0, cuts]
    end = np.r_[begin[1:], n]
    texts = [str(i) for i in ids.tolist()]
    sums = [np.add.reduceat(x.astype(np.int64), begin).tolist() for x in (late, cents)]
    goes_on = (row["next"]["client"], row["next"]["us"]) if row["next"] else None
    following = goes_on or ((row["n_client"], row["n_us"]) if row["n_client"] is not None else None)
    for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        whole, then = bool(start[a]), (int(client[b]), int(us[b])) if b < n else following
        closed = _closed_by(bool(final[b - 1]), int(client[b - 1]), int(us[b - 1]), then, gap)
        if b == n:  # a break that follows for sure ends the piece, but a partition's end does not
            whole = whole and goes_on is not None and (closed != "length")
        path = ",".join(texts[a:b])
        sha = hashlib.sha256(path.encode()).hexdigest() if whole else None
        out.append((*key, k, whole, int(client[a]), int(ids[a]) if start[a] else None, int(us[a]), int(us[b - 1]), b - a, sums[0][k], sums[1][k], closed, sha, None if whole else path))
    return out


def cut_chunks(chunks: DataFrame, starts: DataFrame, edges: DataFrame, gap: int) -> DataFrame:
    """The pieces of all chunks. A chunk's starts are at most its clicks."""
    lists = starts.groupBy("part", "seq").agg(F.collect_list("id").alias("starts"))
    first = chunks.where("n > 0").groupBy("part").agg(F.min("seq").alias("first_seq"))
    facts = edges.select("part", "hard", "n_client", "n_us").join(first, "part", "left")
    rows = chunks.select("part", "seq", "next", "before", "clicks").join(lists.hint("merge"), ["part", "seq"], "left").join(facts, "part")
    names = [p.split(" ")[0] for p in PIECES.split(", ")]
    types = _common.arrow_types(chunks.sparkSession, PIECES)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                if found := _cut(batch.slice(k, 1).to_pylist()[0], gap):
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(run, PIECES)


def joined_pieces(pieces: DataFrame, partitions: int) -> DataFrame:
    """Sessions that cross chunks. A piece without a start goes on with the last one that has started before it."""
    order = W.partitionBy("part").orderBy("seq", "nth").rowsBetween(W.unboundedPreceding, 0)
    begun = F.when(F.col("session_id").isNotNull(), F.struct("session_id", "client_id"))
    within = pieces.withColumn("begun", F.last(begun, ignorenulls=True).over(order))
    ends = within.groupBy("part").agg(F.max_by("begun", F.struct("seq", "nth")).alias("begun")).collect()  # one row a partition
    carried, rows = None, []
    for r in sorted(ends, key=lambda r: r.part):
        rows.append((r.part, *(carried or (None, None))))
        carried = (r.begun.session_id, r.begun.client_id) if r.begun else carried
    before = pieces.sparkSession.createDataFrame(rows, "part int, b_session long, b_client long")
    named = within.join(before, "part").withColumn("session", F.coalesce("begun.session_id", "b_session")).withColumn("owner", F.coalesce("begun.client_id", "b_client"))
    named = named.where(F.col("session").isNotNull() & (F.col("owner") == F.col("client_id"))).drop("session_id").withColumnRenamed("session", "session_id")
    order_ = ["session_id", "part", "seq", "nth"]
    names = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path"]
    types = "client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, path_sha256 string"
    ready = named.repartition(partitions, "session_id").sortWithinPartitions(*order_).select(*names)

    def run(batches: Iterable[pa.RecordBatch]):
        row, digest = None, None

        def done():
            return pa.RecordBatch.from_pylist([row | {"path_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            for piece in batch.to_pylist():
                path = piece.pop("path")
                if row is None or row["session_id"] != piece["session_id"]:
                    if row is not None:
                        yield done()
                    row, digest = piece, hashlib.sha256(path.encode())
                    continue
                for name in ("n_clicks", "n_late", "value_cents"):
                    row[name] += piece[name]
                if piece["n_clicks"]:
                    row["end_us"], row["closed_by"] = piece["end_us"], piece["closed_by"]
                    digest.update(b"," + path.encode())
        if row is not None:
            yield done()

    schema = pa.schema(_common.arrow_types(pieces.sparkSession, types))
    return ready.mapInArrow(run, types)


def sessionise(clicks: DataFrame, gap: int = 15 * MINUTE, longest: int = 60 * MINUTE, lateness: int = 15 * MINUTE, final_kinds: tuple[str, ...] = ("purchase", "signup"), final_value: float = 60.0) -> DataFrame:
    """One row per session, with the columns in ``RESULT``. Times are microseconds."""
    spark = clicks.sparkSession
    tables = _common.Tables(spark, "sessions")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = tables.keep(packed(distinct_clicks(clicks, lateness, final_kinds, final_value), gap, longest, partitions))
    edges = _edges(chunks, gap)
    starts = marked_starts(pointers(chunks, edges), tables)
    pieces = tables.keep(cut_chunks(chunks, starts, edges, gap))
    return pieces.where("whole").select(*RESULT).unionByName(joined_pieces(pieces.where("NOT whole"), partitions).select(*RESULT))


def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clicks, in sessions."""
    _common.tune(spark)
    return sessionise(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


OP11_SQL = """
WITH RECURSIVE once AS (
  SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 900000000, false) AS late,
         coalesce(value >= 60 AND kind IN ('purchase', 'signup'), false) AS final, coalesce(floor(100 * value + 0.5)::BIGINT, 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
), timely AS (
  SELECT *, row_number() OVER w AS pos, lag(us) OVER w AS before, lag(final) OVER w AS ended, lead(us) OVER w AS after
  FROM once WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)
), broken AS (
  SELECT *, before IS NULL OR ended OR us - before >= 900000000 AS hard FROM timely
), islands AS (
  SELECT *, max(CASE WHEN hard THEN pos END) OVER (PARTITION BY client_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM broken
), beyond AS (
  SELECT a.client_id, a.pos, min(b.pos) AS next
  FROM islands a JOIN islands b ON a.client_id = b.client_id AND a.island = b.island AND b.us > a.us + 3600000000 AND b.us < a.us + 4500000000
  GROUP BY a.client_id, a.pos
), starts AS (
  SELECT client_id, pos FROM islands WHERE hard
  UNION ALL
  SELECT s.client_id, b.next FROM starts s JOIN beyond b ON b.client_id = s.client_id AND b.pos = s.pos
), numbered AS (
  SELECT i.*, max(s.pos) OVER (PARTITION BY i.client_id ORDER BY i.pos ROWS UNBOUNDED PRECEDING) AS start
  FROM islands i LEFT JOIN starts s ON s.client_id = i.client_id AND s.pos = i.pos
), grouped AS (
  SELECT client_id, start, arg_min(click_id, pos) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents,
         arg_max(final, pos) AS final, max(pos) AS last_pos, sha256(string_agg(click_id, ',' ORDER BY pos)) AS path_sha256
  FROM numbered GROUP BY client_id, start
), ends AS (
  SELECT g.*, lead(start_us) OVER w AS next_start, lead(start_us) OVER w - end_us AS pause, lead(start) OVER w IS NOT NULL AS more
  FROM grouped g WINDOW w AS (PARTITION BY client_id ORDER BY start)
), lates AS (
  SELECT e.client_id, e.start, count(*) AS n FROM ends e JOIN once o ON o.late AND o.client_id = e.client_id AND o.us >= e.start_us AND (e.next_start IS NULL OR o.us < e.next_start) GROUP BY 1, 2
)
SELECT e.client_id, e.session_id, e.start_us, e.end_us, e.n_clicks, coalesce(l.n, 0) AS n_late, e.value_cents,
       CASE WHEN e.final THEN 'end' WHEN NOT e.more THEN 'none' WHEN e.pause >= 900000000 THEN 'gap' ELSE 'length' END AS closed_by, e.path_sha256
FROM ends e LEFT JOIN lates l ON l.client_id = e.client_id AND l.start = e.start
"""
