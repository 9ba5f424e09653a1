"""Transcripts to chat turns: a hidden Markov model over lines recovers the roles, then turns are rendered canonically.

Hidden states are (role, begins a turn or goes on). A line shows a speaker marker or none, its length, how it ends, how
it begins and whether it opens its entry. Start, transition and emission probabilities are smoothed counts over labelled
entries, gathered by grouped aggregation; their number is fixed by the states and features.

The most likely states are found exactly by Viterbi's recursion for conversations of any length. Entries are dealt by
ranges of (conversation, turn), so a long conversation spans partitions. Each partition sums up the conversation that it
shares with the next one as a table of best scores from state to state; the driver joins those tables (two per partition
at most) and tells each partition with what scores it begins and in which state it ends.

Defined results: a null or empty text is one empty line; a null role counts for nothing in training; a null
conversation id is a conversation of its own kind, a null turn comes first; rows of one turn are ordered by text;
repeated rows are entries of their own; of paths that are equally likely the one through the first states is taken; other
columns are ignored, whatever their names; an empty table gives an empty result; an entry is one row however long; without
labelled entries all states are equally likely and the first role is recovered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import _common

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2  # 2 * role: begins a turn; 2 * role + 1: goes on
#: Bytes of text in one partition of the order.
PART = 16 << 20

_MARKERS = (
    re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?(?:system|instructions?)(?:\|?>|\*\*|\])?\s*(?::|\|?>|\]|\*\*|$)\s*", re.I),
    re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?(?:user|human|you|question|q)(?:\|?>|\*\*|\])?\s*(?::|\|?>|\]|\*\*|$)\s*", re.I),
    re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?(?:assistant|ai|bot|model|answer|a)(?:\|?>|\*\*|\])?\s*(?::|\|?>|\]|\*\*|$)\s*", re.I),
)
#: Features of a line and how many values each has.
FEATURES = (("marker", 4), ("length", 16), ("end", 5), ("begin", 4), ("opens", 2))


def line_features(line: str, opens: bool) -> tuple[int, ...]:
    marker = next((k + 1 for k, m in enumerate(_MARKERS) if m.match(line)), 0)
    body = line.strip()
    last, first = body[-1:], body[:1]
    end = 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3 if last in ":;," else 4
    begin = 0 if not first else 1 if first.isupper() else 2 if first.isalpha() else 3
    return marker, min(15, len(body).bit_length()), end, begin, int(opens)


def strip_marker(line: str) -> str:
    for m in _MARKERS:
        if found := m.match(line):
            return line[found.end() :]
    return line


class Model:
    """Logarithms of the start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        norm = lambda x: np.log((x + 0.5) / (x + 0.5).sum(axis=-1, keepdims=True))
        self.start, self.move, self.emit = norm(start), norm(move), [norm(e) for e in emit]

    def scores(self, lines: list[tuple[int, ...]]) -> np.ndarray:
        """(lines, states): how well each state explains each line."""
        seen = np.array(lines)
        return sum(e.T[seen[:, k]] for k, e in enumerate(self.emit))


def forward(model: Model, scores: np.ndarray, entering: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best scores at the last line, back pointers); entering: scores of the state before the first line, already moved."""
    best, back = entering + scores[0], np.zeros(scores.shape, np.int8)
    for n in range(1, len(scores)):
        ways = best[:, None] + model.move
        back[n] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[n]
    return best, back


def summary(model: Model, scores: np.ndarray) -> np.ndarray:
    """(states before, states at the end): best scores through these lines, after a move into the first."""
    best = model.move + scores[0]
    for n in range(1, len(scores)):
        best = (best[:, :, None] + model.move[None]).max(axis=1) + scores[n]
    return best


def trace(back: np.ndarray, last: int) -> np.ndarray:
    out = np.empty(len(back), np.int8)
    for n in range(len(back) - 1, -1, -1):
        out[n] = last
        last = back[n][last]
    return out


def _entry_lines(text: str) -> list[str]:
    return text.split("\n")


def count_model(entries: DataFrame) -> Model:
    """From labelled entries (conv_id, turn, role, text): counts by grouped aggregation, a bounded table."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            seen: dict[tuple[int, int, int], int] = {}
            add = lambda *key: seen.__setitem__(key, seen.get(key, 0) + 1)
            for role, text in zip(batch.column(0).to_pylist(), _common.texts_of(batch.column(1)), strict=True):
                r = ROLES.index(role)
                lines = _entry_lines(text)
                for n, line in enumerate(lines):
                    state = 2 * r + (n > 0)
                    for k, value in enumerate(line_features(line, n == 0)):
                        add(k, state, value)
                    if n:
                        add(-1, state - (n == 1), state)
            cols = list(zip(*((*key, n) for key, n in seen.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["kind", "a", "b", "n"])

    known = entries.where(F.col("role").isin(*ROLES))
    lines = known.select("role", "text").mapInArrow(_common.batches_with_rows(run), "kind long, a long, b long, n long")
    # from an entry to the next: by role, and whether the first ends after one line. The next entry of a turn numbered t
    # is the one numbered t + 1, so that no order within a conversation is needed.
    ends = known.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.max(F.instr(F.coalesce("text", F.lit("")), "\n") > 0).alias("long"))
    step = ends.alias("x").join(ends.alias("y"), (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.turn") + 1 == F.col("y.turn")))
    role_at = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), F.col(c)) - 1
    moves = step.select(F.lit(-1).cast("long").alias("kind"), (role_at("x.role") * 2 + F.col("x.long").cast("long")).alias("a"), (role_at("y.role") * 2).alias("b"), F.lit(1).cast("long").alias("n"))
    firsts = known.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"))
    starts = firsts.where("role is not null").select(F.lit(-2).cast("long").alias("kind"), F.lit(0).cast("long").alias("a"), (role_at("role") * 2).alias("b"), F.lit(1).cast("long").alias("n"))
    counts = lines.unionByName(moves).unionByName(starts).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # at most a row per probability
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros((STATES, size)) for _, size in FEATURES]
    for kind, a, b, n in counts:
        if kind == -2:
            start[b] = n
        elif kind == -1:
            move[a, b] = n
        else:
            emit[kind][a, b] = n
    return Model(start, move, emit)


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def recover(entries: DataFrame, model: Model, rendered: bool = False, part_bytes: int = PART) -> DataFrame:
    """conv_id, turn, entry, line, role, begins, text: a row per line, with the role recovered and its marker taken off.

    rendered: instead conv_id, turn, entry, n_lines, role, rendered: a row per entry, its turns one after another.
    """
    tables = _common.Tables(entries.sparkSession, "chat")
    rows = entries.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _common.partitions(total, part_bytes)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(parts, *order[:3]).withColumn("part", F.spark_partition_id())
    dealt = tables.keep(dealt)

    def by_conversation(table: pa.Table):
        """The partition's rows in order, and where each conversation begins and ends."""
        table = table.append_column("key", pa.array([_xx(t) for t in table.column("text").to_pylist()], pa.int64()))
        idx = sorted(range(table.num_rows), key=lambda n, c=[table.column(x).to_pylist() for x in ("conv_id", "turn", "key", "text")]: tuple((c[k][n] is not None, c[k][n] if c[k][n] is not None else 0) for k in range(3)) + (c[3][n],))
        table = table.take(pa.array(idx, pa.int64()))
        ids = table.column("conv_id").to_pylist()
        cuts = [0, *(n for n in range(1, len(ids)) if ids[n] != ids[n - 1]), len(ids)]
        lines = [(n, k, line) for n, text in enumerate(table.column("text").to_pylist()) for k, line in enumerate(_entry_lines(text))]
        owner = np.array([n for n, _, _ in lines])
        edges = np.searchsorted(owner, cuts)
        return table, ids, lines, edges, model.scores([line_features(line, k == 0) for _, k, line in lines])

    def sum_up(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, ids, lines, edges, scores = by_conversation(table)
        out = []
        for n in sorted({0, len(edges) - 2}):
            a, b = edges[n], edges[n + 1]
            first, _ = forward(model, scores[a:b], model.start)
            out.append((part, n == 0, n == len(edges) - 2, ids[lines[a][0]], first.tolist(), summary(model, scores[a:b]).ravel().tolist()))
        cols = list(zip(*out, strict=True))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "head", "tail", "conv_id", "begun", "through"), cols, (pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)})

    plan = dealt.groupBy("part").applyInArrow(sum_up, "part int, head boolean, tail boolean, conv_id long, begun array<double>, through array<double>").collect()
    entering, leaving = _join_parts(model, plan)

    def decode(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table, ids, lines, edges, scores = by_conversation(table)
        states = np.empty(len(lines), np.int8)
        for n in range(len(edges) - 1):
            a, b = edges[n], edges[n + 1]
            enter = entering.get(part) if n == 0 else None
            best, back = forward(model, scores[a:b], model.start if enter is None else np.array(enter))
            last = leaving.get(part) if n == len(edges) - 2 else None
            states[a:b] = trace(back, int(best.argmax()) if last is None else last)
        turns, begins = table.column("turn").to_pylist(), (states % 2 == 0).tolist()
        roles = [ROLES[x // 2] for x in states.tolist()]
        texts = [strip_marker(x) if b else x for (_, _, x), b in zip(lines, begins, strict=True)]
        out = []
        if rendered:
            at = 0
            for n, count in enumerate(np.bincount([n for n, _, _ in lines]).tolist()):
                out.append((ids[n], turns[n], part << 40 | n, count, roles[at], render_turns(zip(roles[at : at + count], begins[at : at + count], texts[at : at + count], strict=True))))
                at += count
        else:
            out = [(ids[n], turns[n], part << 40 | n, k, r, b, x) for (n, k, _), r, b, x in zip(lines, roles, begins, texts, strict=True)]
        cols = list(zip(*out, strict=True))
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(fields, cols, strict=True)})

    schema = "conv_id long, turn long, entry long, n_lines int, role string, rendered string" if rendered else "conv_id long, turn long, entry long, line int, role string, begins boolean, text string"
    fields = _common.arrow_types(entries.sparkSession, schema)
    return dealt.groupBy("part").applyInArrow(decode, schema)


def render_turns(lines: Iterable[tuple[str, bool, str]]) -> str:
    """(role, begins, text) of an entry's lines to its canonical turns; the first line always opens one."""
    parts: list[tuple[str, list[str]]] = []
    for role, begins, text in lines:
        if begins or not parts:
            parts.append((role, []))
        parts[-1][1].append(text)
    return "".join(render(role, "\n".join(found).strip("\n")) for role, found in parts)


def _xx(text: str) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def _join_parts(model: Model, plan: list) -> tuple[dict[int, list[float]], dict[int, int]]:
    """For partitions that share a conversation with their neighbour: scores before their first line, and last states.

    The best state sequence through all parts is fixed from its end: going back, each part's last state is the one from
    which the next part's last state is reached best.
    """
    heads = {r.part: r for r in plan if r.head}
    tails = {r.part: r for r in plan if r.tail}
    entering: dict[int, list[float]] = {}
    leaving: dict[int, int] = {}
    order = sorted(heads)
    chain: list[tuple[int, np.ndarray]] = []  # parts of one conversation with the scores of their last states

    def close():
        """The chain's last state is its best, which its part finds too; each earlier one leads to the next best."""
        after = int(chain[-1][1].argmax())
        for k in range(len(chain) - 2, -1, -1):
            part, best = chain[k]
            table = np.array(heads[chain[k + 1][0]].through).reshape(STATES, STATES)
            after = leaving[part] = int((best + table[:, after]).argmax())

    for here, part in enumerate(order):
        joined = here > 0 and bool(chain) and tails[order[here - 1]].conv_id == heads[part].conv_id
        if joined:
            before = chain[-1][1]
            entering[part] = (before[:, None] + model.move).max(axis=0).tolist()
            through = np.array(heads[part].through).reshape(STATES, STATES)
            chain.append((part, (before[:, None] + through).max(axis=0)))
        if not joined or not heads[part].tail:  # the part's last conversation begins in it
            if chain and len(chain) > 1:
                close()
            chain = [(part, np.array(tails[part].begun))]
    if len(chain) > 1:
        close()
    return entering, leaving


def raw_entries(conversations: DataFrame) -> DataFrame:
    """Labelled conversations as transcripts: marker styles by conversation; a third of the entries lose their marker."""
    style = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 4
    dropped = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")) % 3 == 0
    name = F.initcap(F.coalesce("role", F.lit("")))
    marker = F.when(dropped | (style == 3) | F.col("role").isNull(), F.lit("")).when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit("\n"))).otherwise(F.concat(F.lit("<|"), F.lower(name), F.lit("|> ")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts: learn on four fifths of them, recover the roles of all, and render."""
    _common.tune(spark)
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    entries = raw_entries(given)
    held = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    chats = recover(entries, count_model(entries.where(~held)), rendered=True)
    truth = given.groupBy(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t")).agg(F.min("role").alias("given_role"))
    out = chats.join(truth, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")))
    return out.select("conv_id", "turn", "entry", held.alias("held_out"), "given_role", F.col("role").alias("recovered_role"), "n_lines", "rendered")



