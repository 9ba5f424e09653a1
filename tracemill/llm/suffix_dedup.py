"""Removal of repeated byte strings: every byte covered by a string of ``length`` bytes that also begins elsewhere.

Which strings can repeat: anchors. Of each ``length - ANCHOR + 1`` neighbouring stretches of ``ANCHOR`` bytes the one with
the least hash is chosen; so every string of ``length`` bytes holds a chosen anchor, and equal strings hold the same one at
the same place. Around an anchor lies its zone, the bytes of all strings that may hold it there. Anchors go to their
equals; what occurs once is dropped.

* Zones that are equal as a whole are repeated as a whole. Long copies are settled here by hashes alone.
* Different zones around one anchor, of which some occur once, are compared by suffix order: one text per distinct zone,
  some megabytes at a time, through ``_bwt``: breadth-first backward extension on the Burrows-Wheeler transform,
  stopping at the minimum length. The anchor itself stands there as one character, so that strings of ``length`` bytes
  that hold it are strings of ``length - ANCHOR + 1`` characters; a zone is first cut to what it shares with its most
  similar neighbours on either side, and left out if that is too short for any string.
* An anchor with more than ``ZONES`` distinct zones is refined first: half of the strings share more bytes to the left of
  the anchor, half more to the right; each zone goes to two narrower groups. What is alone there is dropped, what is
  equal there is settled. After about log2(length - ANCHOR) rounds a group is one string.

No task holds all occurrences of a frequent anchor. What a zone has twice in one Arrow batch is settled there, and one
occurrence stands for the others. Anchors are counted over the whole table by partial sums; one that still has ``OFTEN``
occurrences is hot: its zones are counted with partial sums and met again in joins, whose large sides Spark splits; the
rest is counted in one shuffle.

Rows are known by doc_id where it is unique and not null, else by a hash of id and text. Defined results: a null or
empty text has no bytes and no spans; repeated rows are documents of their own (each of them is a copy of the other), so
ties need no order: all copies lose the string; other columns are ignored, whatever their names; an empty table gives an
empty result. A text is handled whole; a task holds some tens of bytes for each byte of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common
from tracemill.llm import _words as words
from tracemill.llm._bwt import repeated_windows

LENGTH, ANCHOR = 400, 256
#: Most distinct zones of an anchor that are compared in one go, and bytes of zones in one suffix order.
ZONES, SORTED_BYTES = 1024, 1 << 19
#: Row keys (8 bytes each) that are broadcast to pick rows; beyond, rows are picked by a shuffled join.
BROADCAST_ROWS = 500_000
#: Occurrences of an anchor, but for what is settled within a batch, that make it hot.
OFTEN = 256


def _least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least (then first) value of each window, for all windows."""
    n = np.uint64(31)
    m = (h >> n << n) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if rest := width - span:
        m = np.minimum(m[:-rest], m[rest:])
    return (m & np.uint64((1 << 31) - 1)).astype(np.int64)


def anchors_of(data: np.ndarray, row_at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, place, anchor hash, zone hash, bytes of the zone before and after the anchor) of each chosen anchor."""
    slack = length - anchor
    begins, ends = row_at[:-1], row_at[1:]
    long_enough = ends - begins >= length
    empty = np.empty(0, np.int64)
    if not long_enough.any():
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    prefix = words.Prefix(data)
    h = prefix.every(anchor)
    place = _least_places(h, slack + 1)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begins[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    place = place[np.cumsum(inside[: len(place)], dtype=np.int8).astype(bool)]
    place = place[np.r_[True, place[1:] != place[:-1]]]
    row = np.searchsorted(row_at, place, "right") - 1
    before = np.minimum(slack, place - row_at[row])
    after = np.minimum(slack, row_at[row + 1] - place - anchor)
    zone = prefix.of(place - before, place + anchor + after)
    zone = words.pair(zone, (before << 32 | after).astype(np.uint64))
    return row, place - row_at[row], h[place], zone, before, after


def _occurrences(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """anchor, zone, row, place of every chosen anchor; place packs the position and the bytes before and after.

    same: how many times the zone occurs in its Arrow batch; the first of these leads, and its ``often`` tells how many
    zones the anchor has in the batch; for the others it is 0.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = _common.utf8_of(batch.column(1))
        data = np.frombuffer(data, np.uint8)
        keys, parts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), []
        for first, end in words.chunks(at):
            row_at = np.array(at[first : end + 1]) - at[first]
            row, place, h, zone, before, after = anchors_of(data[at[first] : at[end]], row_at, length, anchor)
            parts.append((h.view(np.int64), zone.view(np.int64), keys[first:end][row], place << 24 | before << 12 | after))
        h, zone, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, lead, which, same = np.unique(zone, return_index=True, return_inverse=True, return_counts=True)
        _, of, zones = np.unique(h[lead], return_inverse=True, return_counts=True)
        often = np.zeros(len(h), np.int32)
        often[lead] = zones[of]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, zone, row, place, same[which].astype(np.int32), often)], ["anchor", "zone", "row", "place", "same", "often"])

    return docs.select("row", "text").mapInArrow(_common.per_batch(run), "anchor long, zone long, row long, place long, same int, often int")


def _position(place="place"):
    return F.shiftright(place, 24)


def _begin(place="place"):
    return _position(place) - F.shiftright(place, 12).bitwiseAND(F.lit(4095))


def _end(anchor: int, place="place"):
    return _position(place) + F.lit(anchor) + F.col(place).bitwiseAND(F.lit(4095))


def _with_rows(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """The documents as (row, doc_id, text, carried): row is doc_id where that tells them apart."""
    carried = F.col(carry).cast("string") if carry else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), carried.alias("carried"))
    unclear = base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    return base.withColumn("row", F.xxhash64("doc_id", "text") if unclear else F.col("doc_id"))


def _pick(docs: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """docs whose row is among rows (distinct): broadcast up to a size, shuffled beyond."""
    return docs.join(F.broadcast(rows) if count <= BROADCAST_ROWS else rows, "row", "left_semi")


def _zones(docs: DataFrame, wanted: DataFrame, anchor: int, tables: _common.Tables) -> DataFrame:
    """grp, row, begin, single, before, body, many for each wanted zone (anchor, row, place, single, zones)."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", _begin().alias("begin"), _end(anchor).alias("end"), _position().alias("place"), "single", (F.col("zones") > ZONES).alias("many"))).alias("asked"))
    schema = "grp long, row long, begin long, single boolean, before int, body binary, many boolean"
    types = _common.arrow_types(docs.sparkSession, schema)
    rows = tables.keep(asked)
    picked = _pick(docs.select("row", "text"), rows.select("row"), rows.count())

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = []
            data, at = _common.utf8_of(batch.column(1))
            for n, (row, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = data[at[n] : at[n + 1]]
                out += [(a["anchor"], row, a["begin"], a["single"], a["place"] - a["begin"], bytes(text[a["begin"] : a["end"]]), a["many"]) for a in asked]
            for k in range(0, len(out), 8192):
                cols = list(zip(*out[k : k + 8192], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, types, strict=True)], [t.name for t in types])

    return picked.join(rows, "row").select("row", "text", "asked").mapInArrow(run, schema)


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Ascending starts of strings to the stretches that the strings cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.r_[0, cut]].tolist(), (starts[np.r_[cut - 1, len(starts) - 1]] + length).tolist(), strict=True))


def _spans(rows: list[tuple[int, int, int]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "begin", "end"), cols, strict=True)})


def _shared_with_neighbours(parts: list[bytes], group: np.ndarray, most: int) -> np.ndarray:
    """How many leading bytes each part shares with any other of its group; zero bytes may make it seem more."""
    held = np.array(parts, f"S{most}")
    order = np.lexsort((held, group))
    raw = held[order].view(np.uint8).reshape(len(parts), most)
    apart = np.ones((len(parts), most + 1), bool)  # neighbours differ here; the last column stands for the end
    apart[1:, :most] = raw[1:] != raw[:-1]
    shared = apart.argmax(axis=1)
    shared[0] = 0
    shared[1:][group[order][1:] != group[order][:-1]] = 0
    out = np.empty(len(parts), np.int64)
    out[order] = np.maximum(shared, np.r_[shared[1:], 0])
    return np.minimum(out, [len(p) for p in parts])


def _compare(zones: DataFrame, length: int, anchor: int, total: int) -> DataFrame:
    """row, begin, end of repeated strings in zones that occur once, by suffix order over whole groups."""
    slack = length - anchor

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("row", "ascending"), ("begin", "ascending")])
        grp, row, begin, single, before = (table.column(c).to_numpy() for c in ("grp", "row", "begin", "single", "before"))
        bodies, out = table.column("body").to_pylist(), []
        _, kind = np.unique(grp, return_inverse=True)
        left, right = [b[:n] for b, n in zip(bodies, before.tolist(), strict=True)], [b[n + anchor :] for b, n in zip(bodies, before.tolist(), strict=True)]
        ahead, after = _shared_with_neighbours([x[::-1] for x in left], kind, slack), _shared_with_neighbours(right, kind, slack)
        live = np.flatnonzero(ahead + after >= slack)
        texts = [left[n][len(left[n]) - a :] + right[n][:b] for n, a, b in zip(live.tolist(), ahead[live].tolist(), after[live].tolist(), strict=True)]
        kind, row, single, mark, begin = kind[live], row[live], single[live], ahead[live], (begin + before - ahead)[live]
        sizes = np.cumsum([0, *(len(x) for x in texts)])
        edges = np.r_[np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]), len(kind)] if len(kind) else np.zeros(1, int)
        first = 0
        while first < len(edges) - 1:  # whole groups, about SORTED_BYTES at a time
            low = edges[first]
            last = max(first + 1, int(np.searchsorted(sizes[edges], sizes[low] + SORTED_BYTES, "right")) - 1)
            high = edges[last]
            _, known = np.unique(row[low:high], return_inverse=True)
            found = repeated_windows(texts[low:high], known.astype(np.int64) << 32 | begin[low:high], slack + 1, kind[low:high], mark[low:high])
            for k in np.flatnonzero(single[low:high]).tolist():
                out += [(int(row[low + k]), int(begin[low + k]) + a, int(begin[low + k]) + b) for a, b in _runs(found[k], length)]
            first = last
        return _spans(out)

    tasks = _common.partitions(total, 16 * SORTED_BYTES)
    return zones.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("int")).groupBy("task").applyInArrow(run, "row long, begin long, end long")


def _kinds(members: DataFrame, group: str, whole: str, place: list[str], stands_for: Column, tables: _common.Tables) -> DataFrame:
    """group, whole, equal, least (the first place of that whole), kinds and fewest (of its group); partial sums throughout."""
    per = tables.keep(members.groupBy(group, whole).agg(F.sum(stands_for).alias("equal"), F.min(F.struct(*place)).alias("least")))
    around = tables.keep(per.groupBy(group).agg(F.count("*").alias("kinds"), F.min("equal").alias("fewest")))
    return per.join(F.broadcast(around) if around.count() <= BROADCAST_ROWS else around, group).where("equal > 1 OR kinds > 1 AND fewest = 1")


def _refine(zones: DataFrame, length: int, slack: int, tables: _common.Tables) -> tuple[DataFrame, list[DataFrame]]:
    """Zones of anchors that have too many: (groups that are small enough to compare, tables of repeated strings).

    A string of a zone is named by the bytes that it has before the anchor; those with a … b bytes share a core, and span
    a stretch. Zones that differ in the core share none of them and part. Zones that are equal in the whole stretch share
    all of them: they are settled, and one of them stays as a partner for zones that are not. A zone that is cut short by
    its text has the core if it has any of the strings.
    """
    names = ["grp", "row", "begin", "single", "before", "body", "low", "high"]
    current, small, spans = zones.withColumns({"low": F.lit(0), "high": F.lit(slack)}).select(names), [], []
    size, before = F.octet_length("body"), F.col("before")
    while True:
        halves = []
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        for a, b in ((F.col("low"), middle), (middle + 1, F.col("high"))):
            core = F.substring("body", before - a + 1, F.lit(length) - b + a)
            begin, end = F.greatest(F.lit(0), before - b), F.least(size, before - a + length)
            half = current.where((before >= a) & (before - b + length <= size))
            halves.append(half.select(F.xxhash64("grp", a, b, core).alias("grp"), "row", (F.col("begin") + begin).alias("begin"), "single", (before - begin).alias("before"), F.substring("body", begin + 1, end - begin).alias("body"), a.alias("low"), b.alias("high")))
        sized = tables.keep(_union(halves).withColumn("whole", F.xxhash64("body", "before")))
        kinds = tables.keep(_kinds(sized, "grp", "whole", ["row", "begin"], F.lit(1), tables))
        sized = sized.join(kinds, ["grp", "whole"]).withColumn("first", F.struct("row", "begin") == F.col("least"))
        sized = tables.keep(sized.select(*names, "first", "equal", "kinds", "fewest"))
        spans.append(sized.where(F.expr("equal > 1 AND single") & (size >= length)).select("row", "begin", (F.col("begin") + size).alias("end")))
        ahead = sized.where("first AND kinds > 1 AND fewest = 1").withColumn("single", F.expr("single AND equal = 1"))
        small.append(ahead.where(f"kinds <= {ZONES}").select(*names[:-2]))
        current = ahead.where(f"kinds > {ZONES}").select(names)
        if not current.limit(1).count():
            return _union(small), spans


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _found(leads: DataFrame) -> DataFrame:
    """anchor, row, place, n, zones of what is repeated; compare: it stands for its zone in a comparison.

    n: occurrences of the zone; zones: of the anchor; only_compare: the same occurrence has another row, without this.
    """
    same, around = W.partitionBy("anchor", "zone"), W.partitionBy("anchor")
    first = F.row_number().over(same.orderBy("row", "place")) == 1
    seen = leads.repartition("anchor").withColumn("first", first).withColumn("n", F.sum("same").over(same))
    seen = seen.withColumns({"fewest": F.min("n").over(around), "zones": F.sum(F.col("first").cast("int")).over(around)})
    open_group = F.expr("zones > 1 AND fewest = 1")
    return seen.where((F.col("n") > 1) | open_group).select("anchor", "row", "place", "n", "zones", (F.col("first") & open_group).alias("compare"), F.lit(False).alias("only_compare"))


def _found_hot(leads: DataFrame, tables: _common.Tables) -> DataFrame:
    """The same for anchors that occur too often to meet in one task."""
    kinds = tables.keep(_kinds(leads, "anchor", "zone", ["row", "place"], F.col("same"), tables))
    many = tables.keep(kinds.where("equal > 1").select("anchor", "zone", F.col("equal").alias("n"), F.col("kinds").alias("zones")))
    alone = leads.where("same = 1")  # the others are settled
    all_of = alone.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, ["anchor", "zone"])
    all_of = all_of.select("anchor", "row", "place", "n", "zones", F.lit(False).alias("compare"), F.lit(False).alias("only_compare"))
    compared = kinds.where("kinds > 1 AND fewest = 1").select("anchor", F.col("least.row").alias("row"), F.col("least.place").alias("place"), F.col("equal").alias("n"), F.col("kinds").alias("zones"))
    return all_of.unionByName(compared.withColumns({"compare": F.lit(True), "only_compare": F.lit(True)}))


def repeated_spans(rows: DataFrame, tables: _common.Tables, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(row, begin, end): stretches of bytes, which may overlap, that cover every repeated string. rows: (row, text)."""
    slack = length - anchor
    if not 0 < slack < 4096:
        raise ValueError("the anchor must be shorter than the string, by less than 4096 bytes")
    seen = tables.keep(_occurrences(rows, length, anchor))
    leads = seen.where("often > 0")
    hot = tables.keep(leads.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("anchor"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    found = tables.keep(_found(leads.join(hot, "anchor", "left_anti")).unionByName(_found_hot(leads.join(hot, "anchor", "left_semi"), tables)))
    whole = seen.where("same > 1").select("row", "place").unionByName(found.where("n > 1 AND NOT only_compare").select("row", "place"))
    whole = whole.where(_end(anchor) - _begin() >= length).select("row", _begin().alias("begin"), _end(anchor).alias("end"))
    wanted = found.where("compare").select("anchor", "row", "place", (F.col("n") == 1).alias("single"), "zones")
    zones = tables.keep(_zones(rows, wanted, anchor, tables))
    sizes = zones.agg(F.sum(F.when(F.col("many"), 0).otherwise(F.octet_length("body"))).alias("few"), F.count(F.when(F.col("many"), 1)).alias("many")).first()
    spans, groups, total = [whole], zones.where("NOT many").select("grp", "row", "begin", "single", "before", "body"), sizes.few or 0
    if sizes.many:
        narrow, more = _refine(zones.where("many"), length, slack, tables)
        groups = groups.unionByName(narrow.select("grp", "row", "begin", "single", "before", "body"))
        total += narrow.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        spans += more
    if total:
        spans.append(_compare(groups, length, anchor, total))
    return _union(spans)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending stretches that neither overlap nor touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, use: Callable[[int | None, bytes, list[tuple[int, int]]], tuple], schema: str, length: int = LENGTH, anchor: int = ANCHOR, carry: str | None = None) -> DataFrame:
    """use(doc_id, text as bytes, merged spans) for each row of docs; its results are rows of schema.

    carry: a string column that use gets as well. Only rows that have spans meet them in a shuffled join; the others are read and passed on.
    """
    tables = _common.Tables(docs.sparkSession, "repeats")
    rows = _with_rows(docs, carry)
    spans = repeated_spans(rows.select("row", "text"), tables, length, anchor)
    spans = tables.keep(spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    types = _common.arrow_types(docs.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            data, at = _common.utf8_of(batch.column(1))
            listed, more = batch.column(2), ([x] for x in batch.column(3).to_pylist()) if carry else None
            starts = listed.offsets.to_numpy()
            ends, begins = listed.flatten().field("end").to_numpy(), listed.flatten().field("begin").to_numpy()
            base = int(starts[0]) if len(starts) else 0
            out = []
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                a, b = int(starts[n]) - base, int(starts[n + 1]) - base
                out.append(use(doc_id, bytes(data[at[n] : at[n + 1]]), merged(zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)), *(next(more) if carry else ())))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, types, strict=True)], [t.name for t in types])

    affected = spans.count()
    keys = spans.select("row")
    left = rows.join(F.broadcast(keys) if affected <= BROADCAST_ROWS else keys, "row", "left_anti")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    names = ["doc_id", "text", "spans", "carried"] if carry else ["doc_id", "text", "spans"]
    both = left.withColumn("spans", none).select(names).unionByName(_pick(rows, keys, affected).join(spans, "row").select(names))
    return both.mapInArrow(_common.batches_with_rows(run), schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what 400-byte repeats take from each, and a digest of what is left."""
    _common.tune(spark)

    def digest(doc_id, text, spans):
        removed = sum(b - a for a, b in spans)
        return doc_id, len(text), removed, len(spans), hashlib.sha256(cut_spans(text, spans)).hexdigest()

    return remove_repeats(_common.documents(spark, sf_dir), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
