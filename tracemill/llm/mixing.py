"""Mixing documents of many sources to target weights, a source's documents being repeated where it is short of words.

A document may belong to several sources. Documents are aggregated by their membership pattern (the set of their sources),
and words are routed as a flow: from patterns, of which every copy has the pattern's words as its capacity and costs more
than the copy before, to sources, which want their quota. The flow of least cost fills as many quotas as the patterns
allow with as little repetition as they allow; costs are convex, so whole copies come first. Patterns and sources that are
linked, directly or through others, are solved together, and each such component in a task of its own; what a component
holds is sets of sources with their sums, whatever the number of documents. Then each pattern's words are found among its
documents in a seeded order: all of them as often as the flow says, and once more the first of them that fit, with some
of the rest that fill what is left.

Quotas: the sources share a given part of all words by weight. A quota stops at ``MOST`` times its source's words, and what
is over is shared among the others by weight until none is above.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a document without any
source is not taken; ids may be null or shared: rows are drawn by a hash of id and text, and rows equal in both are
exchangeable; empty documents are never taken; other columns are ignored, whatever their names; without words all targets
are 0; an empty table gives an empty result. Words of texts of any length are counted a chunk at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import _common
from tracemill.llm import _words as words
from tracemill.llm._ordered import numbered, placed, running_sum
from tracemill.llm.components import connected_components

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20240501
#: Rounds that fill a pattern's gap with as many documents as fit, and then with the largest one that fits.
ROUNDS, FILLERS = 3, 2


def sized(docs: DataFrame, sources: Column) -> DataFrame:
    """doc_id, sources, size, draw: how many words each document has, and its place in the seeded order."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            data, at = _common.utf8_of(batch.column(1))
            data = np.frombuffer(data, np.uint8)
            counts = [words.word_bounds(data[at[a] : at[b]], np.array(at[a : b + 1]) - at[a])[2] for a, b in words.chunks(at)]
            size = pa.array(np.concatenate(counts).astype(np.int64)) if counts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), size, batch.column(3)], ["doc_id", "sources", "size", "draw"])

    text = F.col("text").cast("string")
    order = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), text)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sources.cast("array<string>").alias("sources"), order.alias("draw"))
    return picked.mapInArrow(_common.batches_with_rows(run), "doc_id long, sources array<string>, size long, draw long")


def quotas(sources: DataFrame, tables: _common.Tables, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, words, nth, target. sources: source, words. Weights repeat along the order of the sources, null last."""
    rows = numbered(sources, tables, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight)
    limit = F.col("words") * F.lit(float(most))
    total = rows.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    if not total.words:
        return rows.select("source", "words", "nth", F.lit(0.0).alias("target"))
    level = share * total.words / total.weight
    while True:  # the level at which what is over is shared; it only rises, and a source that is full stays full
        full = F.col("weight") * level > limit
        over = rows.agg(F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        rest = share * total.words - (over.held or 0.0)
        after = rest / over.weight if over.weight else level
        if after <= level:
            break
        level = after
    return rows.select("source", "words", "nth", F.least(limit, F.col("weight") * level).alias("target"))


def least_cost_flow(capacity: list[int], wanted: list[int], links: list[tuple[int, int]], most: int) -> dict[tuple[int, int], int]:
    """Words from each pattern to each source over the given links: as many as can be, at least cost.

    Copy c of a pattern costs c for each word. Shortest paths by reduced costs, one after another.
    """
    patterns, sources = len(capacity), len(wanted)
    begin, end = patterns + sources, patterns + sources + 1
    arcs: list[list[int]] = []  # to, left, cost; the reverse of arc k is k ^ 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])
        return len(arcs) - 2

    for p, c in enumerate(capacity):
        for copy in range(most):
            arc(begin, p, c, copy)
    linked = {(p, s): arc(p, patterns + s, sum(capacity) * most, 0) for p, s in links}
    for s, w in enumerate(wanted):
        arc(patterns + s, end, w, 0)
    height = [0] * (end + 1)
    while True:
        far, via = {begin: 0}, {}
        heap, done = [(0, begin)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for k in out[x]:
                y, room, cost = arcs[k]
                if room and y not in done and (nd := d + cost + height[x] - height[y]) < far.get(y, 1 << 62):
                    far[y], via[y] = nd, k
                    heapq.heappush(heap, (nd, y))
        if end not in done:
            break
        for x in range(end + 1):
            height[x] += far.get(x, far[end]) if x in done else far[end]
        path, x = [], end
        while x != begin:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    return {pair: arcs[k ^ 1][1] for pair, k in linked.items() if arcs[k ^ 1][1]}


def routed(patterns: DataFrame, targets: DataFrame, tables: _common.Tables, most: int = MOST) -> DataFrame:
    """pattern, flows: for each membership pattern its sources' words as array<struct<source, upto>>, added up.

    patterns: pattern, sources, words; targets: source, nth, target.
    """
    pairs = patterns.select("pattern", "words", F.explode("sources").alias("source")).join(targets.select(F.col("source").alias("s"), "nth", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    pairs = tables.keep(pairs)
    ends = pairs.groupBy("pattern").agg(F.min("nth").alias("a"), F.max("nth").alias("z"))
    joint = ends.where("a <> z")
    if joint.isEmpty():
        grouped = pairs.withColumn("component", F.col("nth"))
    else:
        edges = pairs.join(joint.select("pattern", "a"), "pattern").select("a", F.col("nth").alias("b")).where("a <> b")
        found = connected_components(edges, tables)
        grouped = pairs.join(found, F.col("nth") == F.col("node"), "left").withColumn("component", F.coalesce("root", "nth"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pattern", "nth"])
        own, wants = frame.drop_duplicates("pattern"), frame.drop_duplicates("nth").sort_values("nth")
        p, s = ({k: n for n, k in enumerate(x)} for x in (own["pattern"], wants["nth"]))
        flow = least_cost_flow([int(x) for x in own["words"]], [round(x) for x in wants["target"]], [(p[a], s[b]) for a, b in zip(frame["pattern"], frame["nth"], strict=True)], most)
        names = list(own["pattern"]), list(wants["nth"])
        return pd.DataFrame({"pattern": [names[0][a] for a, _ in flow], "nth": [names[1][b] for _, b in flow], "flow": list(flow.values())}).astype({"nth": "int64", "flow": "int64"})

    flows = grouped.select("component", "pattern", "words", "nth", "target").groupBy("component").applyInPandas(solve, "pattern string, nth long, flow long")
    named = flows.join(targets.select("nth", "source"), "nth")
    listed = F.array_sort(F.collect_list(F.struct("nth", "source", "flow")))  # a pattern's own sources
    upto = lambda x, i: F.aggregate(F.slice("l", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["flow"])
    return named.groupBy("pattern").agg(listed.alias("l")).select("pattern", F.transform("l", lambda x, i: F.struct(x["source"].alias("source"), upto(x, i).alias("upto"))).alias("flows"))


def _filled(rows: DataFrame, gaps: DataFrame, tables: _common.Tables) -> DataFrame:
    """at: rows that fill what is left of each pattern's words. rows: pattern, at, size, not taken yet.

    In each round the first ones that fit, in the seeded order; then the largest one that fits; at last the least one that
    is left, if that comes nearer."""
    out = None
    for n in range(ROUNDS + FILLERS + 1):
        open_rows = rows.join(gaps.where("gap > 0"), "pattern")
        if out is not None:
            open_rows = open_rows.join(out.select("at"), "at", "left_anti")
        fitting = open_rows.where("size <= gap")
        if n < ROUNDS:
            best = running_sum(fitting, "pattern", "size").where("upto <= gap").select("pattern", "size", "at")
        elif n < ROUNDS + FILLERS:
            best = fitting.groupBy("pattern").agg(F.max(F.struct("size", (-F.col("at")).alias("back"))).alias("b")).select("pattern", F.col("b.size").alias("size"), (-F.col("b.back")).alias("at"))
        else:
            best = open_rows.groupBy("pattern", "gap").agg(F.min(F.struct("size", "at")).alias("b")).where("b.size < 2 * gap").select("pattern", "b.size", "b.at")
        found = tables.keep(best)
        out = found if out is None else out.unionByName(found)
        used = found.groupBy("pattern").agg(F.sum("size").alias("used"))
        gaps = tables.keep(gaps.join(used, "pattern", "left").select("pattern", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")))
        if gaps.where("gap > 0").isEmpty():
            break
    return out.select("at")


def mix(rows: DataFrame, targets: DataFrame, tables: _common.Tables, most: int = MOST) -> DataFrame:
    """rows with ``taken`` (words, repeats counted) and ``by_source``, array<struct<source, words>>.

    rows: doc_id, sources, size, draw as from ``sized``; targets: source, nth, target as from ``quotas``.
    """
    rows = rows.withColumn("sources", F.array_sort(F.array_distinct("sources")))
    order = placed(rows.withColumn("pattern", F.to_json("sources")), tables, ["pattern", "draw", "doc_id", "size"])
    patterns = order.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"))
    patterns = tables.keep(patterns.where("words > 0"))
    flows = routed(patterns, targets, tables, most)
    total = F.coalesce(F.element_at("flows.upto", -1), F.lit(0))
    plan = tables.keep(patterns.join(flows, "pattern", "left").select("pattern", "words", "flows", (total / F.col("words")).cast("long").alias("copies"), (total % F.col("words")).alias("rest")))
    summed = tables.keep(running_sum(order.where("size > 0"), "pattern", "size").join(plan.select("pattern", "rest"), "pattern").withColumn("prefix", F.col("upto") <= F.col("rest")))
    gaps = summed.groupBy("pattern", "rest").agg(F.max(F.when(F.col("prefix"), F.col("upto"))).alias("upto")).select("pattern", (F.col("rest") - F.coalesce("upto", F.lit(0))).alias("gap"))
    more = _filled(summed.where("NOT prefix").select("pattern", "at", "size"), tables.keep(gaps), tables).withColumn("filler", F.lit(True))
    marks = summed.select("at", "upto", "prefix").join(more, "at", "left").select("at", "upto", (F.col("prefix") | F.coalesce("filler", F.lit(False))).alias("again"))
    both = order.join(plan.drop("rest"), "pattern", "left").join(marks, "at", "left")
    times = F.coalesce(F.col("copies") + F.col("again").cast("long"), F.lit(0))
    middle = lambda copy: copy * F.col("words") + F.col("upto") - F.col("size") / 2
    owner = lambda copy: F.coalesce(F.get(F.filter("flows", lambda f: f["upto"] > middle(copy)), 0), F.element_at("flows", -1))["source"]
    routes = F.when(times > 0, F.transform(F.sequence(F.lit(0).cast("long"), times - 1), lambda c: F.struct(owner(c).alias("source"), F.col("size").alias("words"))))
    return both.select("doc_id", "sources", "size", (times * F.col("size")).alias("taken"), F.coalesce(routes, F.array().cast("array<struct<source:string,words:bigint>>")).alias("by_source"))


def mix_sources(docs: DataFrame, sources: Column, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The mixed documents as from ``mix``, and their sources' words and targets as from ``quotas``."""
    tables = _common.Tables(docs.sparkSession, "mixing")
    rows = tables.keep(sized(docs, sources))
    per_source = rows.select(F.explode(F.array_distinct("sources")).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("words"))
    targets = tables.keep(quotas(per_source, tables, weights, share, most))
    return mix(rows, targets, tables, most), targets


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each source with its own."""
    _common.tune(spark)
    mixed, targets = mix_sources(_common.documents(spark, sf_dir), F.array("source"))
    own = targets.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target")
    out = mixed.join(own, F.element_at("sources", 1).eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", "taken")
