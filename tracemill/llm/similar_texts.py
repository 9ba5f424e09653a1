"""Groups of similar texts: SimHash components and MinHash bands propose, signatures sift what has met, exact shingle
similarity decides.

First come the fingerprints of ``simhash_dedup``, by its covering masks, verified bits and components: whatever they link
has met, without exception. Texts at a similarity of 0.8 are often further apart than the radius of the masks (some ten
bits of 64), so bands go on from there. A text's set is that of its five-word shingles: whether two texts have an equal
minimum under one permutation has their Jaccard similarity as its chance, whatever kind of edit made them differ. A band
is ``ROWS`` minima; texts that share a band have met. There are so many bands that two texts at the threshold share none
with a chance of at most ``MISS``: at a similarity of 0.8, 50 bands of eight.

Texts that have met may still be far apart: pages of one frame share many bands, and a line that is repeated often enough
makes the whole fingerprint. So a text's signature, four bits of each of its minima, goes along, and within a band or a
component a text is linked only to leaders that it is ``NEAR``. A text as ``CLOSE`` as
that to no leader becomes a leader itself. If two texts are similar and one of them has a leader, the other is near the
same leader: distances of sets add up (0.2 and 0.1), and NEAR leaves three deviations of the estimate besides. What such
links connect, and nothing else, is compared by its shingles, some hundred texts at a time, and texts at or above the
threshold are linked. Equal texts are one node throughout.

Defined results: a null text counts as empty; all empty texts are equal; a text of fewer than five words is one shingle;
a null document id never stays where another could; of repeated rows (equal id and text) one stays, any one where they
differ in other columns; those are passed on, whatever their names; ties go to the least id; an empty table gives an empty
result. A text is handled whole; a task holds its distinct shingles, eight bytes each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common
from tracemill.llm import _words as words
from tracemill.llm.components import connected_components
from tracemill.llm.simhash_dedup import near_duplicates

SHINGLE, SIMILAR, ROWS, MISS = 5, 0.8, 8, 1e-4
#: Estimated similarity to a leader from which a text needs no other, and from which it is linked; texts sifted in one go.
CLOSE, NEAR, SIFT = 0.9, 0.58, 256
#: Texts compared with one another in one go, and about how many bytes of shingles one task holds.
BLOCK, TASK_BYTES = 512, 16 << 20
BROADCAST_ROWS = 500_000
#: Hashes that more than one text may share before something is wrong.
MOST_SHARED = 10_000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of which two texts at the threshold share none with a chance of at most ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(threshold**rows, 1 - 1e-9))))


def band_keys(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands of each set of shingles, as signed longs, and its signature, two minima a byte: one line per set. All
    empty sets have the same."""
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    h, first = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    salt, factor = np.random.Generator(np.random.PCG64(0xBA4D5)).integers(0, 1 << 64, (2, bands, ROWS), dtype=np.uint64)
    out, bits = np.empty((len(sets), bands), np.uint64), np.empty((len(sets), bands * ROWS), np.uint8)
    for b in range(bands):
        key = np.full(len(sets), b, np.uint64)
        for r in range(ROWS):
            least = np.minimum.reduceat((h ^ salt[b, r]) * (factor[b, r] | np.uint64(1)), first)
            key = words.pair(key, least)
            bits[:, b * ROWS + r] = words.mix(least) & np.uint64(15)
        out[:, b] = key
    return out.view(np.int64), bits[:, ::2] << np.uint8(4) | bits[:, 1::2]


def _shingles(column: pa.Array) -> Iterable[list[np.ndarray]]:
    """The shingles of the texts, chunk by chunk."""
    data, at = _common.utf8_of(column)
    data = np.frombuffer(data, np.uint8)
    for first, end in words.chunks(at):
        h, count = words.word_hashes(data[at[first] : at[end]], np.array(at[first : end + 1]) - at[first])
        yield [words.ngrams(x, SHINGLE) for x in np.split(h, np.cumsum(count)[:-1])]


def bands_of(docs: DataFrame, bands: int) -> DataFrame:
    """node, bands, signature of each row: node is a hash of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, signs = (np.concatenate(x) for x in zip(*(band_keys(sets, bands) for sets in _shingles(batch.column(1))), strict=True))
        at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1))), pa.array([x.tobytes() for x in signs], pa.binary())], ["node", "bands", "signature"])

    return docs.select("node", "text").mapInArrow(_common.per_batch(run), "node long, bands array<long>, signature binary")


def _met(batches: Iterable[pa.RecordBatch]):
    """Of sorted rows (band, node) those whose band has more than one."""
    band, node, told = None, None, False  # the last row, and whether it went out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, who = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        if band is not None and not told:
            key, who = np.r_[band, key], np.r_[node, who]
            first_told = False
        else:
            first_told = band is not None and key[0] == band  # its band's other rows are out
        same = key[1:] == key[:-1]
        shared = np.r_[first_told, same] | np.r_[same, False]
        band, node, told = key[-1], who[-1], bool(shared[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(who[shared])], ["band", "node"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of signatures (four bits agree by chance in a sixteenth of the cases)."""
    out = np.empty((len(a), len(b)), np.float32)
    for at in range(0, len(b), SIFT):
        out[:, at : at + SIFT] = (a[:, None, :] == b[None, at : at + SIFT, :]).mean(axis=2, dtype=np.float32)
    return (out - 1 / 16) / (15 / 16)


class _Leaders:
    """The leaders of one band, and which of them are connected already."""

    def __init__(self):
        self.nodes, self.signs, self.label = np.empty(0, np.int64), None, np.empty(0, np.int64)

    def meet(self, nodes: np.ndarray, signs: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect each text with all leaders that it is near."""
        start = len(self.nodes)
        to_old = _alike(signs, self.signs) if start else np.zeros((len(nodes), 0), np.float32)
        among = _alike(signs, signs)
        new: list[int] = []
        for k in range(len(nodes)):
            if not (to_old[k] >= CLOSE).any() and not (among[k, new] >= CLOSE).any():
                new.append(k)
        self.nodes = np.r_[self.nodes, nodes[new]]
        self.signs = signs[new] if start == 0 else np.concatenate([self.signs, signs[new]])
        self.label = np.r_[self.label, np.arange(start, start + len(new))]
        near = np.concatenate([to_old, among[:, new]], axis=1) >= NEAR
        out = []
        for k in range(len(nodes)):
            at = np.flatnonzero(near[k])
            for name, where in zip(*np.unique(self.label[at], return_index=True), strict=True):
                if self.nodes[at[where]] != nodes[k]:
                    out.append((int(self.nodes[at[where]]), int(nodes[k])))
                self.label[self.label == name] = self.label[at[0]]
        return out


def _sifted(batches: Iterable[pa.RecordBatch]):
    """Sorted rows (band, node, signature) to links between texts that are near."""
    band, leaders = None, None
    for batch in batches:
        key, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(key), -1)
        signs = np.concatenate([packed >> 4, packed & 15], axis=1)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            if key[a] != band:
                band, leaders = key[a], _Leaders()
            for at in range(a, b, SIFT):
                out += leaders.meet(node[at : min(b, at + SIFT)], signs[at : min(b, at + SIFT)])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def similar_links(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> list[tuple[int, int]]:
    """Index pairs that connect what all pairs (within sets, or across) at or above the threshold connect."""
    both = sets + (others or [])
    values, where = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    often = np.bincount(where) > 1
    column = np.cumsum(often) - 1
    sizes = np.array([len(s) for s in both], np.float64)
    common = np.zeros((len(both), len(both)), np.float32)
    keep = often[where]
    row, where = row[keep], column[where[keep]]
    for at in range(0, int(often.sum()), 1 << 13):  # a slice of the shingles at a time
        part = (where >= at) & (where < at + (1 << 13))
        held = np.zeros((len(both), min(1 << 13, int(often.sum()) - at)), np.float32)
        held[row[part], where[part] - at] = 1
        common += held @ held.T
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    if others is not None:
        near[: len(sets), : len(sets)] = near[len(sets) :, len(sets) :] = False
    label, out = np.arange(len(both)), []
    for a in range(len(both)):
        for b in np.flatnonzero(near[a]).tolist():
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                out.append((a, b))
    return out


def _compare(members: DataFrame, threshold: float, total: int) -> DataFrame:
    """(a, b) links between nodes: members has cluster, size, node, shingles."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = _common.partitions(total, TASK_BYTES)
    placed = placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles")
    placed = placed.withColumn("task", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(tasks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        cluster, i, j, own, node = (table.column(c).to_numpy() for c in ("cluster", "i", "j", "own", "node"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        cuts = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cluster)], strict=True):
            if i[a] == j[a]:
                at, found = list(range(a, b)), similar_links(sets[a:b], None, threshold)
            else:
                left, right = [k for k in range(a, b) if own[k] == i[a]], [k for k in range(a, b) if own[k] == j[a]]
                at, found = left + right, similar_links([sets[k] for k in left], [sets[k] for k in right], threshold) if left and right else []
            out += [(int(node[at[x]]), int(node[at[y]])) for x, y in found]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return placed.groupBy("task").applyInArrow(run, "a long, b long")


def keepers(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(node, keeper): for each distinct text the document that stays for its group. docs: doc_id, node, text."""
    tables = _common.Tables(docs.sparkSession, "similar")
    known = F.col("doc_id").isNotNull()
    nodes = tables.keep(docs.groupBy("node").agg(F.min(F.struct((~known).alias("unknown"), "doc_id")).alias("least")))
    banded = tables.keep(bands_of(docs, bands_for(threshold)).dropDuplicates(["node"]))
    simhash = near_duplicates(docs.select(F.col("node").alias("doc_id"), "text"))
    simhash = simhash.select(F.xxhash64("component_id").alias("band"), F.col("doc_id").alias("node")).distinct()
    places = banded.select(F.explode("bands").alias("band"), "node").unionByName(simhash)
    met = places.repartition("band").sortWithinPartitions("band", "node").mapInArrow(_met, "band long, node long")
    signed = met.join(banded.select("node", "signature"), "node").select("band", "node", "signature")
    links = signed.repartition("band").sortWithinPartitions("band", "node").mapInArrow(_sifted, "a long, b long").distinct()
    clusters = connected_components(links, tables)
    clusters = clusters.select("node", F.col("root").alias("cluster"))
    clusters = tables.keep(clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("size")), "cluster"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            sets = [np.unique(x).tobytes() for chunk in _shingles(batch.column(1)) for x in chunk]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    members = clusters.count()
    only = clusters.select("node")
    texts = docs.select("node", "text").join(F.broadcast(only) if members <= BROADCAST_ROWS else only, "node", "left_semi")
    shingled = texts.mapInArrow(_common.batches_with_rows(run), "node long, shingles binary").dropDuplicates(["node"])
    shingled = tables.keep(shingled.join(clusters, "node").select("cluster", "size", "node", "shingles"))
    total = shingled.agg(F.sum(F.octet_length("shingles") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0
    groups = connected_components(_compare(shingled, threshold, total), tables)
    named = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("least").alias("least"))
    return tables.keep(named.select("node", "root").join(best, "root").select("node", F.col("least.doc_id").alias("keeper")))


def _node_of(docs: DataFrame, tables: _common.Tables) -> Column:
    """A number for each distinct text of the column ``text``: a hash of 64 bits, and another one where two texts share it.

    Among n texts about n * n / 2**65 hashes are shared: some hundred among 10**11 texts, which are listed in the plan.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node, exact = F.xxhash64(text), F.sha2(text, 256)
    both = docs.select(node.alias("node"), exact.alias("exact")).groupBy("node").agg(F.min("exact").alias("least"), F.max("exact").alias("most"))
    shared = [r.node for r in both.where("least <> most").select("node").limit(MOST_SHARED + 1).collect()]
    if len(shared) > MOST_SHARED:
        raise ValueError("far more texts share a hash than chance allows")
    return F.when(node.isin(shared), F.xxhash64(exact)).otherwise(node) if shared else node


def deduplicate(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of similar texts the least doc_id."""
    tables = _common.Tables(docs.sparkSession, "stays")
    own_id, own_node, gone_id, gone_node, nth = _common.free_names(docs, "own_id", "own_node", "gone_id", "gone_node", "nth")
    node, doc_id = _node_of(docs, tables), F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), node.alias("node"))
    keep = keepers(rows, threshold)
    placed = tables.keep(rows.select("doc_id", "node"))
    stays = tables.keep(placed.join(keep, "node").where(F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "node").agg(F.count("*").alias("n")))
    facts = stays.agg(F.max("n").alias("most")).first()
    goes = placed.join(stays, ["node"], "left_anti").unionByName(placed.join(keep, "node").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "node"))
    goes = tables.keep(goes.select(F.col("doc_id").alias(gone_id), F.col("node").alias(gone_node)).distinct())
    few = goes.count() <= BROADCAST_ROWS
    out = docs.withColumns({own_id: doc_id, own_node: node})
    out = out.join(F.broadcast(goes) if few else goes, (F.col(own_node) == F.col(gone_node)) & F.col(own_id).eqNullSafe(F.col(gone_id)), "left_anti")
    if (facts.most or 0) > 1:  # rows that are equal in id and text: one of them stays
        out = out.withColumn(nth, F.row_number().over(W.partitionBy(own_id, own_node).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return out.select(*docs.columns)
