"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each the majority vote of the XXH64 values of a text's word shingles. Links: fingerprints at most
``radius`` bits apart. Candidate search: every bit position gets a vector of ``radius + 1`` bits; for each non-zero
vector v a table keeps the bits whose vector has an odd product with v. At most ``radius`` positions differ, so some v is
orthogonal to all their vectors, and in its table the two fingerprints are equal: every pair collides somewhere.

Only distinct fingerprints enter the search, so exact copies cost nothing. Colliding fingerprints are compared by their
bits; each set found yields a tree of links, not all pairs. A table entry that holds more than ``ENTRY`` fingerprints is
cut into blocks, and pairs of blocks are compared in tasks of their own. Components are found by alternating stars.

Defined results: a null or empty text has fingerprint zero; a null document id takes part and never names a component
(a component of null ids only has a null id); repeated rows are returned each; a bit that half of the votes are for is 0;
other columns are ignored, whatever their names; an empty table gives an empty result. A text is read whole, some tens of
bytes of memory for each of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import _common
from tracemill.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that are compared with one another in one go.
ENTRY = 4096

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = _WORDS.findall(text.encode().translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    return np.fromiter((digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(size)), strict=False)), np.uint64, len(words) - size + 1)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds the memory of one very long text
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([majority(shingle_hashes(x, size, seed)) for x in _common.texts_of(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_common.per_batch(run), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; positions get the non-zero vectors in turn."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _trees(x: np.ndarray, y: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what comparing all of x with one another (or x with y) connects: a forest."""
    both = x if y is None else np.concatenate([x, y])
    label, out = np.arange(len(both)), []
    other, shift = (x, 0) if y is None else (y, len(x))
    for at in range(0, len(x), 256):
        near = np.bitwise_count(x[at : at + 256, None] ^ other[None, :]) <= radius
        for row in np.flatnonzero(near.any(axis=1)).tolist():
            met = shift + np.flatnonzero(near[row])
            own = label[at + row]
            foreign, which = np.unique(label[met], return_index=True)
            keep = foreign != own
            if keep.any():
                out += [(int(both[at + row]), int(both[k])) for k in met[which[keep]].tolist()]
                label[np.isin(label, foreign[keep])] = own
    return out


def _compare_entries(radius: int):
    """Sorted rows (v, key, fp) to links; rows of entries that are too large for one go come back as they are."""

    def rows(kind: int, a, b, v) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.broadcast_to(np.asarray(v, np.int32), n))], ["kind", "a", "b", "v"])

    def run(batches: Iterable[pa.RecordBatch]):
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]  # the last entry may go on
        large = None
        for batch in _then_none(batches):
            if batch is not None:
                cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            else:
                cols = held
            v, key, fp = cols
            if not len(v):
                continue
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (key[1:] != key[:-1])])
            last = len(v) if batch is None else first[-1]
            sizes = np.diff(np.r_[first, len(v)])
            links = []
            two = first[(sizes == 2) & (first < last)]
            two = two[[(v[at], key[at]) != large for at in two]] if large else two
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            if len(two):
                yield rows(0, fp[two], fp[two + 1], 0)
            for at, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if at >= last:
                    break
                if n == 2 and (v[at], key[at]) != large:
                    continue
                if (v[at], key[at]) == large or n > ENTRY:
                    yield rows(1, fp[at : at + n], key[at : at + n], v[at])
                else:
                    links += _trees(fp[at : at + n], None, radius)
            # an entry whose first part went out as too large may end with a single row
            if large and (v[0], key[0]) == large and sizes[0] == 1 and last > 0:
                yield rows(1, fp[:1], key[:1], v[0])
            if batch is not None and len(v) - last > ENTRY:
                large = (v[last], key[last])
                yield rows(1, fp[last:], key[last:], v[last])
                last = len(v)
            held = [c[last:] for c in cols]
            if links:
                a, b = zip(*links, strict=True)
                yield rows(0, a, b, 0)

    return run


def _then_none(batches: Iterable):
    yield from batches
    yield None


def links(fps: DataFrame, tables: _common.Tables, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect just what all pairs within radius connect."""
    masks = [_signed(m) for m in covering_masks(radius)]
    entry = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks)))).alias("e")
    dealt = fps.select("fp", entry).select("e.v", "e.key", "fp").repartition("v", "key").sortWithinPartitions("v", "key", "fp")
    found = tables.keep(dealt.mapInArrow(_compare_entries(radius), "kind int, a long, b long, v int"))
    out = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select("v", F.col("b").alias("key"), F.col("a").alias("fp"))
    if large.limit(1).count():
        blocks = large.groupBy("v", "key").agg(F.ceil(F.count("*") / ENTRY).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        paired = large.join(blocks, ["v", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        paired = paired.select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

        def compare(table: pa.Table) -> pa.Table:
            own, fp, i, j = (table.column(c).to_numpy() for c in ("own", "fp", "i", "j"))
            got = _trees(fp, None, radius) if i[0] == j[0] else _trees(fp[own == i], fp[own == j], radius)
            return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([x for _, x in got], pa.int64())})

        out = out.unionByName(paired.groupBy("v", "key", "i", "j").applyInArrow(compare, "a long, b long"))
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the least doc_id that links lead to."""
    tables = _common.Tables(docs.sparkSession, "simhash")
    fps = tables.keep(fingerprints(docs, size=size, seed=seed))
    nodes = tables.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), tables, radius), tables)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    _common.tune(spark)
    found = near_duplicates(_common.documents(spark, sf_dir))
    return found.select("doc_id", _common.hex64("fp").alias("fingerprint"), "component_id")


assert len(covering_masks()) == (1 << (RADIUS + 1)) - 1
