"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is positive. Equal codes are one entry, with its k least
ids. The distinct codes are dealt by hash into shards of at most about ``SHARD`` entries, the distinct query codes into
blocks of about ``BLOCK``, or as many as keep the cluster busy while the copies of the index stay few. In each shard a
code is filed under the value of each of its segments, which have about log2 n bits among n codes, so that a value holds
about one code and there are no more values than codes. A query looks up, segment after segment, the values at distance
0, then 1, and so on: after segment a (from 0) at distance s of m segments, every code within m * s + a bits has been met.
It stops when its kth verified distance is no larger. Shards' answers are merged.

Defined results: rows with a null id or a null vector are neither found nor asked for; a null or missing value gives a 0
bit, a vector of any length counts; ties in distance go to the smaller id; repeated ids stand for their nearest row; k or
fewer rows are all returned; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common

K = 10
#: Entries of a shard, queries of a block, the least that a block is split for, and rows that copies of the index may have.
SHARD, BLOCK, LEAST, COPIES = 1 << 20, 1 << 16, 128, 1 << 22
#: Fewest and most bits of a segment.
NARROWEST, WIDEST = 4, 20


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): code is the sign bits as whole bytes."""
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where("id is not null and vector is not null")
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first().n or 0
    width = -(-max(longest, 1) // 8) * 8

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        bits = np.zeros((len(sizes), width), bool)
        bits[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values > 0
        packed = np.packbits(bits, axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "code"])

    return kept.mapInArrow(_common.per_batch(run), "id long, code binary")


class MultiIndex:
    """Codes of one shard by segment value."""

    def __init__(self, packed: np.ndarray):
        self.n, bits = len(packed), packed.shape[1] * 8
        widest = min(WIDEST, max(NARROWEST, self.n.bit_length() - 1))
        self.m = -(-bits // widest)
        self.edges = [bits * a // self.m for a in range(self.m + 1)]
        self.codes = self.values(packed)
        self.order = [np.argsort(self.codes[:, a], kind="stable") for a in range(self.m)]
        self.begin = [np.searchsorted(self.codes[o, a], np.arange((1 << self.width(a)) + 1)) for a, o in enumerate(self.order)]
        self.looked_up = 0  # values that were looked up

    def width(self, a: int) -> int:
        return self.edges[a + 1] - self.edges[a]

    def values(self, packed: np.ndarray) -> np.ndarray:
        """The segments of each code as numbers."""
        bits = np.unpackbits(packed, axis=1)
        return np.stack([bits[:, a:b].astype(np.uint32) @ (np.uint32(1) << np.arange(b - a, dtype=np.uint32)[::-1]) for a, b in zip(self.edges, self.edges[1:], strict=False)], axis=1)

    def nearest(self, query: np.ndarray, k: int, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(distance, entry) of the nearest entries, until their sizes add up to k and the kth distance is covered."""
        found_d, found_e = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        held = np.zeros(self.edges[-1] + 1, np.int64)  # ids at each distance
        for s in range(max(self.width(a) for a in range(self.m)) + 1):
            for a in range(self.m):
                probes = (flips_of(self.width(a), s) ^ query[a]).astype(np.int64)
                self.looked_up += len(probes)
                low, width = self.begin[a][probes], self.begin[a][probes + 1] - self.begin[a][probes]
                if total := int(width.sum()):
                    at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(total)
                    entry = self.order[a][at]
                    apart = np.bitwise_count(self.codes[entry] ^ query)
                    new = (apart[:, :a] > s).all(axis=1) & (apart[:, a + 1 :] >= s).all(axis=1)  # met here first
                    entry, d = entry[new], apart[new].sum(axis=1, dtype=np.int64)
                    found_d.append(d)
                    found_e.append(entry)
                    np.add.at(held, d, sizes[entry])
                if held[: self.m * s + a + 1].sum() >= k:
                    return self._first(np.concatenate(found_d), np.concatenate(found_e), k, sizes)
        return self._first(np.concatenate(found_d), np.concatenate(found_e), k, sizes)

    @staticmethod
    def _first(d: np.ndarray, e: np.ndarray, k: int, sizes: np.ndarray) -> list[tuple[int, int]]:
        """All entries up to the distance at which k ids are reached; ties stay for the merge."""
        by = np.argsort(d, kind="stable")
        d, e = d[by], e[by]
        reach = np.searchsorted(np.cumsum(sizes[e]), k)
        last = np.searchsorted(d, d[min(reach, len(d) - 1)], "right") if len(d) else 0
        return list(zip(d[:last].tolist(), e[:last].tolist(), strict=True))


_flips: dict[tuple[int, int], np.ndarray] = {}


def flips_of(width: int, s: int) -> np.ndarray:
    """All numbers of ``width`` bits of which s are set."""
    if (width, s) not in _flips:
        _flips[width, s] = np.array([sum(1 << i for i in c) for c in combinations(range(width), s)], np.uint32)
    return _flips[width, s]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, match_id, distance: the k rows of vectors nearest to each row of queries."""
    tables = _common.Tables(vectors.sparkSession, "topk")
    both = vectors.select(id_col, vector_col, F.lit(False).alias("asked")).unionByName(queries.select(id_col, vector_col, F.lit(True).alias("asked")))
    coded = codes(both.select(F.col(id_col), F.col(vector_col)), id_col, vector_col)  # one width for both
    coded = tables.keep(coded.distinct())
    asked = coded.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    least = W.partitionBy("code").orderBy("id")
    entries = coded.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k)
    entries = tables.keep(entries.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    questions = tables.keep(asked.select("code").distinct())
    n, n_asked, busy = entries.count(), questions.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = _common.partitions(n, SHARD)
    blocks = max(_common.partitions(n_asked, BLOCK), min(_common.partitions(n_asked, LEAST), -(-busy // shards), COPIES // max(n, 1)))
    left = entries.select("code", "ids", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = questions.select("code", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if ours.num_rows and theirs.num_rows:
            matrix = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            index, ids = MultiIndex(matrix(ours)), ours.column("ids").to_pylist()
            sizes = np.array([len(x) for x in ids])
            asked = theirs.column("code").to_pylist()
            for code, query in zip(asked, index.values(matrix(theirs)), strict=True):
                hits = sorted((d, i) for d, e in index.nearest(query, k, sizes) for i in ids[e])
                best: dict[int, int] = {}
                for d, i in hits:
                    if i not in best and len(best) < k:
                        best[i] = d
                out += [(code, i, d) for i, d in best.items()]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"code": pa.array(cols[0], pa.binary()), "match_id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.int32())})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "code binary, match_id long, distance int")
    once = found.groupBy("code", "match_id").agg(F.min("distance").alias("distance"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("code").orderBy("distance", "match_id"))).where(F.col("rank") <= k)
    return asked.select(F.col("id").alias("query_id"), "code").join(ranked, "code").select("query_id", "rank", "match_id", "distance")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows by Hamming distance for every embedding whose id is divisible by 100, among all rows."""
    _common.tune(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP5_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS match_id,
         CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
  FROM codes q CROSS JOIN codes c WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, match_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, match_id) AS rank FROM pairs
) WHERE rank <= 10
"""
