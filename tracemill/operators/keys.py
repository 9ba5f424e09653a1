"""Content-addressed keys of proposals, and ordered hashing of long groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_CHARS = 20


def reference(prefix: str = "") -> Column:
    """What a key holds of a piece of evidence."""
    return F.concat_ws(":", *(F.col(f"{prefix}{c}").cast("string") for c in ("source", "path", "line", "kind")))


def key_of(parts: list[Column], references: Column) -> Column:
    """The first digits of the SHA-256 of the parts and references, in order, with NUL between them."""
    return F.left(F.sha2(F.concat_ws("\x00", *parts, references), 256), F.lit(KEY_CHARS))


#: References that one block holds at most. A block is what the one task of a group reads.
BLOCK = 1 << 14


def _blocks(ordered: DataFrame) -> DataFrame:
    """group, at, head, n, refs: runs of a group's references within a sorted partition, each as one piece of bytes."""

    def run(batches: Iterable[pa.RecordBatch]):
        name, at, head, held = None, 0, "", []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), pa.array([head]), pa.array([len(held)]), pa.array(["\0".join(held).encode()], pa.binary())], ["group", "at", "head", "n", "refs"])

        for batch in batches:
            for g, h, ref, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (g != name or len(held) == BLOCK):
                    yield block()
                    held = []
                if not held:
                    name, at, head = g, place, h
                held.append(ref)
        if held:
            yield block()

    return ordered.mapInArrow(run, "group string, at long, head string, n long, refs binary")


def stream_keys(rows: DataFrame, group: str, head: Column, order: list[str]) -> DataFrame:
    """(group, key) over all rows of each group, however many, in their order.

    Rows are sorted over range partitions, which cut a hot group anywhere, and executors pack them into blocks of bytes.
    SHA-256 is sequential, so a group's blocks go through one task; it reads a row for each ``BLOCK`` references.
    """
    names = [f"o{n}" for n in range(len(order))]
    picked = rows.select(F.col(group).cast("string").alias("group"), head.alias("head"), reference().alias("ref"), *(F.col(c).alias(n) for c, n in zip(order, names, strict=True)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = picked.repartitionByRange(parts, "group", *names).sortWithinPartitions("group", *names).select("group", "head", "ref", F.monotonically_increasing_id().alias("at"))
    dealt = _blocks(ordered).repartition("group").sortWithinPartitions("group", "at")

    def run(batches: Iterable[pa.RecordBatch]):
        name, digest, out = None, None, []
        for batch in batches:
            for g, h, refs in zip(*(batch.column(c).to_pylist() for c in ("group", "head", "refs")), strict=True):
                if g != name or digest is None:
                    if digest is not None:
                        out.append((name, digest.hexdigest()[:KEY_CHARS]))
                    name, digest = g, hashlib.sha256(h.encode())
                digest.update(b"\0" + refs)
        if digest is not None:
            out.append((name, digest.hexdigest()[:KEY_CHARS]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["group", "proposal_key"])

    return dealt.mapInArrow(run, "group string, proposal_key string")
