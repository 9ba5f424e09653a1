"""The index of sessions: JSON lines for readers, and the keys on record in buckets, so that a run reads few of them.

A key (path and end of a session) has a bucket by its hash. A run looks up its sessions in the buckets that they fall in and
opens no other; where they are few, their hashes reach the Parquet reader, whose Bloom filters pass over row groups that
hold none of them. A bucket that has gathered many small files is written anew as one.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans import lifecycle
from tracemill.plans.commit import Commit
from tracemill.sources import shared

FIELDS = ["source", "path", "session_id", "cwd", "started_at", "ended_at", "tool_call_count", "pp_cli_names", "skill_names", "slash_commands", "failure_count", "silent_empty_count", "correction_count"]
LINES, KEYS = "session-index.jsonl", "session-keys"
KEY = "path string, ended_at string, key long, bucket int"
BUCKETS, FILES, FEW = 64, 8, 10


def keyed(rows: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "ended_at")]
    key = F.xxhash64(*text)
    return rows.withColumns({"key": key, "bucket": F.pmod(key, F.lit(BUCKETS)).cast("int")})


def on_record(spark: SparkSession, root: Path, wanted: DataFrame) -> DataFrame:
    """The keys on record that ``wanted`` (key, bucket) may be among; only its buckets are opened."""
    if not (root / KEYS).exists():
        old = spark.read.schema("path string, ended_at string").json(str(root / LINES)) if (root / LINES).exists() else spark.createDataFrame([], "path string, ended_at string")
        return keyed(old)
    touched = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())  # at most BUCKETS
    known = spark.read.schema(KEY).parquet(str(root / KEYS)).where(F.col("bucket").isin(touched))
    few = [r.key for r in wanted.select("key").limit(FEW + 1).collect()]
    return known.where(F.col("key").isin(few)) if len(few) <= FEW else known


def _write_keys(keys: DataFrame, path: Path) -> None:
    keys.select("path", "ended_at", "key", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").parquet(str(path))


def stage_new(spark: SparkSession, index: DataFrame, root: Path, commit: Commit) -> int:
    """Stage the sessions that are not on record with the same end, written by the executors; return how many.

    Several of this run with one key all go on record."""
    rows = shared.keep(keyed(index.select(*sorted(FIELDS), "session_ord")), "indexed")
    known = on_record(spark, root, rows)
    first_keys = not (root / KEYS).exists()
    new = shared.keep(lifecycle.new_rows(rows, known), "new-sessions")
    new.orderBy("session_ord").select(*sorted(FIELDS)).write.option("ignoreNullFields", False).json(str(commit.path(LINES)))
    _write_keys(new.select("path", "ended_at", "key", "bucket").unionByName(known) if first_keys else new, commit.path(KEYS))
    _compact(spark, root, commit)
    return new.count()


def _compact(spark: SparkSession, root: Path, commit: Commit) -> None:
    """Buckets with more than FILES files, this run's included, are written as one."""
    for staged in sorted(commit.stage.glob(f"{KEYS}/bucket=*")):
        old = sorted((root / KEYS / staged.name).glob("part-*"))
        if len(old) < FILES:
            continue
        parts = spark.read.parquet(*map(str, [*old, *staged.glob("part-*")]))
        kept = shared.keep(parts, "bucket")
        for part in staged.glob("part-*"):
            part.unlink()
        kept.coalesce(1).write.mode("append").option("parquet.bloom.filter.enabled#key", "true").parquet(str(staged))
        for part in old:
            commit.remove(part.relative_to(root).as_posix())
