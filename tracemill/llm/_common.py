"""What the operators of this folder share: shared-folder tables, batch sizes and column checks."""

from __future__ import annotations

import atexit
import ctypes
import math
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = "2000", "8m"


def lean() -> None:
    """Give freed arrays back to the system at once: a Python worker serves one stage after another and must not keep
    what the largest of them needed. Arrow allocates like everything else; blocks of a megabyte are mapped singly."""
    if sys.platform == "linux":
        pa.set_memory_pool(pa.system_memory_pool())
        mmap_threshold, trim_threshold = -3, -1  # of mallopt
        libc = ctypes.CDLL(None)
        libc.mallopt(mmap_threshold, 1 << 20)
        libc.mallopt(trim_threshold, 4 << 20)


lean()  # each worker imports this module


def tune(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Tables:
    """Tables that cut the lineage. Each is a Parquet folder in the shared folder, so a lost executor loses nothing.

    ``drop`` removes a table as soon as no later step reads it; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop_all)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        self._remove(df._kept_at)

    def drop_all(self) -> None:
        try:
            self._remove(self.at)
        except Exception:  # the session has ended; the folder goes with the cluster's own clean-up
            pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(total: float, each: float, least: int = 1, most: int = 1 << 16) -> int:
    """How many partitions hold ``total`` at ``each`` a partition."""
    return max(least, min(most, math.ceil(total / each)))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each drawn out with underscores until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[memoryview, list[int]]:
    """All bytes of a string column, one after another, and where each row begins and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1].tolist()
    return memoryview(data if data is not None else b""), at


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f for each batch that has rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return run


def batches_with_rows(run: Callable) -> Callable:
    """run, without the empty batches."""
    return lambda batches: run(b for b in batches if b.num_rows)


def arrow_types(spark: SparkSession, ddl: str) -> list[pa.Field]:
    """The Arrow fields of a schema in Spark's notation."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(spark.createDataFrame([], ddl).schema))


def hex64(column):
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
