"""New transcripts as a stream: the checkpoint keeps which files were read, in place of a scan's cursor.

Detection needs all of a file's lines at once, so a file is read whole when it first appears; files that still grow
belong to batch scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.config import Settings
from tracemill.sources import transcripts


def mine_new_files(spark: SparkSession, root: str, source: str, checkpoint: str, use: Callable[[DataFrame, DataFrame, int], None], settings: Settings = Settings()):
    """use(evidence, session index, batch number) for the files that appeared since; returns the finished query."""
    from tracemill.plans.scan import mine

    def batch(lines: DataFrame, number: int) -> None:
        ordered = lines.withColumn("session_ord", F.unix_micros("mtime"))  # files by time
        _, found, index = mine(ordered, settings)
        use(found, index, number)

    lines = transcripts.stream_lines(spark, root, source)
    query = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
