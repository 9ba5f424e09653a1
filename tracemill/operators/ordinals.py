"""Numbers of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.sources import shared

#: Bits of monotonically_increasing_id that count rows within a partition.
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str = "nth") -> DataFrame:
    """rows with their number from 0 in the order, which must be total.

    Rows are cut into range partitions and numbered within each; what is added up across them is one count a partition.
    The ranges are written first, so that numbers and counts are of the same ranges even if a task runs again.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    placed = shared.keep(placed, "ordered").withColumn("part_", F.shiftright("at_", ROW_BITS))
    counts = placed.groupBy("part_").agg(F.count("*").alias("own_"))
    ahead = F.coalesce(F.sum("own_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    before = counts.select("part_", ahead.alias("before_"))
    within = F.col("at_").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(before, "part_").withColumn(name, within + F.col("before_")).drop("at_", "part_", "before_")
