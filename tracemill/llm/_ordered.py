"""Orders over whole tables without one task for them: range partitions, and what lies before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.llm import _common

#: Bits of a place that count rows within a partition (as in monotonically_increasing_id).
ROW_BITS = 33


def placed(df: DataFrame, tables: _common.Tables, order: list[Column | str], at: str = "at") -> DataFrame:
    """df as a table with its place in the order: range partition, and row in it. Rows that are equal in ``order`` may
    stand in any order, but the table is written, so it is read alike ever after."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))


def part_of(at: str = "at") -> Column:
    return F.shiftright(F.col(at), ROW_BITS).cast("int")


def running_sum(rows: DataFrame, key: str, amount: str, at: str = "at", name: str = "upto") -> DataFrame:
    """The sum of ``amount`` over the rows of a key up to and including each, in the order of ``at``.

    A key is summed within its stretch of each range partition; then stretches, at most one a partition, are summed."""
    part = "part_"
    cut = rows.withColumn(part, part_of(at))
    sums = cut.groupBy(part, key).agg(F.sum(amount).alias("own_"))
    before = sums.select(part, key, (F.sum("own_").over(W.partitionBy(key).orderBy(part)) - F.col("own_")).alias("before_"))
    within = cut.withColumn("within_", F.sum(amount).over(W.partitionBy(part, key).orderBy(at).rowsBetween(W.unboundedPreceding, 0)))
    return within.join(before, [part, key]).withColumn(name, F.col("within_") + F.col("before_")).drop(part, "within_", "before_")


def numbered(df: DataFrame, tables: _common.Tables, order: list[Column | str], name: str = "nth") -> DataFrame:
    """df as a table with each row's number from 0. What is added up apart is one row for each partition."""
    rows = placed(df, tables, order, "at_").withColumn("part_", part_of("at_"))
    counts = rows.groupBy("part_").agg(F.count("*").alias("own_"))
    before = counts.select("part_", (F.sum("own_").over(W.partitionBy(F.lit(0)).orderBy("part_")) - F.col("own_")).alias("before_"))
    return tables.keep(rows.join(before, "part_").withColumn(name, F.col("at_").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("before_")).drop("at_", "part_", "before_"))
