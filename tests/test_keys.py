"""Keys over long groups: hashed in order, block by block."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracemill.operators import content, evidence, keys


@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(keys, "BLOCK", block)
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.lit("claude").alias("source"), F.concat(F.lit("/p"), F.col("id") % 11).alias("path"), (F.col("id") * 7919 % n).alias("line"), F.lit("ké").alias("kind"))
    got = {r.group: r.proposal_key for r in keys.stream_keys(rows.repartition(5), "g", F.concat(F.lit("head\0"), F.col("g")), ["line", "path"]).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.line, r.path)):
        want.setdefault(r.g, [f"head\0{r.g}"]).append(f"{r.source}:{r.path}:{r.line}:{r.kind}")
    assert got == {g: hashlib.sha256("\0".join(parts).encode()).hexdigest()[: keys.KEY_CHARS] for g, parts in want.items()}


def test_the_task_of_a_group_reads_blocks(spark):
    """A group of many rows reaches its one task as a row for each block."""
    n = 200_000
    rows = spark.range(n).select(F.lit("hot").alias("group"), F.lit("h").alias("head"), F.col("id").cast("string").alias("ref"), F.col("id").alias("at"))
    blocks = keys._blocks(rows.repartitionByRange(4, "group", "at").sortWithinPartitions("group", "at")).select("n").collect()
    assert sum(b.n for b in blocks) == n and len(blocks) <= n / keys.BLOCK + 4


@pytest.mark.parametrize("hot", [True, False])
def test_most_used_names(spark, monkeypatch, hot):
    """The sketch proposes, exact counts decide, ties go to the one met first, and what can't be proved is counted whole."""
    monkeypatch.setattr(content, "TRACKED", 300)
    monkeypatch.setattr(content, "CANDIDATES", 20)
    counted, whole = [], content._counted
    monkeypatch.setattr(content, "_counted", lambda rows, most: counted.append(1) or whole(rows, most))
    n = 6000
    name = F.when((F.col("id") % 2 == 0) & F.lit(hot), F.concat(F.lit("hot"), F.col("id") % 12)).otherwise(F.concat(F.lit("rare"), F.col("id") % 2500))
    rows = spark.range(n).select(name.alias("name"), *((F.col("id") * 7919 % n).alias(c) if c == "line" else F.lit(0).alias(c) for c in evidence.ORDER)).repartition(6)
    got = [(r.name, r.n) for r in content.ranked_names(rows).orderBy("place").collect()]
    first = {}
    for r in rows.collect():
        count, at = first.get(r.name, (0, r.line))
        first[r.name] = (count + 1, min(at, r.line))
    want = sorted(((k, c, at) for k, (c, at) in first.items()), key=lambda x: (-x[1], x[2]))[:10]
    if hot:
        assert len([x for x in first if x.startswith("hot")]) == 6  # four places are left to the others
    assert got == [(k, c) for k, c, _ in want] and len(counted) == (2 if hot else 1)  # nothing is proposed where no name stands out
    counted.clear()
    few = rows.where("name LIKE 'hot%'")
    assert content.ranked_names(few, 3).count() == (3 if hot else 0) and len(counted) == 1
    wide = rows.unionByName(rows.where("name LIKE 'hot%'")) if hot else rows
    counted.clear()
    assert content.ranked_names(wide, 6).count() == 6 and len(counted) == 1
