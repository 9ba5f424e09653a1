"""Connected components of a graph given as a table of edges, by alternating stars.

Large star: every vertex sends its larger neighbours to the least vertex it knows. Small star: it sends the smaller
ones, and itself. Each round is two aggregations of minima (combined before the shuffle) and two joins; the number of
rounds grows with the logarithm of the longest path. Each round's edges go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import _common


def _star(links: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Each link (u, v) becomes (v, least neighbour of u)."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("u_")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, tables: _common.Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each vertex that has an edge to another, the least vertex it can reach. Vertices are longs."""
    links = tables.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    summary = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    state = links.select(summary).first()[0]
    while state.n:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both.where("v > u"), both).where("u > v").distinct()
        # every vertex also points at the least one itself
        small = _star(large.unionByName(large.select("u", F.col("u").alias("v")).distinct()), large).where("u > v").distinct()
        after = tables.keep(small)
        new = after.select(summary).first()[0]
        tables.drop(links)
        links = after
        if new == state:
            break
        state = new
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
