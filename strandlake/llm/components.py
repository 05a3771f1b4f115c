"""Connected components by alternating large-star and small-star steps, in DataFrame functions only.

Each step replaces the edges around a node by edges to the least node near it; after O(log n) rounds every node has one
edge to the least node of its component. A hub's edges are spread over salted keys, and only minima are aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import group_lookup, release, row_salt, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v), v < u. Large: the greater neighbours of each node move to its least; small: the lesser ones."""
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    met = group_lookup(near.withColumn("_salt", row_salt("u", "v")), ["u"], "_salt", F.min("v").alias("_least"))
    least = F.least("u", "_least")
    if large:
        moved = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), least.alias("v"))
    else:
        moved = met.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("_least").alias("v")), F.struct(F.col("u"), F.col("_least").alias("v")))))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge, with the least node it is connected to. Null ends and loops count for nothing."""
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stash(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first())
    before = mark(now)
    while before[0]:
        last, now = now, stash(_star(_star(now, True), False), "edges")
        release(last)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
