"""Sharding by Karmarkar-Karp differencing: equal bytes over a fixed number of shards, groups of equal texts unsplit.

A partial partition is a vector of one sum for each shard. Differencing takes the two of largest spread and adds them in
opposite order, until one is left. One task cannot hold all groups, so the groups fall into size classes, each 256 times
smaller than the one before, and each class into buckets of bounded size by hash. Classes run from large to small; every
bucket differences its own groups together with its share of the imbalance that the larger classes left (the anchor, a
partial partition like any other, which fixes the order of the shards). The smallest groups come last and level out what
is left, so nothing has to be combined over buckets.

Rows of a group are numbered over salted cells, so a group of any number of copies is spread over many tasks.

Defined cases: a null text has no bytes (size 8); null texts and empty texts are equal; a very long one counts whole. Rows
equal in id and text each get a slot of their own; groups of equal bytes go by their texts' hash. An empty table gives an
empty result. A group larger than a fair shard makes its shard as large as that. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.differencing import difference
from strandlake.llm.store import row_salt, stash

#: Groups of one differencing, and the ratio of neighbouring size classes.
BUCKET_GROUPS = 4096
CLASS_RATIO = 256


def _assign(groups: DataFrame, shards: int, anchor: np.ndarray) -> DataFrame:
    """(key, n, bytes, bucket) with ``shard`` and ``base``, the group's first slot within (bucket, shard)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pdf["shard"] = difference(pdf["bytes"].to_numpy(dtype=float), shards, anchor).astype("int32")
        pdf["base"] = pdf.groupby("shard")["n"].cumsum() - pdf["n"]
        return pdf[["key", "n", "bytes", "bucket", "shard", "base"]]

    return groups.groupBy("bucket").applyInPandas(one, "key binary, n long, bytes long, bucket long, shard int, base long")


def _classes(total: int, shards: int) -> Iterator[tuple[float, float]]:
    """Size ranges [low, high), from large to small."""
    high, low = float("inf"), total / shards / CLASS_RATIO
    while high > 1:
        yield (low if low > 1 else 0.0), high
        high, low = low, low / CLASS_RATIO


def place(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("key"), F.monotonically_increasing_id().alias("_row"))
    rows = stash(rows.withColumn("_salt", row_salt("_row")), "rows")

    cells = stash(rows.groupBy("key", "_salt").agg(F.count("*").alias("n"), F.first("size").alias("size")), "cells")
    groups = stash(cells.groupBy("key").agg(F.sum("n").alias("n"), (F.first("size") * F.sum("n")).alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0

    anchor, done = np.zeros(shards), []
    for at, (low, high) in enumerate(_classes(total, shards)):
        own = groups.filter((F.col("bytes") >= low) & (F.col("bytes") < high))
        count = own.count()
        if not count:
            continue
        buckets = -(-count // BUCKET_GROUPS)
        own = own.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        placed = stash(_assign(own, shards, anchor / buckets).withColumn("class", F.lit(at)), "placed")
        done.append(placed)
        sums = placed.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
        for r in sums:  # one row a shard
            anchor[r["shard"]] += r["b"]
    if not done:
        empty = rows.select(F.col("_id").alias(doc_id), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
        return empty.filter(F.lit(False))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionAll(more)
    # slots: buckets one after the other in each shard, groups within, salted cells within those, then rows
    spans = placed.groupBy("class", "bucket", "shard").agg(F.sum("n").alias("m"))
    ahead = F.sum("m").over(Window.partitionBy("shard").orderBy("class", "bucket")) - F.col("m")
    placed = placed.join(stash(spans.withColumn("ahead", ahead).drop("m"), "spans"), ["class", "bucket", "shard"]).select("key", "shard", (F.col("ahead") + F.col("base")).alias("first"))
    by_salt = cells.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_salt", "n"))).alias("c"))
    starts = F.expr("transform(c, (x, i) -> struct(x._salt AS _salt, aggregate(slice(c, 1, i), 0L, (a, y) -> a + y.n) AS skip))")
    cell_first = placed.join(by_salt.withColumn("c", starts), "key").select("key", "shard", "first", F.inline("c"))
    rank = F.row_number().over(Window.partitionBy("key", "_salt").orderBy("_id", "_row")) - 1
    out = rows.join(cell_first, ["key", "_salt"]).withColumn("slot", (F.col("first") + F.col("skip") + rank).cast("long"))
    return out.select(F.col("_id").alias(doc_id), "size", "text_crc32", "shard", "slot")
