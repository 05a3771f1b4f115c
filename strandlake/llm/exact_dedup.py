"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one finds the hash positions that at least two rows set and keeps them as bitmaps: a Bloom filter of the *possibly
repeated* hashes. Each task packs its rows' positions, eight bytes a row, into one array for each of a fixed number of
groups of blocks, and drops what it has twice already; so a key that many rows share comes at most twice from a task,
and as many rows shuffle as there are tasks times groups, however many documents there are.
Pass two tests every row against the filter. Rows outside are unique and pass straight through; only the others, as
narrow (id, hash) rows, shuffle, and they are compared by their full SHA-256.

Texts never shuffle: decisions are made on narrow rows and come back as bitmaps of row places (``store.marked``).

The filter is blocked: both of a row's positions lie in one 4 KiB bitmap, so that one lookup decides. It takes two bytes
a row; up to ``BROADCAST_BYTES`` it is broadcast, beyond that narrow rows and bitmaps meet by a shuffle on the block
number. The result is the same.

Defined cases: a null text counts as the empty text; a very long text is hashed whole. Of equal texts the row with the
largest id stays, a null id being the smallest; of rows equal in id and text one stays. An empty table gives an empty
result. Columns of the input may have any names and keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import BITMAP_BITS, BROADCAST_BYTES, addressed, bit_is_set, fresh, group_lookup, marked, marks, own, row_salt, stash

#: Filter bits for each row: about 1.4 % of the unique rows shuffle needlessly.
BITS_PER_ROW = 16
#: Groups of blocks that a task packs positions into; more only where a group would hold more than so many rows.
GROUPS, GROUP_ROWS = 64, 1 << 20


def text_key(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _positions(blocks: int, *keys: str) -> dict[str, Column]:
    h = F.xxhash64(F.lit(7), *keys)
    return {
        "_block": F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(blocks)),
        "_bit1": F.pmod(h, F.lit(BITMAP_BITS)),
        "_bit2": F.pmod(F.shiftrightunsigned(h, 32), F.lit(BITMAP_BITS)),
    }


def packed_positions(keys: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """(_group, _cells): what pass one shuffles, one row for each task and group; and the number of blocks.

    A cell is a row's block and both its bits in one long. Cells that a task has twice or more come twice, others once.
    """
    blocks = max(1, -(-rows * BITS_PER_ROW // BITMAP_BITS))
    groups = max(GROUPS, rows // GROUP_ROWS)
    low, high = F.least("_bit1", "_bit2"), F.greatest("_bit1", "_bit2")
    cell = F.shiftleft("_block", 30).bitwiseOR(F.shiftleft(low, 15)).bitwiseOR(high).alias("_cell")
    flat = keys.select(key).withColumns(_positions(blocks, key)).select(F.spark_partition_id().alias("_task"), F.pmod("_block", F.lit(groups)).alias("_group"), cell)
    packed = flat.groupBy("_task", "_group").agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))
    again = F.filter("_cells", lambda x, i: (i > 0) & (x == F.get("_cells", i - 1)))
    return packed.select("_group", F.concat(F.array_distinct("_cells"), F.array_distinct(again)).alias("_cells")), blocks


def repeated_filter(keys: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """Bitmaps of the positions that at least two rows set, and the number of blocks that positions are taken from."""
    packed, blocks = packed_positions(keys, key, rows)
    cells = packed.repartition("_group").select("_group", F.explode("_cells").alias("_cell"))
    low, high, mask = F.shiftright("_cell", 15), F.col("_cell"), F.lit(BITMAP_BITS - 1)
    bits = F.array_distinct(F.array(low.bitwiseAND(mask), high.bitwiseAND(mask)))
    each = cells.select("_group", F.shiftright("_cell", 30).alias("_block"), F.explode(bits).alias("_bit"))
    twice = each.groupBy("_group", "_block", "_bit").agg(F.count("*").alias("n")).filter("n >= 2")  # by group already: no exchange
    made = twice.groupBy("_group", "_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    return stash(made.select("_block", "_bits"), "bloom"), blocks


def may_hold(rows: DataFrame, keys: list[str], among: DataFrame, n: int) -> DataFrame:
    """``rows`` but for those whose keys are surely not among the ``n`` of ``among``.

    The filter is broadcast and never larger than BROADCAST_BYTES; where that is too little, more rows pass.
    """
    blocks = min(max(1, -(-n * BITS_PER_ROW // BITMAP_BITS)), max(1, BROADCAST_BYTES * 8 // BITMAP_BITS))
    cells = among.select(keys).withColumns(_positions(blocks, *keys)).select("_block", F.explode(F.array("_bit1", "_bit2")).alias("_bit"))
    bloom = cells.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.withColumns(_positions(blocks, *keys)).join(F.broadcast(bloom), "_block")
    return met.filter(bit_is_set(F.col("_bits"), F.col("_bit1")) & bit_is_set(F.col("_bits"), F.col("_bit2"))).select(rows.columns)


def mark_possible(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Narrow ``rows`` with a boolean ``_possible``: false only where no other row has the same key."""
    small = blocks * BITMAP_BITS // 8 <= BROADCAST_BYTES
    met = rows.withColumns(_positions(blocks, key)).join(F.broadcast(bloom) if small else bloom, "_block", "left")
    possible = bit_is_set(F.col("_bits"), F.col("_bit1")) & bit_is_set(F.col("_bits"), F.col("_bit2"))
    return met.withColumn("_possible", possible).drop("_block", "_bit1", "_bit2", "_bits")


def _judged(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (_id, _key, and _file and _at, which order rows of equal ids) in two parts: the unique ones, and the others with ``_best`` (the
    place of the row that stays) and ``_n``."""
    bloom, blocks = repeated_filter(narrow, "_key", narrow.count())
    tested = mark_possible(narrow, "_key", bloom, blocks)
    maybe = tested.filter("_possible").drop("_possible").withColumn("_salt", row_salt("_file", "_at"))
    met = group_lookup(maybe, ["_key"], "_salt", F.max(F.struct("_id", "_file", "_at")).alias("_best"), F.count("*").alias("_n"))
    return tested.filter(~F.col("_possible")).drop("_possible"), met


def _stays() -> Column:
    return (F.col("_best._file") == F.col("_file")) & (F.col("_best._at") == F.col("_at"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256 (see the module for the defined cases)."""
    narrow = docs.select(F.col(doc_id).alias("_id"), text_key(text).alias("_key"), F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    unique, met = _judged(stash(narrow, "dedup"))
    unique = unique.withColumns({"_keep": F.col("_id"), "_n": F.lit(1).cast("long"), "_kept": F.lit(True)})
    met = met.withColumns({"_keep": F.col("_best._id"), "_kept": _stays()})
    columns = [F.col("_id").alias(doc_id), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.lower(F.hex("_key")).alias("text_sha256")]
    return unique.select(columns).unionAll(met.select(columns))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. No whole row shuffles."""
    wide, file, at = addressed(docs)
    narrow = stash(wide.select(F.col(doc_id).alias("_id"), text_key(text).alias("_key"), F.col(file).alias("_file"), F.col(at).alias("_at")), "dedup")
    _, met = _judged(narrow)
    gone = marks(met.filter(~_stays()), "_file", "_at", F.lit(True))
    (lost,) = fresh(wide, "_lost")
    return marked(wide, file, at, gone, narrow.count(), 1, lost).filter(F.col(lost) == 0).select(*own(docs))
