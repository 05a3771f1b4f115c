"""Mate pairs and their orientation.

A mate group counts if it has exactly two mappings on one contig. The two need not be different reads unless ``strict``.
Groups are reduced by a bounded aggregate: a count, the least and greatest contig and the two outermost mappings; so a
group of any size costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.keys import LIBRARY, MATE, library, mate_id
from strandlake.functions.strand import strand

COLUMNS = ["read_id", "contig_id", "contig_start", "contig_end", "contig_left", "contig_right", "num_mismatches"]


def pairs(mappings: DataFrame, mate: Column | None = None, strict: bool = False) -> DataFrame:
    """(mate_id, left, right): the two mappings as structs, by left coordinate, then read id, then all coordinates."""
    key = mate_id(F.col("read_id"), MATE) if mate is None else mate
    low, high = F.least("contig_start", "contig_end"), F.greatest("contig_start", "contig_end")
    order = F.struct(low.alias("contig_left"), "read_id", "contig_start", "contig_end", "num_mismatches", "contig_id", high.alias("contig_right"))
    groups = mappings.select(key.alias("mate_id"), order.alias("m")).groupBy("mate_id")
    found = groups.agg(F.count("*").alias("n"), F.min("m").alias("left"), F.max("m").alias("right"), F.min("m.contig_id").alias("c1"), F.max("m.contig_id").alias("c2"))
    found = found.filter((F.col("n") == 2) & (F.col("c1") == F.col("c2")) & F.col("mate_id").isNotNull())
    if strict:
        found = found.filter(F.col("left.read_id") != F.col("right.read_id"))
    return found.select("mate_id", "left", "right")


def orientations(found: DataFrame, library_pattern: str = LIBRARY, gap: bool = False) -> DataFrame:
    """The 17-column report of pairs: orientation, distance, library and both sides.

    ``distance`` is the right mapping's left coordinate, as reports of this form have always given it; the number of bases
    between the two mappings is the extra column ``gap``, on request.
    """
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in COLUMNS]
    both = F.concat(strand(F.col("left.contig_start"), F.col("left.contig_end")), strand(F.col("right.contig_start"), F.col("right.contig_end")))
    extra = [(F.col("right.contig_left") - F.col("left.contig_right")).alias("gap")] if gap else []
    return found.select(both.alias("orientation"), F.col("right.contig_left").alias("distance"), library(F.col("left.read_id"), library_pattern).alias("library"), *side("left"), *side("right"), *extra)
