"""Validation of an overlap graph.

Every edge is a message to its destination with the last K-1 bases of the source, read on the source's strand. A check
fails if the destination does not exist, if its sequence on its strand does not begin with those bases, or if it has no
edge back: from the flipped destination strand to the flipped source strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import reverse_complement

MISSING_NODE, NO_OVERLAP, MISSING_EDGE = "MISSING_NODE", "NO_OVERLAP", "MISSING_EDGE"


def _ends(n: int) -> list[Column]:
    """The first and last ``n`` bases of a sequence read on the forward strand, then of its reverse complement; no more is ever complemented."""
    first, last = F.left("sequence", F.lit(n)), F.right("sequence", F.lit(n))
    return [first.alias("_f_head"), last.alias("_f_tail"), reverse_complement(last).alias("_r_head"), reverse_complement(first).alias("_r_tail")]


def _on(end: str, strand: str) -> Column:
    return F.when(F.col(strand) == "R", F.col(f"_r_{end}")).otherwise(F.col(f"_f_{end}"))


def _flip(strand: Column) -> Column:
    return F.when(strand == "R", "F").otherwise("R")


def validate(contigs: DataFrame, k: int, first_only: bool = False) -> DataFrame:
    """(code, source_id, dest_id, src_strand, dest_strand, message): a row for each failed check of each edge.

    ``first_only``: of an edge's failures the first. An edge to a missing node fails that check alone. Duplicate nodes
    are checked each. Edges meet destinations and back edges in two equi-joins; of a sequence only its K-1 outer bases
    leave the scan.
    """
    ends = contigs.select("node_id", "edges", *_ends(k - 1))
    out = ends.select(F.col("node_id").alias("source_id"), "_f_tail", "_r_tail", F.explode("edges").alias("e")).select("source_id", "_f_tail", "_r_tail", "e.*")
    sent = out.select("source_id", "dest_id", "src_strand", "dest_strand", _on("tail", "src_strand").alias("_tail"))
    back = out.select(F.col("dest_id").alias("source_id"), F.col("source_id").alias("dest_id"), _flip(F.col("dest_strand")).alias("src_strand"), _flip(F.col("src_strand")).alias("dest_strand"))
    back = back.distinct().withColumn("_back", F.lit(True))
    nodes = ends.select(F.col("node_id").alias("dest_id"), "_f_head", "_r_head", F.lit(True).alias("_exists"))
    met = sent.join(nodes, "dest_id", "left").join(back, ["source_id", "dest_id", "src_strand", "dest_strand"], "left")
    missing = F.col("_exists").isNull()
    apart = ~missing & ~F.coalesce(_on("head", "dest_strand") == F.col("_tail"), F.lit(False))
    lonely = ~missing & F.col("_back").isNull()
    codes = [F.when(missing, MISSING_NODE), F.when(apart, NO_OVERLAP), F.when(lonely, MISSING_EDGE)]
    found = F.array_compact(F.array(*codes))
    if first_only:
        found = F.slice(found, 1, 1)
    text = F.create_map(F.lit(MISSING_NODE), F.lit("destination does not exist"), F.lit(NO_OVERLAP), F.lit("sequences do not overlap"), F.lit(MISSING_EDGE), F.lit("destination has no edge back"))
    return met.select(F.explode(found).alias("code"), "source_id", "dest_id", "src_strand", "dest_strand").withColumn("message", text[F.col("code")])
