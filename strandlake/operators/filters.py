"""Filters of contigs and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contigs_by_length(contigs: DataFrame, min_length: int = 0, sequence: str = "sequence") -> DataFrame:
    """Contigs of at least this length. A null sequence is not long enough for any length."""
    return contigs.filter(F.length(sequence) >= min_length)


def mappings_by_contigs(mappings: DataFrame, ids: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Mappings whose contig is among ``ids``, each once. A semi-join; the planner broadcasts the ids if they are few."""
    wanted = ids.select(F.col(node_id).alias("_contig"))
    return mappings.join(wanted, F.col("contig_id") == F.col("_contig"), "left_semi")
