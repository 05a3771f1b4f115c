"""Exact counts of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alignments_per_read(mappings: DataFrame) -> DataFrame:
    """(read_id, num_alignments); only the key is read, and counts combine before the shuffle."""
    return mappings.groupBy("read_id").agg(F.count("*").alias("num_alignments"))
