"""Incremental forms of the operators that allow it: the same functions over Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.operators import counts, joins
from strandlake.schemas import MAPPING


def arriving_mappings(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Mappings of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(MAPPING).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_counts(mappings: DataFrame) -> DataFrame:
    """Alignments per read so far; the state is one count a read (update mode)."""
    return counts.alignments_per_read(mappings)


def strands_of_arrivals(arriving: DataFrame, full: DataFrame) -> DataFrame:
    """Arriving short alignments against a static table of full ones; stateless."""
    return joins.compared_strands(full, arriving)
