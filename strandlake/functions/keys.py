"""Keys of reads and mappings.

Read ids are taken as ``library_..._mate``: the library is what precedes the first underscore, the mate id all that
precedes the last one. Both patterns are parameters, as naming schemes differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIBRARY = r"^([^_]*)"
MATE = r"^(.*)_[^_]*$"
MATE_SUFFIX = r"_([^_]*)$"


def library(read_id: Column, pattern: str = LIBRARY) -> Column:
    return F.regexp_extract(read_id, pattern, 1)


def mate_id(read_id: Column, pattern: str = MATE) -> Column:
    """The id that both reads of a pair share; an id that does not fit the pattern is its own."""
    found = F.regexp_extract(read_id, pattern, 1)
    return F.when(found != "", found).otherwise(read_id)


def mate_number(read_id: Column, pattern: str = MATE_SUFFIX) -> Column:
    return F.regexp_extract(read_id, pattern, 1)


def with_mate_id(mappings: DataFrame, pattern: str = MATE) -> DataFrame:
    return mappings.withColumn("mate_id", mate_id(F.col("read_id"), pattern))


def with_fastq_id(reads: DataFrame) -> DataFrame:
    """Reads keyed by their FASTQ id; reads without FASTQ or with a null or empty id are left out."""
    return reads.withColumn("read_id", F.col("fastq.id")).filter(F.col("read_id").isNotNull() & (F.col("read_id") != ""))


def fastq_by_id(fastq: DataFrame) -> DataFrame:
    """FASTQ records with their id as ``read_id``."""
    return fastq.select(F.col("id").alias("read_id"), "*")


def node_ids(contigs: DataFrame) -> DataFrame:
    return contigs.select("node_id")


def with_contig_id(alignments: DataFrame) -> DataFrame:
    """Alignments or pairs keyed by the contig of their nested mapping."""
    return alignments.withColumn("contig_id", F.col("bowtie_mapping.contig_id"))
