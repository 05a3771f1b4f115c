"""Joins of contigs, reads and mappings.

All are equi-joins on one string key that keep duplicates: n rows and m rows of a key give n * m. Null keys match
nothing. The flat joins shuffle both sides once, or broadcast the smaller; skewed keys are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.keys import with_contig_id, with_fastq_id
from strandlake.functions.strand import strand
from strandlake.schemas import CONTIG_READ_ALIGNMENT


def _whole(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The rows of ``df`` as one struct column, with the key columns beside it."""
    return df.select(*keys, F.struct(*df.columns).alias(name))


def mapping_read_pairs(mappings: DataFrame, reads: DataFrame) -> DataFrame:
    """(read, bowtie_mapping) for each mapping and each read with its id."""
    own = reads.select(F.struct(*reads.columns).alias("read"), F.col("fastq.id").alias("read_id")).filter("read_id IS NOT NULL AND read_id <> ''")
    return _whole(mappings, "bowtie_mapping", "read_id").join(own, "read_id").select("read", "bowtie_mapping")


def mappings_and_reads(mappings: DataFrame, reads: DataFrame) -> DataFrame:
    """Alignments (graph_node null, read, bowtie_mapping)."""
    node = F.lit(None).cast(CONTIG_READ_ALIGNMENT["graph_node"].dataType).alias("graph_node")
    return mapping_read_pairs(mappings, reads).select(node, "read", "bowtie_mapping")


def alignments_and_contigs(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments with the node of their contig; those without one are left out."""
    nodes = _whole(contigs, "graph_node", "node_id")
    keyed = with_contig_id(alignments).drop("graph_node")
    return keyed.join(nodes, F.col("contig_id") == F.col("node_id")).select("graph_node", "read", "bowtie_mapping")


def nested(contigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_node, mappings): each contig row with all pairs of its id, or an empty array.

    Pairs are gathered per contig before they meet the contigs, so the join moves each contig once. A contig's pairs form
    one row and must fit a task; ``alignments_and_contigs`` is the form without that limit.
    """
    per_contig = with_contig_id(pairs).groupBy("contig_id").agg(F.collect_list(F.struct("read", "bowtie_mapping")).alias("mappings"))
    nodes = _whole(contigs, "graph_node", "node_id")
    empty = F.array().cast(per_contig.schema["mappings"].dataType)
    return nodes.join(per_contig, F.col("node_id") == F.col("contig_id"), "left").select("graph_node", F.coalesce("mappings", empty).alias("mappings"))


def contigs_reads_mappings(contigs: DataFrame, mappings: DataFrame, reads: DataFrame) -> DataFrame:
    """The composite: reads join their mappings, the pairs nest under their contigs."""
    return nested(contigs, mapping_read_pairs(mappings, with_fastq_id(reads).drop("read_id")))


def compared_strands(full: DataFrame, short: DataFrame) -> DataFrame:
    """(read_id, full_strand, short_strand) for each pair of a full and a shortened alignment of a read."""
    one = lambda df, name: df.select("read_id", strand("contig_start", "contig_end").alias(name))
    return one(full, "full_strand").join(one(short, "short_strand"), "read_id")
