"""Small record tables for tests and trials, from a fixed seed."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from strandlake.functions.dna import random_bases
from strandlake.schemas import ALIGNER_INPUT, CONTIG, MAPPING, READ


def fastq_read(name: str, bases: str, quality: str = "") -> dict:
    return {"fastq": {"id": name, "read": bases, "qvalue": quality}, "fasta": None}


def mapping(contig: str, read: str, start: int = 0, end: int = 4, mismatches: int = 0) -> dict:
    return {"contig_id": contig, "read_id": read, "contig_start": start, "contig_end": end, "num_mismatches": mismatches, "read": None, "read_clear_start": 0, "read_clear_end": 0}


def assembly(spark: SparkSession, n: int = 2, seed: int = 7) -> dict[str, DataFrame]:
    """n contigs, n reads of five bases and one mapping for each: nodes, reads, alignments."""
    rng = random.Random(seed)
    nodes = [{"node_id": f"contig{k:02d}", "sequence": "ACTCG", "coverage": 1.0, "edges": []} for k in range(n)]
    reads = [fastq_read(f"read{k:02d}", random_bases(rng, 5)) for k in range(n)]
    maps = [mapping(f"contig{k:02d}", f"read{k:02d}") for k in range(n)]
    return {"nodes": spark.createDataFrame(nodes, CONTIG), "reads": spark.createDataFrame(reads, READ), "alignments": spark.createDataFrame(maps, MAPPING)}


def aligner_input(spark: SparkSession, n: int = 10, reference_length: int = 100, query_length: int = 10, seed: int = 7) -> DataFrame:
    """One row: n random references, and as queries a random substring of each."""
    rng = random.Random(seed)
    references, queries = [], []
    for k in range(n):
        bases = random_bases(rng, reference_length)
        at = rng.randrange(reference_length - query_length + 1)
        references.append({"fastq": None, "fasta": {"id": f"ref{k}", "read": bases}})
        queries.append(fastq_read(f"query{k}", bases[at : at + query_length], "I" * query_length))
    return spark.createDataFrame([{"reference": references, "query": queries}], ALIGNER_INPUT)
