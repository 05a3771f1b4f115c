"""One plan for each job: options in, DataFrames out, sinks at the end. ``python -m strandlake.plans.pipelines JOB --option value``."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strandlake import params
from strandlake.functions import codec, keys
from strandlake.operators import counts, filters, graph, joins, mates, tools
from strandlake.schemas import CONTIG, MAPPING, READ
from strandlake.sources import records, sequence_text


def join_contigs_and_mappings(spark: SparkSession, o: params.JoinOptions) -> dict[str, DataFrame]:
    contigs, reads, mappings = (records.read(spark, p, s, o.format) for p, s in ((o.contigs, CONTIG), (o.reads, READ), (o.mappings, MAPPING)))
    return {"joined": joins.contigs_reads_mappings(contigs, mappings, reads)}


def join_mappings_and_reads(spark: SparkSession, o: params.JoinOptions) -> dict[str, DataFrame]:
    """Alignments on contigs long enough, the contigs as FASTA and the aligned reads as FASTQ."""
    contigs = filters.contigs_by_length(records.read(spark, o.contigs, CONTIG, o.format), o.min_contig_length)
    mappings = filters.mappings_by_contigs(records.read(spark, o.mappings, MAPPING, o.format), keys.node_ids(contigs))
    reads = keys.with_fastq_id(records.read(spark, o.reads, READ, o.format)).drop("read_id")
    aligned = joins.alignments_and_contigs(joins.mappings_and_reads(mappings, reads), contigs)
    return {"alignments": aligned, "contigs.fasta": sequence_text.contig_fasta(contigs), "reads.fastq": sequence_text.alignment_fastq(aligned)}


def count_alignments(spark: SparkSession, o: params.AlignmentOptions) -> dict[str, DataFrame]:
    return {"counts": counts.alignments_per_read(records.read(spark, o.alignments, MAPPING, o.format))}


def read_orientation(spark: SparkSession, o: params.AlignmentOptions) -> dict[str, DataFrame]:
    return {"orientation": mates.orientations(mates.pairs(records.read(spark, o.alignments, MAPPING, o.format)))}


def compare_alignments(spark: SparkSession, o: params.CompareOptions) -> dict[str, DataFrame]:
    """``full_alignments``: text of the aligner; ``short_alignments``: records."""
    return {"strands": joins.compared_strands(sequence_text.read_alignments(spark, o.full_alignments), records.read(spark, o.short_alignments, MAPPING, o.format))}


def validate_graph(spark: SparkSession, o: params.GraphOptions) -> dict[str, DataFrame]:
    if o.k < 2:
        raise ValueError("k must be at least 2")
    return {"errors": graph.validate(records.read(spark, o.contigs, CONTIG, o.format), o.k)}


def export_graph(spark: SparkSession, o: params.ExportOptions) -> dict[str, DataFrame]:
    return {"nodes": codec.encoded_nodes(records.read(spark, o.contigs, CONTIG, o.format), o.chunked)}


def simulate(spark: SparkSession, o: params.SimulationOptions) -> dict[str, DataFrame]:
    tasks = tools.descriptors(records.matching_files(spark, o.sequences), o.output, o.fold_coverage, o.read_length, o.error_free)
    if o.tool:
        reads = tools.simulated_fastq(tools.run_simulator(tasks, o.tool))
    else:
        reads = tools.simulate_reads(sequence_text.read_fasta(spark, o.sequences), o.fold_coverage, o.read_length)
    return {"manifest": tasks, "reads": reads}


@dataclass(frozen=True)
class Job:
    options: type
    build: Callable[[SparkSession, Any], dict[str, DataFrame]]


JOBS = {
    "join-contigs-and-mappings": Job(params.JoinOptions, join_contigs_and_mappings),
    "join-mappings-and-reads": Job(params.JoinOptions, join_mappings_and_reads),
    "count-alignments": Job(params.AlignmentOptions, count_alignments),
    "read-orientation": Job(params.AlignmentOptions, read_orientation),
    "compare-alignments": Job(params.CompareOptions, compare_alignments),
    "validate-graph": Job(params.GraphOptions, validate_graph),
    "export-graph": Job(params.ExportOptions, export_graph),
    "simulate-reads": Job(params.SimulationOptions, simulate),
}
#: Tables that get a fresh name for each run, and the one that must not exist yet.
STAMPED, CREATED = {"count-alignments", "read-orientation"}, {"export-graph"}


def run(name: str, spark: SparkSession, options: Any) -> list[str]:
    """Build a job and write its results; returns where they are."""
    job, out = JOBS[name], []
    results = job.build(spark, options)
    table = getattr(options, "output_table", "")
    folder = "" if table else records.timestamped_dir(options.output)
    for key, df in results.items():
        if table:
            out.append(records.write_table(df, table, name in STAMPED, "errorifexists" if name in CREATED else "overwrite"))
        elif key.endswith((".fasta", ".fastq")):
            records.write_text(df, f"{folder}/{key}")
            out.append(f"{folder}/{key}")
        else:
            records.write(df, f"{folder}/{key}", getattr(options, "format", "parquet"))
            out.append(f"{folder}/{key}")
    return out


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in JOBS:
        print("jobs: " + ", ".join(JOBS))
        return 2
    options = params.parse(JOBS[argv[0]].options, argv[1:])
    print("\n".join(run(argv[0], params.SessionOptions().session(), options)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
