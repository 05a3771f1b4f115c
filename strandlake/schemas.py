"""Record types. Fields are nullable; further columns of an input pass through the operators that keep whole rows."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def record(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

MAPPING = record(contig_id=S, read_id=S, contig_start=I, contig_end=I, num_mismatches=I, read=S, read_clear_start=I, read_clear_end=I)
FASTQ = record(id=S, read=S, qvalue=S)
FASTA = record(id=S, read=S)
READ = record(fastq=FASTQ, fasta=FASTA)
EDGE = record(dest_id=S, src_strand=S, dest_strand=S)
CONTIG = record(node_id=S, sequence=S, coverage=D, edges=ArrayType(EDGE))
CONTIG_READ_ALIGNMENT = record(graph_node=CONTIG, read=READ, bowtie_mapping=MAPPING)
MAPPING_READ_PAIR = record(read=READ, bowtie_mapping=MAPPING)
CONTIG_READ_MAPPINGS = record(graph_node=CONTIG, mappings=ArrayType(MAPPING_READ_PAIR))
ALIGNER_INPUT = record(reference=ArrayType(READ), query=ArrayType(READ))
SIMULATED_READS = record(sequenceFile=S, readFile=S, foldCoverage=I, readLength=I, errorFree=B)
GRAPH_ERROR = record(code=S, source_id=S, dest_id=S, src_strand=S, dest_strand=S, message=S)
ALIGNMENT_COUNT = record(read_id=S, num_alignments=L)
ENCODED_NODE = record(node_id=S, node_data=S)
STRANDS = record(read_id=S, full_strand=S, short_strand=S)

SIDE = ["read_id", "contig_id", "contig_start", "contig_end", "contig_left", "contig_right", "num_mismatches"]
_side_types = {"read_id": S, "contig_id": S}
ORIENTATION = record(orientation=S, distance=I, library=S, **{f"{side}_{c}": _side_types.get(c, I) for side in ("left", "right") for c in SIDE})
