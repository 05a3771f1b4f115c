import io
import random

from pyspark.sql import functions as F

from strandlake.functions import codec, dna, keys, render
from strandlake.functions.strand import leftmost, rightmost, strand
from strandlake.schemas import CONTIG, MAPPING, READ
from strandlake.sources import fixtures


def test_strand_by_coordinate_order(spark):
    df = spark.createDataFrame([(0, 10), (10, 0), (5, 5)], "s int, e int")
    got = df.select(strand("s", "e"), leftmost("s", "e"), rightmost("s", "e")).collect()
    assert [tuple(r) for r in got] == [("F", 0, 10), ("R", 0, 10), ("F", 5, 5)]


def test_read_id_parts(spark):
    df = spark.createDataFrame([("lib1_7_2",), ("plain",), (None,)], "read_id string")
    got = df.select(keys.library(F.col("read_id")), keys.mate_id(F.col("read_id")), keys.mate_number(F.col("read_id"))).collect()
    assert tuple(got[0]) == ("lib1", "lib1_7", "2")
    assert tuple(got[1]) == ("plain", "plain", "")
    assert got[2][0] is None


def test_reads_without_fastq_or_id_are_left_out(spark):
    rows = [fixtures.fastq_read("a", "ACG"), fixtures.fastq_read("", "ACG"), fixtures.fastq_read(None, "A"), {"fastq": None, "fasta": {"id": "f", "read": "AC"}}]
    assert [r.read_id for r in keys.with_fastq_id(spark.createDataFrame(rows, READ)).collect()] == ["a"]
    assert keys.fastq_by_id(spark.createDataFrame([("x", "A", "I")], "id string, read string, qvalue string")).first().read_id == "x"


def test_node_and_contig_keys(spark):
    data = fixtures.assembly(spark)
    assert sorted(r.node_id for r in keys.node_ids(data["nodes"]).collect()) == ["contig00", "contig01"]
    nested = data["alignments"].select(F.struct("*").alias("bowtie_mapping"))
    assert {r.contig_id for r in keys.with_contig_id(nested).collect()} == {"contig00", "contig01"}
    assert keys.with_mate_id(data["alignments"]).columns[-1] == "mate_id"


def test_reverse_complement_and_mismatches(spark):
    df = spark.createDataFrame([("ACGTTA", "ACG", 0, 2), ("ACGTTA", "CGT", 2, 0), ("ACGTTA", "ACC", 0, 2), ("ACGT", "ACGTAA", 0, 3)], "c string, r string, s int, e int")
    got = [r[0] for r in df.select(dna.mismatches(F.col("c"), F.col("r"), F.col("s"), F.col("e"))).collect()]
    assert got == [0, 0, 1, 0]


def test_shortening(spark):
    reads = spark.createDataFrame([("a", "ACGTACGTAC", "0123456789"), ("b", "ACG", "012"), ("c", "ACGTACGT", "0")], "id string, read string, qvalue string")
    got = {(r.id, r.piece): (r.read, r.qvalue) for r in dna.shorten_reads(reads, 4).collect()}
    assert got == {("a", 0): ("ACGT", "0123"), ("a", 1): ("GTAC", "6789"), ("a", 2): ("TACG", "3456")}


def test_rendering(spark):
    row = spark.range(1).select(render.fasta(F.lit("x"), F.lit("ACG")), render.fastq(F.lit("x"), F.lit("AC"), F.lit("II"), newline=False)).first()
    assert tuple(row) == (">x\nACG\n", "@x\nAC\n+\nII")


def test_node_encoding_round_trip(spark):
    nodes = [
        {"node_id": "someNode", "sequence": "ACTCG" * 40, "coverage": 2.5, "edges": [{"dest_id": "n2", "src_strand": "F", "dest_strand": "R"}]},
        {"node_id": "bare", "sequence": None, "coverage": None, "edges": []},
        {"node_id": "holes", "sequence": "", "coverage": -0.5, "edges": [None, {"dest_id": None, "src_strand": "F", "dest_strand": None}]},
    ]
    got = {r.node_id: r.node_data for r in codec.encoded_nodes(spark.createDataFrame(nodes, CONTIG)).collect()}
    import base64

    for node in nodes:
        raw = base64.b64decode(got[node["node_id"]])
        assert codec.decode(io.BytesIO(raw), codec.avro_schema(CONTIG)) == node
    lines = got["someNode"].split("\r\n")
    assert lines[-1] == "" and max(map(len, lines)) == 76


def test_two_records_in_one_stream():
    out = bytearray()
    first, second = fixtures.mapping("c", "r", -3, 70000), fixtures.fastq_read("r", "ACG", "III")
    codec.encode(first, MAPPING, out)
    codec.encode(second, READ, out)
    src = io.BytesIO(bytes(out))
    assert codec.decode(src, codec.avro_schema(MAPPING)) == first
    assert codec.decode(src, codec.avro_schema(READ)) == second


def test_random_bases_are_seeded():
    assert dna.random_bases(random.Random(1), 20) == dna.random_bases(random.Random(1), 20)
