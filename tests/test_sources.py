import gzip
import stat
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.operators import joins, tools
from strandlake.schemas import CONTIG, CONTIG_READ_MAPPINGS, MAPPING
from strandlake.sources import avro_files, fixtures, records, sequence_text


@pytest.mark.parametrize("fmt", ["parquet", "avro"])
def test_records_round_trip(spark, tmp_path, fmt):
    data = fixtures.assembly(spark, 5)
    nested = joins.contigs_reads_mappings(data["nodes"], data["alignments"], data["reads"])
    path = str(tmp_path / "out")
    records.write(nested, path, fmt)
    got = records.read(spark, f"{path}/*", CONTIG_READ_MAPPINGS, fmt)
    assert sorted(map(str, got.collect())) == sorted(map(str, nested.collect()))


def test_avro_sink_has_save_modes(spark, tmp_path):
    path, forty, two = str(tmp_path / "out"), spark.range(40).repartition(5), spark.range(100, 102).repartition(2)
    records.write(forty, path, "avro")
    with pytest.raises(AnalysisException):
        records.write(two, path, "avro")
    read = lambda: sorted(r.id for r in records.read(spark, f"{path}/*", forty.schema, "avro").collect())
    assert read() == list(range(40))
    records.write(two, path, "avro", "append")
    assert read() == [*range(40), 100, 101]
    records.write(two, path, "avro", "overwrite")
    assert read() == [100, 101]
    records.write(two.limit(0), path, "avro", "overwrite")
    assert read() == []


def test_avro_keeps_odd_values(spark, tmp_path):
    schema = "s string, n long, d double, b binary, a array<string>, x struct<y:int>"
    rows = [("é\n\r\0", 2**53 + 1, float("inf"), b"\n\xff\x00", ["a", None, ""], (None,)), (None, None, None, None, None, None), ("", -(2**63), -0.0, b"", [], (7,))]
    df = spark.createDataFrame(rows, schema)
    records.write(df, str(tmp_path / "out"), "avro")
    got = records.read(spark, str(tmp_path / "out"), df.schema, "avro").collect()
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))


def test_avro_reader_fits_the_schema(spark, tmp_path):
    (tmp_path / "x.avro").write_bytes(b"".join(avro_files.container(iter([fixtures.mapping("c", "r", 1, 2)]), MAPPING)))
    wider = StructType([*MAPPING.fields[:2], CONTIG.fields[0]])
    assert tuple(avro_files.read(spark, str(tmp_path), wider).first()) == ("c", "r", None)
    with pytest.raises(ValueError, match="container"):
        list(avro_files.container_rows(b"something else"))


def test_aligner_lines(spark):
    lines = ["r1 extra\t+\tc1\t5\tACGT\tIIII\t0\t", "r2\t-\tc1\t5\tACGT\tIIII\t0\t1:A>C,3:G>T", "bad line", "r3\t+\tc1\tx\tAC\tII\t0\t"]
    got = sequence_text.alignments(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.read_id, r.contig_start, r.contig_end, r.num_mismatches) for r in got] == [("r1", 5, 8, 0), ("r2", 8, 5, 2), ("r3", None, None, 0)]


def test_sam_to_fastq(spark):
    lines = ["@HD\tVN:1", "chr|12|7\t0\tx\tACGT\tIIII", "a|b\t0\tAC\tII\t\t", ""]
    got = sequence_text.sam_to_fastq(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("chr|12", "ACGT", "IIII"), ("a", "AC", "II")]
    with pytest.raises(Exception, match="no . in the read id"):
        sequence_text.sam_to_fastq(spark.createDataFrame([("name\tAC\tII",)], "value string")).collect()


def test_fasta_and_fastq_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">c1 first\nACG\nTTA\n>c2\nGG\n")
    assert sorted(map(tuple, sequence_text.read_fasta(spark, str(tmp_path / "a.fasta")).collect())) == [("c1", "ACGTTA"), ("c2", "GG")]
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1\nACG\n+\n@II\n@r2 x\nT\n+\nI\n")
    got = sequence_text.read_fastq(spark, str(tmp_path / "r.fastq.gz")).collect()
    assert sorted(map(tuple, got)) == [("r1", "ACG", "@II"), ("r2", "T", "I")]


def test_fastq_file_in_many_splits(spark, tmp_path):
    want = [(f"r{k}", "ACGT" * (k % 7), "@I+@" * (k % 7)) for k in range(200)]
    text = "".join(f"@{i} x\n{r}\n+\n{q}\n" for i, r, q in want)
    (tmp_path / "a.fastq").write_text(text + "@over\nAC\n+\n")
    (tmp_path / "b.fastq").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "c.fastq").write_text("@none\n\n+\n\n")
    (tmp_path / "d.fastq").write_text("")
    (tmp_path / "e.fastq").write_text("\n@x\nA\n+\nI\n")
    confs = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = sequence_text.read_fastq(spark, str(tmp_path / "*.fastq")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["id"], r["read"], r["qvalue"]) for r in got) == sorted(want + want + [("none", "", "")])
    assert len({r["task"] for r in got}) > 10  # no task reads a file


def test_text_sink_and_renderers(spark, tmp_path):
    data = fixtures.assembly(spark)
    records.write_text(sequence_text.contig_fasta(data["nodes"]), str(tmp_path / "contigs"))
    assert sorted(map(tuple, sequence_text.read_fasta(spark, str(tmp_path / "contigs/part*")).collect())) == [("contig00", "ACTCG"), ("contig01", "ACTCG")]
    aligned = joins.mappings_and_reads(data["alignments"].unionAll(data["alignments"]), data["reads"])
    assert sequence_text.alignment_fastq(aligned).count() == 4  # one for each alignment


def test_table_sinks(spark):
    df = spark.range(3)
    assert records.write_table(df, "sink_a") == "sink_a" and records.write_table(df, "sink_a") == "sink_a"
    assert spark.table("sink_a").count() == 3
    with pytest.raises(AnalysisException):
        records.write_table(df, "sink_a", mode="errorifexists")
    assert records.table_name("t", datetime(2020, 1, 2, 15, 4, 5)) == "t_20200102_150405"
    assert records.timestamped_dir("/x/", datetime(2020, 1, 2, 15, 4, 5)) == "/x/20200102-150405"


def test_simulation(spark, tmp_path):
    (tmp_path / "g.fasta.gz").write_bytes(gzip.compress(b">g\n" + b"ACGTTGCAAC" * 30 + b"\n"))
    files = records.matching_files(spark, str(tmp_path / "*.gz"))
    d = tools.descriptors(files, "/out").first()
    assert (d.readFile, d.foldCoverage, d.readLength, d.errorFree) == ("/out/g.fastq", 10, 100, True)
    reads = tools.simulate_reads(sequence_text.read_fasta(spark, str(tmp_path / "*.gz"))).collect()
    assert len(reads) == 30 and all(len(r.read) == 100 and r.read in "ACGTTGCAAC" * 30 for r in reads)


def test_external_tools(spark, tmp_path):
    simulator = tmp_path / "simulator"
    simulator.write_text('#!/bin/sh\nfor last; do :; done\nprintf "@HD\\nchr|1|2\\t0\\tAC\\tII\\n" > "${last}_errFree.sam"\n')
    build, align = tmp_path / "build", tmp_path / "align"
    build.write_text("#!/bin/sh\ncp $1 $2\n")
    align.write_text('#!/bin/sh\nprintf "query0\\t+\\tref0\\t3\\tACGT\\tIIII\\t0\\t\\n" > "$8"\n')
    with_errors = tmp_path / "with_errors"
    with_errors.write_text('#!/bin/sh\nfor last; do :; done\nprintf "@r1 x\\nACG\\n+\\n@II\\n@r2\\nT\\n+\\nI\\n" > "${last}.fq"\n')
    for p in (simulator, with_errors, build, align):
        p.chmod(p.stat().st_mode | stat.S_IXUSR)
    tasks = spark.createDataFrame([("/in.fa", "/out.fq", 10, 100, True)], tools.DESCRIPTOR)
    assert tuple(tools.simulated_fastq(tools.run_simulator(tasks, str(simulator))).first()) == ("chr|1", "AC", "II")
    tasks = spark.createDataFrame([("/in.fa", "/out.fq", 10, 100, False)], tools.DESCRIPTOR)
    assert sorted(map(tuple, tools.simulated_fastq(tools.run_simulator(tasks, str(with_errors))).collect())) == [("r1", "ACG", "@II"), ("r2", "T", "I")]
    lines = tools.run_aligner(fixtures.aligner_input(spark), str(build), str(align))
    got = sequence_text.alignments(lines).first()
    assert (got.contig_id, got.contig_start, got.contig_end) == ("ref0", 3, 6)
    reads = spark.createDataFrame([fixtures.fastq_read("q", "ACGTACGTAC", "IIIIIIIIII")], "fastq struct<id:string,read:string,qvalue:string>, fasta struct<id:string,read:string>")
    assert tools.align_reads(reads, fixtures.assembly(spark)["nodes"], 4, str(build), str(align)).count() >= 1
    assert tools.align_reads(reads.limit(0), fixtures.assembly(spark)["nodes"], 4, str(build), str(align)).count() == 0


def test_aligner_input_queries_are_substrings(spark):
    row = fixtures.aligner_input(spark).first()
    assert len(row.reference) == len(row.query) == 10
    assert all(q.fastq.read in r.fasta.read for q, r in zip(row.query, row.reference, strict=True))
