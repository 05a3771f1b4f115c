import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from strandlake.operators import adapters, counts, filters, graph, hist, joins, mates
from strandlake.schemas import CONTIG, MAPPING, ORIENTATION, READ
from strandlake.sources import fixtures
from strandlake.sources.fixtures import fastq_read, mapping


def contig(name, sequence="ACTCG", edges=()):
    return {"node_id": name, "sequence": sequence, "coverage": 1.0, "edges": [dict(zip(("dest_id", "src_strand", "dest_strand"), e)) for e in edges]}


def tables(spark, contigs, mappings, reads):
    return spark.createDataFrame(contigs, CONTIG), spark.createDataFrame(mappings, MAPPING), spark.createDataFrame(reads, READ)


def test_join_mappings_and_reads(spark):
    _, maps, reads = tables(spark, [], [mapping("c", "readA"), mapping("c", "readB")], [fastq_read("readA", "ACGTA"), fastq_read("readB", "CCCCC")])
    got = {r.read.fastq.id: r for r in joins.mappings_and_reads(maps, reads).collect()}
    assert set(got) == {"readA", "readB"} and all(r.bowtie_mapping.read_id == k and r.graph_node is None for k, r in got.items())


def test_duplicates_multiply_and_null_keys_match_nothing(spark):
    _, maps, reads = tables(spark, [], [mapping("c", "a"), mapping("c", "a"), mapping("c", None)], [fastq_read("a", "A"), fastq_read("a", "C"), fastq_read(None, "G"), {"fastq": None, "fasta": None}])
    assert joins.mapping_read_pairs(maps, reads).count() == 4


def test_join_alignments_and_contigs(spark):
    data = fixtures.assembly(spark)
    got = joins.alignments_and_contigs(joins.mappings_and_reads(data["alignments"], data["reads"]), data["nodes"]).collect()
    assert {(r.graph_node.node_id, r.read.fastq.id) for r in got} == {("contig00", "read00"), ("contig01", "read01")}


def test_length_filter_end_to_end(spark):
    contigs = [contig(f"c{i}", "A" * (8 if i < 5 else 15)) for i in range(10)]
    maps = [mapping(f"c{i}", f"read{x}{i}") for i in range(10) for x in "ab"]
    reads = [fastq_read(f"read{x}{i}", "ACGTA") for i in range(10) for x in "ab"]
    c, m, r = tables(spark, contigs, maps, reads)
    long = filters.contigs_by_length(c, 10)
    got = joins.alignments_and_contigs(joins.mappings_and_reads(filters.mappings_by_contigs(m, long.select("node_id")), r), long).collect()
    assert len(got) == 10 and {x.graph_node.node_id for x in got} == {f"c{i}" for i in range(5, 10)}


def test_semi_join_keeps_each_mapping_once(spark):
    _, m, _ = tables(spark, [], [mapping("c", "a"), mapping("d", "b")], [])
    ids = spark.createDataFrame([("c",), ("c",)], "node_id string")
    assert filters.mappings_by_contigs(m, ids).count() == 1


def test_nested_join(spark):
    contigs = [contig("c1"), contig("c1"), contig("c2"), contig("empty")]
    maps = [mapping("c1", "a"), mapping("c1", "b"), mapping("c2", "a"), mapping("unknown", "a"), mapping("c2", "noread")]
    reads = [fastq_read("a", "A"), fastq_read("b", "C"), {"fastq": None, "fasta": {"id": "a", "read": "A"}}]
    got = joins.contigs_reads_mappings(*(tables(spark, contigs, maps, reads))).collect()
    found = sorted((r.graph_node.node_id, sorted(p.bowtie_mapping.read_id for p in r.mappings)) for r in got)
    assert found == [("c1", ["a", "b"]), ("c1", ["a", "b"]), ("c2", ["a"]), ("empty", [])]


def test_compared_strands(spark):
    _, full, _ = tables(spark, [], [mapping("c", "Read-0", 0, 10), mapping("c", "Read-1", 10, 0)], [])
    _, short, _ = tables(spark, [], [mapping("c", "Read-0", 10, 0), mapping("c", "Read-1", 3, 3), mapping("c", "other", 0, 1)], [])
    got = {tuple(r) for r in joins.compared_strands(full, short).collect()}
    assert got == {("Read-0", "F", "R"), ("Read-1", "R", "F")}


def test_counts(spark):
    _, m, _ = tables(spark, [], [mapping("c", "a"), mapping("d", "a"), mapping("c", "b")], [])
    assert {tuple(r) for r in counts.alignments_per_read(m).collect()} == {("a", 2), ("b", 1)}


def test_mate_orientation(spark):
    rows = [
        mapping("c", "lib_1_1", 40, 20), mapping("c", "lib_1_2", 5, 9),  # left one is the second read
        mapping("c", "lib_2_1"), mapping("d", "lib_2_2"),  # contigs differ
        mapping("c", "lib_3_1"),  # alone
        mapping("c", "lib_4_1"), mapping("c", "lib_4_2"), mapping("c", "lib_4_2", 7, 8),  # three
        mapping("c", "lib_5_1", 1, 3), mapping("c", "lib_5_1", 9, 6),  # one read twice
        mapping("c", "lib_6_2", 4, 8), mapping("c", "lib_6_1", 4, 8),  # equal places: by read id
    ]
    m = spark.createDataFrame(rows, MAPPING)
    out = mates.orientations(mates.pairs(m), gap=True)
    assert [f.name for f in out.schema][:17] == ORIENTATION.names
    got = {r.left_read_id: r for r in out.collect()}
    assert set(got) == {"lib_1_2", "lib_5_1", "lib_6_1"}
    one = got["lib_1_2"]
    assert (one.orientation, one.distance, one.library, one.gap, one.right_contig_right) == ("FR", 20, "lib", 11, 40)
    assert got["lib_6_1"].right_read_id == "lib_6_2"
    assert {r.left.read_id for r in mates.pairs(m, strict=True).collect()} == {"lib_1_2", "lib_6_1"}


def test_graph_checks(spark):
    # a -> b overlap by two and know each other; c's edge overlaps nothing; d points nowhere
    nodes = [
        contig("a", "AACG", [("b", "F", "F")]), contig("b", "CGTT", [("a", "R", "R")]),
        contig("c", "AAAA", [("b", "F", "F")]), contig("d", "ACGT", [("gone", "F", "F")]),
        contig("e", "TTTT", [("c", "R", "F")]),  # AA overlaps, but no edge back
    ]
    df = spark.createDataFrame(nodes, CONTIG)
    got = {(r.code, r.source_id, r.dest_id) for r in graph.validate(df, 3).collect()}
    assert got == {("NO_OVERLAP", "c", "b"), ("MISSING_EDGE", "c", "b"), ("MISSING_NODE", "d", "gone"), ("MISSING_EDGE", "e", "c")}
    assert graph.validate(df, 3, first_only=True).filter("source_id = 'c'").count() == 1
    assert graph.validate(df.limit(0), 3).count() == 0


def test_graph_checks_move_only_outer_bases(spark, tmp_path):
    rows = [contig("a", "A" * 5000 + "CG", [("b", "F", "F")]), contig("b", "CG" + "T" * 5000, [("a", "R", "R")])]
    spark.createDataFrame(rows, CONTIG).write.parquet(str(tmp_path / "nodes"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.validate(spark.read.parquet(str(tmp_path / "nodes")), 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        below = plan.split("Exchange", 1)[1]
        carried = [x for x in plan.splitlines() if "Project" in x and "sequence#" in x]
        assert out.count() == 0 and "sequence" in below and carried and all("substring(sequence#" in x for x in carried)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_histogram(spark):
    points = spark.createDataFrame([(float(i), float(i % 10)) for i in range(101)] + [(None, 1.0)], "x double, y double")
    cells = hist.histogram2d(points, "x", "y", logged=True).collect()
    assert sum(r.n for r in cells) == 101 and max(r.x_bin for r in cells) == 9
    np = pytest.importorskip("numpy")
    expect, _, _ = np.histogram2d([float(i) for i in range(101)], [float(i % 10) for i in range(101)])
    assert {(r.x_bin, r.y_bin): r.n for r in cells} == {(i, j): int(expect[i, j]) for i in range(10) for j in range(10) if expect[i, j]}
    flat = spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double")
    assert [r.n for r in hist.histogram2d(flat, "x", "y").collect()] == [3]
    assert hist.coverage_and_length(spark.createDataFrame([contig("a")], CONTIG)).first().length == 5


def test_adapters(spark):
    schema = StructType().add("k", StringType()).add("n", LongType())
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n long")

    def doubled(settings):
        return lambda row: [{"k": row["k"], "n": row["n"] * int(settings["by"])}] * 2

    def summed(settings):
        return lambda key, rows: [{"k": key, "n": sum(r["n"] for r in rows)}]

    def joined(settings):
        return lambda key, left, right: [{"k": key, "n": len(left) * 10 + len(right)}]

    assert sorted(tuple(r) for r in adapters.map_records(df, doubled, schema, {"by": "3"}).collect()) == [("a", 3), ("a", 3), ("a", 6), ("a", 6), ("b", 9), ("b", 9)]
    assert sorted(tuple(r) for r in adapters.reduce_groups(df, "k", summed, schema).collect()) == [("a", 3), ("b", 3)]
    assert sorted(tuple(r) for r in adapters.reduce_two(df, df.filter("k = 'b'"), "k", joined, schema).collect()) == [("a", 20), ("b", 11)]
    big = spark.createDataFrame([("a", 2**53 + 1), ("a", None)], "k string, n long")
    same = lambda _: lambda row: [row]
    assert sorted((tuple(r) for r in adapters.map_records(big, same, schema).collect()), key=str) == [("a", 2**53 + 1), ("a", None)]
    kept = adapters.reduce_groups(big, "k", lambda _: lambda key, rows: [r for r in rows if r["n"] is not None], schema)
    assert [tuple(r) for r in kept.collect()] == [("a", 2**53 + 1)]
    watched, seen = adapters.counted(df, "seen", big=F.col("n") > 1)
    watched.collect()
    assert seen.get == {"rows": 3, "big": 2}


def test_mapping_filter_is_a_semi_join_and_keys_are_pruned(spark, tmp_path):
    data = fixtures.assembly(spark)
    path = str(tmp_path / "m")
    data["alignments"].write.parquet(path)
    stored = spark.read.parquet(path)
    plan = filters.mappings_by_contigs(stored, data["nodes"].select("node_id"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    plan = counts.alignments_per_read(stored)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<read_id:string>" in plan and "partial_count" in plan
