import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from strandlake import params, schemas, streaming
from strandlake.plans import pipelines, registry
from strandlake.sources import fixtures, records

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def normal(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    columns = sorted(df.columns)
    expect = got.select(*[f'"{c}"' for c in columns]).fetchall()
    assert normal(map(tuple, df.select(columns).collect())) == normal(expect)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.fixture
def stored(spark, tmp_path):
    for name, df in fixtures.assembly(spark, 4).items():
        df.write.parquet(str(tmp_path / name))
    return tmp_path


def test_join_jobs(spark, stored):
    o = params.JoinOptions(contigs=f"{stored}/nodes", reads=f"{stored}/reads", mappings=f"{stored}/alignments", output=f"{stored}/out", min_contig_length=3)
    (joined,) = pipelines.run("join-contigs-and-mappings", spark, o)
    assert spark.read.parquet(joined).count() == 4
    out = pipelines.run("join-mappings-and-reads", spark, params.JoinOptions(**{**vars(o), "output": f"{stored}/out2"}))
    assert [p.rsplit("/", 1)[1] for p in out] == ["alignments", "contigs.fasta", "reads.fastq"]
    assert spark.read.text(out[2]).count() == 16


def test_jobs_over_avro(spark, tmp_path):
    for name, df in fixtures.assembly(spark, 4).items():
        records.write(df, str(tmp_path / name), "avro")
    o = params.JoinOptions(contigs=f"{tmp_path}/nodes", reads=f"{tmp_path}/reads", mappings=f"{tmp_path}/alignments", output=f"{tmp_path}/out", format="avro")
    (joined,) = pipelines.run("join-contigs-and-mappings", spark, o)
    assert records.read(spark, joined, schemas.CONTIG_READ_MAPPINGS, "avro").count() == 4
    (counts,) = pipelines.run("count-alignments", spark, params.AlignmentOptions(f"{tmp_path}/alignments", "avro_counts", "avro"))
    assert spark.table(counts).count() == 4


def test_table_jobs(spark, stored):
    (counts,) = pipelines.run("count-alignments", spark, params.AlignmentOptions(f"{stored}/alignments", "counts"))
    assert counts.startswith("counts_2") and spark.table(counts).count() == 4
    pipelines.run("read-orientation", spark, params.AlignmentOptions(f"{stored}/alignments", "orientation"))
    (nodes,) = pipelines.run("export-graph", spark, params.ExportOptions(f"{stored}/nodes", "nodes_table"))
    assert spark.table(nodes).columns == ["node_id", "node_data"]
    (stored / "full.txt").write_text("read00\t+\tcontig00\t0\tACTCG\tIIIII\t0\t\n")
    (strands,) = pipelines.run("compare-alignments", spark, params.CompareOptions(f"{stored}/full.txt", f"{stored}/alignments", "strands"))
    assert [tuple(r) for r in spark.table(strands).collect()] == [("read00", "F", "F")]


def test_graph_and_simulation_jobs(spark, stored):
    (errors,) = pipelines.run("validate-graph", spark, params.GraphOptions(f"{stored}/nodes", f"{stored}/errors", 3))
    assert spark.read.parquet(errors).count() == 0
    with pytest.raises(ValueError):
        pipelines.validate_graph(spark, params.GraphOptions(f"{stored}/nodes"))
    (stored / "g.fasta").write_text(">g\n" + "ACGT" * 50 + "\n")
    out = pipelines.run("simulate-reads", spark, params.SimulationOptions(f"{stored}/g.fasta", f"{stored}/sim"))
    assert spark.read.parquet(out[1]).count() == 20


def test_options():
    o = params.parse(params.SimulationOptions, ["--fold_coverage", "3", "--error_free", "false"])
    assert (o.fold_coverage, o.error_free, o.read_length) == (3, False, 100)
    assert params.parse(params.SessionOptions, ["--experiments", "a=1,b=2"]).experiments == ["a=1", "b=2"]
    with pytest.raises(ValueError):
        params.SessionOptions(master="elsewhere").session()
    with pytest.raises(SystemExit):
        params.parse(params.GraphOptions, ["--nonsense", "1"])
    assert pipelines.main([]) == 2


def test_running_counts(spark, stored):
    q = streaming.running_counts(streaming.arriving_mappings(spark, f"{stored}/alignments")).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").count() == 4
    arriving = streaming.arriving_mappings(spark, f"{stored}/alignments")
    full = records.read(spark, f"{stored}/alignments", fixtures.MAPPING)
    assert streaming.strands_of_arrivals(arriving, full).isStreaming
