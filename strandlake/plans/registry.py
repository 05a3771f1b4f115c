"""Registered queries of the sequence operators on the standard tables, and their SQL.

The tables hold no sequences, so each query maps columns onto the record types and applies the operator to the whole:
``lineitem`` as mappings, ``part`` as reads, ``orders`` as contigs, ``documents`` as sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from strandlake.functions import codec, dna, keys, render
from strandlake.functions.strand import strand
from strandlake.operators import adapters, counts, filters, graph, hist, joins, mates, tools
from strandlake.schemas import record
from strandlake.sources import fixtures, records, sequence_text

K = 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(name: str) -> Column:
    return F.col(name).cast("string")


def mappings_of(lineitem: DataFrame, *more: Column) -> DataFrame:
    return lineitem.select(
        as_text("l_orderkey").alias("contig_id"),
        as_text("l_partkey").alias("read_id"),
        F.col("l_quantity").cast("int").alias("contig_start"),
        (F.col("l_suppkey") % 50).cast("int").alias("contig_end"),
        F.round(F.col("l_discount") * 100).cast("int").alias("num_mismatches"),
        *more,
    )


def reads_of(part: DataFrame) -> DataFrame:
    return part.select(F.struct(as_text("p_partkey").alias("id"), F.col("p_name").alias("read"), F.lit("").alias("qvalue")).alias("fastq"), F.lit(None).cast("struct<id:string,read:string>").alias("fasta"))


def contigs_of(orders: DataFrame) -> DataFrame:
    return orders.select(as_text("o_orderkey").alias("node_id"), F.lit("").alias("sequence"), F.col("o_totalprice").alias("coverage"), F.array().cast("array<struct<dest_id:string,src_strand:string,dest_strand:string>>").alias("edges"))


def filter_contigs_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.contigs_by_length(table(spark, sf_dir, "documents"), 500, "text").select("doc_id", "n_chars")


def filter_mappings_by_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mappings_of(table(spark, sf_dir, "lineitem"), F.col("l_returnflag").alias("rf"), F.col("l_linenumber").alias("ln"))
    wanted = table(spark, sf_dir, "orders").filter("o_totalprice >= 200000").select(as_text("o_orderkey").alias("node_id"))
    return filters.mappings_by_contigs(own, wanted)


def join_mappings_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = joins.mapping_read_pairs(mappings_of(table(spark, sf_dir, "lineitem")), reads_of(table(spark, sf_dir, "part")))
    m = F.col("bowtie_mapping")
    return pairs.select(m["contig_id"].alias("contig_id"), m["read_id"].alias("read_id"), m["contig_start"].alias("contig_start"), F.col("read.fastq.read").alias("p_name"))


def join_alignments_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = joins.mappings_and_reads(mappings_of(table(spark, sf_dir, "lineitem")), reads_of(table(spark, sf_dir, "part")))
    contigs = contigs_of(table(spark, sf_dir, "orders"))
    m = F.col("bowtie_mapping")
    return joins.alignments_and_contigs(aligned, contigs).select(m["contig_id"].alias("contig_id"), m["read_id"].alias("read_id"), F.col("graph_node.coverage").alias("o_totalprice"), F.col("read.fastq.read").alias("p_name"))


def contig_read_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = joins.contigs_reads_mappings(contigs_of(table(spark, sf_dir, "orders")), mappings_of(table(spark, sf_dir, "lineitem")), reads_of(table(spark, sf_dir, "part")))
    ids = F.array_sort(F.transform("mappings", lambda p: p["bowtie_mapping"]["read_id"]))
    return nested.select(F.col("graph_node.node_id").cast("long").alias("node_id"), F.size("mappings").cast("long").alias("n_mappings"), F.array_join(ids, ",").alias("mapping_reads"))


def count_read_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.alignments_per_read(mappings_of(table(spark, sf_dir, "lineitem")))


def compare_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return joins.compared_strands(mappings_of(line.filter("l_returnflag = 'R'")), mappings_of(line.filter("l_returnflag = 'A'")))


def read_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("lib"), F.col("l_linestatus"), F.lit("_"), as_text("l_orderkey"), F.lit("_"), as_text("l_linenumber"), F.lit("_"), as_text("l_partkey"))
    own = line.select(
        F.col("l_orderkey").alias("mate"),
        F.col("l_returnflag").alias("contig_id"),
        name.alias("read_id"),
        (F.col("l_partkey") % 1000).cast("int").alias("contig_start"),
        (F.col("l_suppkey") * 10).cast("int").alias("contig_end"),
        F.round(F.col("l_discount") * 100).cast("int").alias("num_mismatches"),
    )
    return mates.orientations(mates.pairs(own, F.col("mate")))


def validate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of 24 bases from a hash, each with an edge on and most with an edge back, some broken."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"))
    bases = lambda k: F.translate(F.substring(F.md5(k.cast("string")), 1, 12), "0123456789abcdef", "ACGTACGTACGTACGT")
    i = F.col("id")
    text = lambda c: c.cast("string")
    onward = F.struct(text(F.when(i % 13 == 0, i + 2).otherwise(i + 1)).alias("dest_id"), F.lit("F").alias("src_strand"), F.lit("F").alias("dest_strand"))
    back = F.struct(text(i - 1).alias("dest_id"), F.lit("R").alias("src_strand"), F.lit("R").alias("dest_strand"))
    nodes = part.select(text(i).alias("node_id"), F.concat(bases(i), bases(i + 1)).alias("sequence"), F.lit(1.0).alias("coverage"), F.when(i % 7 != 0, F.array(onward, back)).otherwise(F.array(onward)).alias("edges"))
    errors = graph.validate(nodes, K, first_only=True)
    return errors.select(F.col("dest_id").cast("long").alias("node_id"), F.col("source_id").cast("long").alias("source_id"), "code", "src_strand")


def encode_nodes_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), codec.mime_base64(F.col("text").cast("binary"), chunked=False).alias("node_data"))


def encode_nodes_base64_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), codec.mime_base64(F.col("text").cast("binary")).alias("node_data"))


def encode_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").select(as_text("doc_id").alias("node_id"), F.col("text").alias("sequence"))
    return codec.encoded_nodes(nodes, chunked=False)


def render_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filters.contigs_by_length(table(spark, sf_dir, "documents"), 500, "text")
    return docs.select(render.fasta(as_text("doc_id"), F.col("text")).alias("rec"))


def render_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(render.fastq(as_text("p_partkey"), F.col("p_name"), F.col("p_type")).alias("rec"))


def shorten_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(dna.pieces(F.col("text"), 25)).alias("piece"))


def sam_to_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("chr|"), as_text("p_partkey"), F.lit("|7\t0\t"), F.col("p_name"), F.lit("\t"), F.col("p_type"))
    return sequence_text.sam_to_fastq(table(spark, sf_dir, "part").select(line.alias("value"))).select("id", "read", F.col("qvalue").alias("q"))


def parse_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+")
    line = F.concat_ws("\t", as_text("l_partkey"), sign, as_text("l_orderkey"), as_text("l_suppkey"), F.repeat(F.col("l_returnflag"), F.col("l_linenumber")), F.lit("I"), F.lit("0"), F.lit(""))
    found = sequence_text.alignments(table(spark, sf_dir, "lineitem").select(line.alias("value")))
    return found.select("contig_id", "read_id", "contig_start", "contig_end", strand("contig_start", "contig_end").alias("strand"), "num_mismatches")


def count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases that differ between each part's name and the name read two characters on."""
    part = table(spark, sf_dir, "part")
    rest = F.substring(F.col("p_name"), F.lit(3), F.length("p_name"))
    return part.select("p_partkey", dna.mismatches(F.col("p_name"), rest, F.lit(0), (F.length("p_name") - 1).cast("int")).cast("int").alias("n_mismatches"))


def bases(key: Column) -> Column:
    """32 bases from a key's hash."""
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def count_mismatches_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads on the reverse strand against their part's sequence: places 25 to 4, the read taken from the neighbour's sequence."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", dna.mismatches(bases(F.col("p_partkey")), bases(F.col("p_partkey") + 1), F.lit(25), F.lit(4)).cast("int").alias("n_mismatches"))


def key_by_mate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("lib"), F.col("l_linestatus"), F.lit("_"), as_text("l_orderkey"), F.lit("_"), as_text("l_linenumber"))
    own = keys.with_mate_id(table(spark, sf_dir, "lineitem").select(name.alias("read_id")))
    return own.select("read_id", "mate_id", keys.mate_number(F.col("read_id")).alias("mate"), keys.library(F.col("read_id")).alias("library"))


def key_fastq_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.fastq_by_id(table(spark, sf_dir, "part").select(as_text("p_partkey").alias("id"), F.col("p_name").alias("read"), F.col("p_type").alias("qvalue")))


def contig_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.node_ids(contigs_of(table(spark, sf_dir, "orders")))


def coverage_length_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.coverage_and_length(table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("coverage"), F.col("p_name").alias("sequence")))


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligner lines written as gzipped text and parsed when read again."""
    line = F.concat_ws("\t", as_text("l_partkey"), F.when(F.col("l_tax") > 0.04, "-").otherwise("+"), as_text("l_orderkey"), as_text("l_suppkey"), F.col("l_shipdate").cast("date").cast("string"), F.lit("I"), F.lit("0"), F.repeat(F.lit("1:A>C,"), F.col("l_linenumber") - 1)).alias("value")
    path = records.scratch(spark, "lines")
    records.write_text(table(spark, sf_dir, "lineitem").select(line), path, "gzip")
    return sequence_text.read_alignments(spark, path).select("contig_id", "read_id", "contig_start", "contig_end", "num_mismatches", "read", "read_clear_end")


def avro_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = records.scratch(spark, "avro")
    own = mappings_of(table(spark, sf_dir, "lineitem"))
    records.write(own, path, "avro")
    return records.read(spark, path, own.schema, "avro")


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = records.scratch(spark, "fasta")
    contigs = table(spark, sf_dir, "part").select(as_text("p_partkey").alias("node_id"), F.concat(bases(F.col("p_partkey")), bases(F.col("p_partkey") + 1)).alias("sequence"))
    records.write_text(sequence_text.contig_fasta(contigs), path)
    return sequence_text.read_fasta(spark, path)


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned reads as FASTQ, a copy for each alignment, read again."""
    path = records.scratch(spark, "fastq")
    pairs = joins.mapping_read_pairs(mappings_of(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part").select(F.struct(as_text("p_partkey").alias("id"), F.translate("p_name", " ", "_").alias("read"), F.lit("I").alias("qvalue")).alias("fastq")))
    records.write_text(sequence_text.alignment_fastq(pairs), path)
    return sequence_text.read_fastq(spark, path)


def simulate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = table(spark, sf_dir, "documents").select(as_text("doc_id").alias("id"), F.col("text").alias("read"))
    return tools.simulate_reads(contigs, fold=1, length=100)


def map_with_user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper that gives each mapping once for each of its mismatches over seven."""
    own = mappings_of(table(spark, sf_dir, "lineitem")).select("read_id", "num_mismatches")
    return adapters.map_records(own, lambda settings: lambda r: [{"read_id": r["read_id"], "k": k} for k in range(int(settings["over"]), r["num_mismatches"])], record(read_id=StringType(), k=IntegerType()), {"over": "7"})


def reduce_with_user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer over the mappings of each read."""
    own = mappings_of(table(spark, sf_dir, "lineitem")).select("read_id", "contig_start", "num_mismatches")
    out = record(read_id=StringType(), n=LongType(), far=IntegerType(), mismatches=LongType())
    return adapters.reduce_groups(own, "read_id", lambda _: lambda k, rows: [{"read_id": k, "n": len(rows), "far": max(r["contig_start"] for r in rows), "mismatches": sum(r["num_mismatches"] for r in rows)}], out)


def reduce_two_with_user_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer over the orders and the nation of each customer's key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = record(o_custkey=LongType(), n=LongType(), c_name=StringType())
    return adapters.reduce_two(customers, orders, "o_custkey", lambda _: lambda k, a, b: [{"o_custkey": k, "n": len(b), "c_name": r["c_name"]} for r in a], out)


def fixture_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = fixtures.assembly(spark, 3)
    nested = joins.contigs_reads_mappings(data["nodes"], data["alignments"], data["reads"])
    return nested.select("graph_node.node_id", "graph_node.sequence", F.element_at("mappings", 1)["read"]["fastq"]["id"].alias("read_id"))


def coverage_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = hist.histogram2d(table(spark, sf_dir, "part"), "p_size", "p_retailprice")
    return cells.select(F.col("x_bin").alias("len_bin"), F.col("y_bin").alias("cov_bin"), "n")


MAP = """(SELECT CAST(l_orderkey AS VARCHAR) contig_id, CAST(l_partkey AS VARCHAR) read_id, CAST(floor(l_quantity) AS INT) contig_start,
 CAST(l_suppkey % 50 AS INT) contig_end, CAST(round(l_discount*100) AS INT) num_mismatches, l_returnflag rf, l_linenumber ln FROM lineitem)"""

SQL = {
    "filter_contigs_by_length": "SELECT doc_id, n_chars FROM documents WHERE length(text) >= 500",
    "filter_mappings_by_contigs": f"SELECT m.* FROM {MAP} m WHERE m.contig_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice >= 200000)",
    "join_mappings_reads": f"SELECT m.contig_id, m.read_id, m.contig_start, p.p_name FROM {MAP} m JOIN part p ON m.read_id = CAST(p.p_partkey AS VARCHAR)",
    "join_alignments_contigs": f"""SELECT m.contig_id, m.read_id, o.o_totalprice, p.p_name FROM {MAP} m JOIN part p ON m.read_id = CAST(p.p_partkey AS VARCHAR)
        JOIN orders o ON m.contig_id = CAST(o.o_orderkey AS VARCHAR)""",
    "contig_read_mappings": f"""SELECT o.o_orderkey node_id, COUNT(m.read_id) n_mappings, COALESCE(string_agg(m.read_id, ',' ORDER BY m.read_id), '') mapping_reads
        FROM orders o LEFT JOIN (SELECT m.contig_id, m.read_id FROM {MAP} m JOIN part p ON m.read_id = CAST(p.p_partkey AS VARCHAR)) m
        ON m.contig_id = CAST(o.o_orderkey AS VARCHAR) GROUP BY o.o_orderkey""",
    "count_read_alignments": f"SELECT read_id, COUNT(*) AS num_alignments FROM {MAP} m GROUP BY read_id",
    "compare_strands": f"""SELECT f.read_id, CASE WHEN f.contig_start > f.contig_end THEN 'R' ELSE 'F' END full_strand,
        CASE WHEN s.contig_start > s.contig_end THEN 'R' ELSE 'F' END short_strand
        FROM {MAP} f JOIN {MAP} s ON f.read_id = s.read_id WHERE f.rf = 'R' AND s.rf = 'A'""",
    "read_orientation": """WITH m AS (SELECT l_orderkey mate_id, l_returnflag contig_id,
            concat('lib', l_linestatus, '_', CAST(l_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR), '_', CAST(l_partkey AS VARCHAR)) read_id,
            CAST(l_partkey % 1000 AS INT) contig_start, CAST(l_suppkey * 10 AS INT) contig_end, CAST(round(l_discount * 100) AS INT) num_mismatches FROM lineitem),
        g AS (SELECT *, COUNT(*) OVER (PARTITION BY mate_id) n, MIN(contig_id) OVER (PARTITION BY mate_id) c1, MAX(contig_id) OVER (PARTITION BY mate_id) c2,
            ROW_NUMBER() OVER (PARTITION BY mate_id ORDER BY LEAST(contig_start, contig_end), read_id, contig_start, contig_end, num_mismatches) pos FROM m),
        p AS (SELECT * FROM g WHERE n = 2 AND c1 = c2)
        SELECT concat(CASE WHEN l.contig_start > l.contig_end THEN 'R' ELSE 'F' END, CASE WHEN r.contig_start > r.contig_end THEN 'R' ELSE 'F' END) orientation,
          LEAST(r.contig_start, r.contig_end) distance, split_part(l.read_id, '_', 1) library,
          l.read_id left_read_id, l.contig_id left_contig_id, l.contig_start left_contig_start, l.contig_end left_contig_end,
          LEAST(l.contig_start, l.contig_end) left_contig_left, GREATEST(l.contig_start, l.contig_end) left_contig_right, l.num_mismatches left_num_mismatches,
          r.read_id right_read_id, r.contig_id right_contig_id, r.contig_start right_contig_start, r.contig_end right_contig_end,
          LEAST(r.contig_start, r.contig_end) right_contig_left, GREATEST(r.contig_start, r.contig_end) right_contig_right, r.num_mismatches right_num_mismatches
        FROM p l JOIN p r ON l.mate_id = r.mate_id AND l.pos = 1 AND r.pos = 2""",
    "validate_graph": """WITH n AS (SELECT p_partkey id, concat(translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT'),
            translate(substr(md5(CAST(p_partkey + 1 AS VARCHAR)), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT')) s FROM part WHERE p_partkey % 11 <> 0),
        r AS (SELECT id, s, reverse(translate(s, 'ACGT', 'TGCA')) rc FROM n),
        e AS (SELECT id src, CASE WHEN id % 13 = 0 THEN id + 2 ELSE id + 1 END dst, 'F' strand FROM n UNION ALL SELECT id, id - 1, 'R' FROM n WHERE id % 7 <> 0),
        m AS (SELECT e.src, e.dst, e.strand, right(CASE WHEN e.strand = 'R' THEN r.rc ELSE r.s END, 12) tail FROM e JOIN r ON e.src = r.id)
        SELECT m.dst node_id, m.src source_id, m.strand src_strand,
          CASE WHEN d.id IS NULL THEN 'MISSING_NODE' WHEN left(CASE WHEN m.strand = 'R' THEN d.rc ELSE d.s END, 12) <> m.tail THEN 'NO_OVERLAP' ELSE 'MISSING_EDGE' END code
        FROM m LEFT JOIN r d ON m.dst = d.id LEFT JOIN e b ON b.src = m.dst AND b.dst = m.src AND b.strand <> m.strand
        WHERE d.id IS NULL OR left(CASE WHEN m.strand = 'R' THEN d.rc ELSE d.s END, 12) <> m.tail OR b.src IS NULL""",
    "encode_nodes_base64": "SELECT doc_id node_id, base64(encode(text)) node_data FROM documents",
    "encode_nodes_base64_lines": "SELECT doc_id node_id, regexp_replace(base64(encode(text)), '(.{1,76})', concat('\\1', chr(13), chr(10)), 'g') node_data FROM documents",
    "render_fasta": "SELECT concat('>', CAST(doc_id AS VARCHAR), chr(10), text, chr(10)) rec FROM documents WHERE length(text) >= 500",
    "render_fastq": "SELECT concat('@', CAST(p_partkey AS VARCHAR), chr(10), p_name, chr(10), '+', chr(10), p_type, chr(10)) rec FROM part",
    "shorten_sequences": """SELECT doc_id, unnest([substr(text, 1, 25), substr(text, length(text) - 24, 25),
        substr(text, CAST(floor(length(text) / 2.0 - 12.5) AS INT) + 1, 25)]) piece FROM documents WHERE length(text) >= 25""",
    "sam_to_fastq": """SELECT regexp_replace(t[1], '[|][^|]*$', '') id, t[-2] AS read, t[-1] AS q
        FROM (SELECT string_split(concat('chr|', CAST(p_partkey AS VARCHAR), '|7', chr(9), '0', chr(9), p_name, chr(9), p_type), chr(9)) t FROM part)""",
    "parse_alignments": """SELECT CAST(l_orderkey AS VARCHAR) contig_id, CAST(l_partkey AS VARCHAR) read_id,
        CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey + l_linenumber - 1 ELSE l_suppkey END AS INT) contig_start,
        CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_suppkey + l_linenumber - 1 END AS INT) contig_end,
        CASE WHEN l_linenumber % 2 = 0 AND l_linenumber > 1 THEN 'R' ELSE 'F' END strand, CAST(0 AS INT) num_mismatches FROM lineitem""",
    "count_mismatches": """SELECT p_partkey, CAST(list_sum(list_transform(range(1, length(p_name) - 1),
        lambda k: CASE WHEN substr(p_name, k, 1) <> substr(p_name, k + 2, 1) THEN 1 ELSE 0 END)) AS INT) n_mismatches FROM part""",
    "count_mismatches_reversed": """WITH b AS (SELECT p_partkey, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') s, translate(md5(CAST(p_partkey + 1 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') r FROM part),
        c AS (SELECT p_partkey, reverse(translate(substr(s, 5, 22), 'ACGT', 'TGCA')) s, r FROM b)
        SELECT p_partkey, CAST(list_sum(list_transform(range(1, 23), lambda k: CASE WHEN substr(s, k, 1) <> substr(r, k, 1) THEN 1 ELSE 0 END)) AS INT) n_mismatches FROM c""",
    "key_by_mate": """SELECT concat('lib', l_linestatus, '_', l_orderkey, '_', l_linenumber) read_id, concat('lib', l_linestatus, '_', l_orderkey) mate_id,
        CAST(l_linenumber AS VARCHAR) mate, concat('lib', l_linestatus) AS library FROM lineitem""",
    "key_fastq_by_id": "SELECT CAST(p_partkey AS VARCHAR) read_id, CAST(p_partkey AS VARCHAR) id, p_name AS read, p_type qvalue FROM part",
    "contig_node_ids": "SELECT CAST(o_orderkey AS VARCHAR) node_id FROM orders",
    "coverage_length_scatter": "SELECT p_retailprice coverage, CAST(length(p_name) AS INT) AS length FROM part",
    "text_round_trip": """SELECT CAST(l_orderkey AS VARCHAR) contig_id, CAST(l_partkey AS VARCHAR) read_id, CAST(CASE WHEN l_tax > 0.04 THEN l_suppkey + 9 ELSE l_suppkey END AS INT) contig_start,
        CAST(CASE WHEN l_tax > 0.04 THEN l_suppkey ELSE l_suppkey + 9 END AS INT) contig_end, CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS INT) num_mismatches,
        CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS read, CAST(10 AS INT) read_clear_end FROM lineitem""",
    "avro_round_trip": f"SELECT contig_id, read_id, contig_start, contig_end, num_mismatches FROM {MAP} m",
    "fasta_round_trip": """SELECT CAST(p_partkey AS VARCHAR) id, concat(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'),
        translate(md5(CAST(p_partkey + 1 AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')) AS read FROM part""",
    "fastq_round_trip": f"SELECT m.read_id id, replace(p.p_name, ' ', '_') AS read, 'I' qvalue FROM {MAP} m JOIN part p ON m.read_id = CAST(p.p_partkey AS VARCHAR)",
    "simulate_reads": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) id, text, unnest(range(1, 1 + CAST(ceil(length(text) / 100.0) AS INT))) k FROM documents WHERE length(text) >= 100)
        SELECT concat(id, '-', k) id, substr(text, 1 + CAST(CAST('0x' || substr(md5(concat('7-', id, '-', k)), 1, 15) AS BIGINT) % (length(text) - 99) AS INT), 100) AS read, repeat('I', 100) qvalue FROM d""",
    "map_with_user_code": f"SELECT read_id, CAST(unnest(range(7, num_mismatches)) AS INT) k FROM {MAP} m",
    "reduce_with_user_code": f"SELECT read_id, count(*) n, max(contig_start) far, CAST(sum(num_mismatches) AS BIGINT) mismatches FROM {MAP} m GROUP BY read_id",
    "reduce_two_with_user_code": "SELECT c_custkey o_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) n, c_name FROM customer c",
    "fixture_join": "SELECT concat('contig0', k) node_id, 'ACTCG' AS sequence, concat('read0', k) read_id FROM range(3) t(k)",
    "encode_graph_nodes": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) node_id, text, 2 * octet_length(encode(CAST(doc_id AS VARCHAR))) a, 2 * octet_length(encode(text)) b FROM documents),
        v AS (SELECT *, CASE WHEN b < 128 THEN printf('%02x', b) WHEN b < 16384 THEN printf('%02x%02x', b % 128 + 128, b // 128)
            WHEN b < 2097152 THEN printf('%02x%02x%02x', b % 128 + 128, b // 128 % 128 + 128, b // 16384)
            ELSE printf('%02x%02x%02x%02x', b % 128 + 128, b // 128 % 128 + 128, b // 16384 % 128 + 128, b // 2097152) END h FROM d)
        SELECT node_id, base64(unhex('02' || printf('%02x', a)) || encode(node_id) || unhex('02' || h) || encode(text)) node_data FROM v""",
    "coverage_length_histogram": """WITH b AS (SELECT min(p_size) * 1.0::DOUBLE lo, max(p_size) * 1.0::DOUBLE hi, min(p_retailprice) plo, max(p_retailprice) phi FROM part)
        SELECT CAST(LEAST(9, floor((p_size - lo) * 10 / (hi - lo))) AS INT) len_bin, CAST(LEAST(9, floor((p_retailprice - plo) * 10 / (phi - plo))) AS INT) cov_bin,
        COUNT(*) n FROM part CROSS JOIN b GROUP BY 1, 2""",
}

QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    filter_contigs_by_length, filter_mappings_by_contigs, join_mappings_reads, join_alignments_contigs, contig_read_mappings,
    count_read_alignments, compare_strands, read_orientation, validate_graph, encode_nodes_base64, encode_nodes_base64_lines,
    encode_graph_nodes, render_fasta, render_fastq, shorten_sequences, sam_to_fastq, parse_alignments, count_mismatches,
    coverage_length_histogram, count_mismatches_reversed, key_by_mate, key_fastq_by_id, contig_node_ids, coverage_length_scatter,
    text_round_trip, avro_round_trip, fasta_round_trip, fastq_round_trip, simulate_reads, map_with_user_code, reduce_with_user_code,
    reduce_two_with_user_code, fixture_join,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
