"""External tools in tasks: a read simulator and a short-read aligner, with a built-in simulator where none is installed."""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.dna import shorten_reads
from strandlake.functions.keys import with_fastq_id
from strandlake.sources.sequence_text import alignments, sam_to_fastq

DESCRIPTOR = "sequenceFile string, readFile string, foldCoverage int, readLength int, errorFree boolean"


def descriptors(files: DataFrame, output: str, fold: int = 10, length: int = 100, error_free: bool = True) -> DataFrame:
    """(path, name) of sequence files as task descriptors."""
    target = F.concat(F.lit(output.rstrip("/") + "/"), F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".fastq"))
    return files.select(F.col("path").alias("sequenceFile"), target.alias("readFile"), F.lit(fold).alias("foldCoverage"), F.lit(length).alias("readLength"), F.lit(error_free).alias("errorFree"))


def simulator_command(tool: str, source: str, prefix: str, fold: int, length: int, error_free: bool) -> list[str]:
    return [tool, "-i", source, "-f", str(fold), "-l", str(length), *(["--errfree"] if error_free else []), "-o", prefix]


def run_simulator(tasks: DataFrame, tool: str) -> DataFrame:
    """Lines (readFile, errorFree, line) that the tool writes for each descriptor: SAM if error-free, else FASTQ with the four lines of a
    record joined by tabs; a failing tool fails the task."""

    def lines_of(d: dict[str, Any], folder: str) -> list[str]:
        prefix = os.path.join(folder, "reads")
        source = d["sequenceFile"].removeprefix("file://").removeprefix("file:")
        subprocess.run(simulator_command(tool, source, prefix, d["foldCoverage"], d["readLength"], d["errorFree"]), check=True, capture_output=True)
        with open(prefix + ("_errFree.sam" if d["errorFree"] else ".fq")) as f:
            lines = f.read().split("\n")
        if d["errorFree"]:
            return [x for x in lines if x]
        return ["\t".join(lines[k : k + 4]) for k in range(0, len(lines) - 3, 4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.to_pylist():
                with tempfile.TemporaryDirectory() as folder:
                    lines = lines_of(d, folder)
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([d["readFile"]] * n, pa.string()), pa.array([d["errorFree"]] * n, pa.bool_()), pa.array(lines, pa.string())], names=["readFile", "errorFree", "line"])

    return tasks.mapInArrow(run, "readFile string, errorFree boolean, line string")


def simulate_reads(sequences: DataFrame, fold: int = 10, length: int = 100, seed: int = 7) -> DataFrame:
    """Error-free reads (id, read, qvalue) of FASTA records (id, read): ceil(fold * bases / length) of each, at places drawn
    from a hash of the record and the read's number. All in DataFrame functions."""
    n = F.ceil(F.lit(fold) * F.length("read") / F.lit(length)).cast("int")
    long_enough = sequences.filter(F.length("read") >= length)
    each = long_enough.select("id", "read", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "id", "k")), 1, 15), 16, 10).cast("long")
    start = F.pmod(drawn, F.length("read") - length + 1).cast("int")
    return each.select(F.concat_ws("-", "id", "k").alias("id"), F.substring(F.col("read"), start + 1, F.lit(length)).alias("read"), F.repeat(F.lit("I"), F.lit(length)).alias("qvalue"))


def simulated_fastq(lines: DataFrame) -> DataFrame:
    """(id, read, qvalue) of the lines of ``run_simulator``."""
    t = F.split("line", "\t")
    other = lines.filter("NOT errorFree").select(F.regexp_extract(t[0], r"^@(\S*)", 1).alias("id"), t[1].alias("read"), t[3].alias("qvalue"))
    return sam_to_fastq(lines.filter("errorFree").select("line")).unionAll(other)


def run_aligner(inputs: DataFrame, build: str = "bowtie-build", align: str = "bowtie") -> DataFrame:
    """Lines of the aligner's output for each row (reference, query): index the references, align the queries."""

    def fasta_text(reads: Any) -> str:
        return "".join(f">{r['fasta']['id']}\n{r['fasta']['read']}\n" for r in reads)

    def fastq_text(reads: Any) -> str:
        return "".join(f"@{r['fastq']['id']}\n{r['fastq']['read']}\n+\n{r['fastq']['qvalue']}\n" for r in reads)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                with tempfile.TemporaryDirectory() as folder:
                    ref, query, index, out = (os.path.join(folder, x) for x in ("ref.fasta", "query.fastq", "index", "out.txt"))
                    with open(ref, "w") as f:
                        f.write(fasta_text(row["reference"]))
                    with open(query, "w") as f:
                        f.write(fastq_text(row["query"]))
                    subprocess.run([build, ref, index], check=True, capture_output=True)
                    subprocess.run([align, "-q", "-v", "1", "-M", "2", index, query, out], check=True, capture_output=True)
                    with open(out) as f:
                        lines = f.read().split("\n")
                yield pd.DataFrame({"value": [x for x in lines if x]})

    return inputs.mapInPandas(run, "value string")


def build_index(contigs: DataFrame, build: str = "bowtie-build") -> str:
    """Index all contigs once, on the driver's disk (rows stream there, one at a time), and give the index to every executor. Its name for ``aligned``."""
    spark, name = contigs.sparkSession, f"index-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp()
    with open(os.path.join(folder, "contigs.fasta"), "w") as f:
        for r in contigs.select("node_id", "sequence").dropna().toLocalIterator():
            f.write(f">{r.node_id}\n{r.sequence}\n")
    subprocess.run([build, f.name, os.path.join(folder, name)], check=True, capture_output=True)
    for part in os.listdir(folder):
        if part.startswith(name):
            spark.sparkContext.addFile(os.path.join(folder, part))
    return name


def aligned(reads: DataFrame, index: str, align: str = "bowtie") -> DataFrame:
    """Lines of the aligner's output for FASTQ records (id, read, qvalue), one run of it for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            query, out, n = os.path.join(folder, "query.fastq"), os.path.join(folder, "out.txt"), 0
            with open(query, "w") as f:
                for batch in batches:
                    for r in batch.to_pylist():
                        f.write(f"@{r['id']}\n{r['read']}\n+\n{r['qvalue']}\n")
                        n += 1
            if n:
                subprocess.run([align, "-q", "-v", "1", "-M", "2", os.path.join(SparkFiles.getRootDirectory(), index), query, out], check=True, capture_output=True)
                with open(out) as f:
                    while lines := f.readlines(1 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\n") for x in lines if x != "\n"], pa.string())], names=["value"])

    return reads.select("id", "read", "qvalue").mapInArrow(run, "value string")


def align_reads(reads: DataFrame, contigs: DataFrame, length: int = 25, build: str = "bowtie-build", align: str = "bowtie") -> DataFrame:
    """Mappings of shortened reads against all contigs, whose index must fit an executor's disk, as the aligner needs it whole."""
    short = shorten_reads(with_fastq_id(reads).select("fastq.*"), length)
    return alignments(aligned(short.withColumn("id", F.concat_ws("_", "id", "piece")), build_index(contigs, build), align))
