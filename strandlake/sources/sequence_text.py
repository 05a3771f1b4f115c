"""Text formats: aligner output, SAM, FASTA and FASTQ. Compressed files are read as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.render import fasta, fastq


def alignments(lines: DataFrame) -> DataFrame:
    """Mappings from lines of the short-read aligner's default output (one string column).

    Tab-separated: read, strand, contig, 0-based offset, sequence, qualities, count, mismatches. The end is inclusive; on
    the minus strand start and end swap. A line with a bad offset gives a null one; the read's name ends at white space.
    """
    t = F.split(F.col(lines.columns[0]), "\t")
    at = lambda k: F.get(t, F.lit(k))
    offset = at(3).try_cast("int")
    last = (offset + F.length(at(4)) - 1).cast("int")
    minus = at(1) == "-"
    size = F.length(at(4)).cast("int")
    mismatched = F.when(F.coalesce(at(7), F.lit("")) == "", 0).otherwise(F.size(F.split(at(7), ",")))
    return lines.filter(F.size(t) >= 5).select(
        at(2).alias("contig_id"),
        F.regexp_extract(at(0), r"^\S*", 0).alias("read_id"),
        F.when(minus, last).otherwise(offset).alias("contig_start"),
        F.when(minus, offset).otherwise(last).alias("contig_end"),
        mismatched.cast("int").alias("num_mismatches"),
        at(4).alias("read"),
        F.lit(0).alias("read_clear_start"),
        size.alias("read_clear_end"),
    )


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return alignments(spark.read.text(path))


def sam_to_fastq(lines: DataFrame) -> DataFrame:
    """(id, read, qvalue) from error-free SAM lines.

    Leading header lines have an ``@``; a record's id is its first field up to the last ``|``, the read its second-last
    and the quality its last field, empty fields at the end not counting. A record whose id has no ``|`` is an error.
    """
    value = F.col(lines.columns[0])
    t = F.split(F.regexp_replace(value, "\t+$", ""), "\t")
    name = F.get(t, F.lit(0))
    own = F.when(name.contains("|"), F.regexp_replace(name, r"\|[^|]*$", "")).otherwise(F.raise_error(F.concat(F.lit("no | in the read id: "), name)))
    return lines.filter(~value.startswith("@") & (value != "")).select(own.alias("id"), F.try_element_at(t, F.lit(-2)).alias("read"), F.try_element_at(t, F.lit(-1)).alias("qvalue"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, read): records split at their header lines, so large files split too."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter("trim(v) <> ''")
    head = F.substring_index("v", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("v"), F.length(head) + 1, F.length("v")), r"\s", "")
    return records.select(F.regexp_extract(head, r"^\S*", 0).alias("id"), body.alias("read"))


def _fours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of four consecutive lines; what a batch leaves over goes with the next."""
    rest = None
    for batch in batches:
        lines = batch.column(0) if rest is None else pa.concat_arrays([rest, batch.column(0)])
        n = len(lines) // 4 * 4
        rest = lines.slice(n)
        yield pa.RecordBatch.from_arrays([lines.take(pa.array(np.arange(k, n, 4))) for k in (0, 1, 3)], names=["head", "read", "qvalue"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, read, qvalue) from four-line records; lines over at a file's end are none, nor are those of a file that begins with an empty line.

    Quality lines may begin like headers, so lines are counted. Large files split: the lines before each split, one
    broadcast row a split, give its lines their numbers in the file. Records within a split are read where they are; only
    the few lines of records that lie across splits shuffle.
    """
    value = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    scan = spark.read.text(path, lineSep="\n")
    scan = scan.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    # planned once: a scan planned anew may split otherwise when executors have come or gone
    lines = DataFrame(spark._jsparkSession.internalCreateDataFrame(scan._jdf.queryExecution().toRdd(), scan._jdf.schema(), False), spark)
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min_by(F.col("value") == "", "at").alias("empty"))
    earlier = Window.partitionBy("file").orderBy("start")
    splits = splits.withColumns({"low": F.sum("n").over(earlier) - F.col("n"), "empty": F.first("empty").over(earlier)}).filter("NOT empty")
    own = lines.join(F.broadcast(splits.select("file", "start", "n", "first", "low")), ["file", "start"])
    line = F.col("at") - F.col("first") + F.col("low")
    record = F.shiftright(line, 2)
    within = (record * 4 >= F.col("low")) & (record * 4 + 4 <= F.col("low") + F.col("n"))
    whole = own.filter(within).select("value").mapInArrow(_fours, "head string, read string, qvalue string")
    cut = own.filter(~within).groupBy("file", record.alias("record")).agg(F.sort_array(F.collect_list(F.struct(line.alias("line"), "value")))["value"].alias("l")).filter("size(l) = 4")
    cut = cut.select(F.col("l")[0].alias("head"), F.col("l")[1].alias("read"), F.col("l")[3].alias("qvalue"))
    return whole.unionAll(cut).select(F.regexp_extract("head", r"^@(\S*)", 1).alias("id"), "read", "qvalue")


def contig_fasta(contigs: DataFrame) -> DataFrame:
    """One element for each contig; the text sink ends its last line."""
    return contigs.filter("node_id IS NOT NULL AND sequence IS NOT NULL").select(fasta(F.col("node_id"), F.col("sequence"), newline=False).alias("value"))


def alignment_fastq(alignments_: DataFrame) -> DataFrame:
    """One element for each alignment, so a read comes as often as it is aligned; reads without FASTQ are left out."""
    q = lambda name: F.col(f"read.fastq.{name}")
    return alignments_.filter(F.col("read.fastq").isNotNull()).select(fastq(q("id"), q("read"), q("qvalue"), newline=False).alias("value"))
