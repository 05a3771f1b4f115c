"""Record tables: typed scans by path pattern, and sinks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.sources import avro_files


def has_spark_avro(spark: SparkSession) -> bool:
    try:
        spark.read.format("avro").schema("x int").load([])
        return True
    except AnalysisException:
        return False


def read(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Rows of the files that a pattern names, with exactly this schema. Avro works with or without spark-avro."""
    if fmt == "avro" and not has_spark_avro(spark):
        return avro_files.read(spark, path, schema)
    return spark.read.format(fmt).schema(schema).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "avro" and not has_spark_avro(df.sparkSession):
        avro_files.write(df, path, mode)
    else:
        df.write.format(fmt).mode(mode).save(path)


def write_text(lines: DataFrame, path: str, compression: str = "none") -> None:
    """One text element a line, one file a partition; an element may itself span lines."""
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.text(path, compression=compression)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``); only a local master may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:///tmp/checkpoints/strandlake-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/strandlake/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def timestamped_dir(base: str, now: datetime | None = None) -> str:
    """A fresh directory below ``base``, by the 24-hour clock."""
    return f"{base.rstrip('/')}/{(now or datetime.now()).strftime('%Y%m%d-%H%M%S')}"


def table_name(base: str, now: datetime | None = None) -> str:
    return f"{base}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_table(df: DataFrame, table: str, timestamp: bool = False, mode: str = "overwrite") -> str:
    """Save as a table and return its name: truncating, under a name of its own, or only if it does not exist yet."""
    name = table_name(table) if timestamp else table
    df.write.mode(mode).saveAsTable(name)
    return name


def matching_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name): one row for each file of a pattern; the name keeps the base name without ``.gz``."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.gz$", ""))
