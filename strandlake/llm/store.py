"""Written intermediate tables and the lookups that survive hot keys.

Lineage is cut by writing Parquet below the shared folder named in ``spark.checkpoint.dir``: a lost executor then costs
a re-read, later scans prune columns, and the planner knows the true size of what it joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast by hint only if a bound below this many bytes has been proven for it.
BROADCAST_BYTES = 64 << 20
#: Copies of a group's summary row: a group's rows are spread over as many shuffle keys at most.
SALTS = 200
#: A group with more than one in so many of all rows is heavy: there are fewer heavy groups than this.
HEAVY = 10_000
#: Bits of one bitmap, as bitmap_construct_agg makes them.
BITMAP_BITS = 32768


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else the one set on the context.

    Only a local master may go without; it then gets a folder of its own, set on the context.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file:///tmp/checkpoints/strandlake-{uuid.uuid4().hex}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._stashed_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read any more."""
    for table in tables:
        where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stashed_at)
        where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let no more rows than this go to Python at a time, now and later in this session: texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows to Python while the body runs its jobs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_salt(*cols: str, salts: int = SALTS) -> Column:
    """Spreads rows of one group over ``salts`` keys."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts)).cast("int")


def group_lookup(rows: DataFrame, keys: list[str], salt: str, *aggs: Column) -> DataFrame:
    """Each row with its group's aggregates, no task holding a whole group.

    The aggregates combine on the map side; a group's summary is repeated once for each salt its rows have, and rows
    meet it on (keys, salt). The summaries are dealt by that key before the join, so that, where few rows are broadcast to
    them instead, no task puts out a whole group. Null keys form no group and must be replaced before.
    """
    per_group = rows.groupBy(*keys).agg(*aggs, F.collect_set(salt).alias("_salts"))
    spread = per_group.withColumn(salt, F.explode("_salts")).drop("_salts").repartition(*keys, salt)
    return rows.join(spread, [*keys, salt])


def ordinals(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with a gapless 0-based long ``name`` in the given total order; sorted by ranges, never in one task."""
    part, local = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stash(df.sort(order).withColumns({"_part": part, "_local": local}), "ordinals")
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, seen = [], 0
    for p, n in sizes:  # one entry for each shuffle partition
        starts.append((p, seen))
        seen += n
    if not starts:
        return numbered.withColumn(name, F.col("_local")).drop("_part", "_local")
    offsets = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return numbered.withColumn(name, (F.col("_local") + offsets[F.col("_part")]).cast("long")).drop("_part", "_local")


def own(df: DataFrame, *names: str) -> list[Column]:
    """The columns of these names, or all, whatever characters the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in (names or df.columns)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as make it differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def addressed(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` with two long columns, and their names: a hash of the file that a row lies in, and its place there.

    They name a row alike in every scan, on any executor. A table that is no plain scan of Parquet files is written first.
    Two of a million files share a hash with a chance of 3e-8.
    """
    file, at = fresh(df, "_file", "_at")
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.child()
    plain = plan.nodeName() == "LogicalRelation" and "_metadata" not in df.columns
    for again in (True, False):
        source = df if plain else stash(df, "addressed")
        try:
            return source.select(*own(df), F.xxhash64(source.metadataColumn("_metadata")["file_path"]).alias(file), source.metadataColumn("_metadata")["row_index"].alias(at)), file, at
        except AnalysisException:  # files of another format
            if not (plain and again):
                raise
            plain = False
    raise AssertionError


def marks(rows: DataFrame, file: str, at: str, *levels: Column) -> DataFrame:
    """Bitmaps that name rows: (_f, _chunk, _marks), an array with the bitmap of the rows that meet each condition."""
    chunk, bit = F.shiftright(at, 15), F.col(at).bitwiseAND(F.lit(BITMAP_BITS - 1))
    bits = [F.bitmap_construct_agg(F.when(level, bit)).alias(f"_m{k}") for k, level in enumerate(levels)]
    made = rows.groupBy(F.col(file).alias("_f"), chunk.alias("_chunk")).agg(*bits)
    return stash(made.select("_f", "_chunk", F.array(*[f"_m{k}" for k in range(len(levels))]).alias("_marks")), "marks")


def bit_is_set(bits: Column, bit: Column) -> Column:
    """Whether a bitmap has a bit; false of a null one."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) > 0, F.lit(False))


def marked(wide: DataFrame, file: str, at: str, bitmaps: DataFrame, rows: int, levels: int, name: str) -> DataFrame:
    """``wide`` with an int ``name``: how many levels mark the row. No row of ``wide`` shuffles at any size.

    The bitmaps take ``levels`` bits a row. As many as fit into BROADCAST_BYTES are broadcast at a time: beyond that the
    files are dealt into batches, each read once, with the bitmaps of its own files.
    """
    batches = max(1, -(-rows * levels // (8 * max(1, BROADCAST_BYTES))))
    f, chunk, bits = fresh(wide, "_f", "_chunk", "_marks")
    out = None
    for k in range(batches):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(batches)) == k  # noqa: B023, E731
        part = wide if batches == 1 else wide.filter(mine(F.col(file)))
        few = (bitmaps if batches == 1 else bitmaps.filter(mine(F.col("_f")))).select(F.col("_f").alias(f), F.col("_chunk").alias(chunk), F.col("_marks").alias(bits))
        met = part.join(F.broadcast(few), (F.col(file) == F.col(f)) & (F.shiftright(at, 15) == F.col(chunk)), "left")
        hits = [bit_is_set(F.get(bits, F.lit(j)), F.col(at).bitwiseAND(F.lit(BITMAP_BITS - 1))).cast("int") for j in range(levels)]
        met = met.withColumn(name, sum(hits[1:], hits[0])).select(*own(wide), name)
        out = met if out is None else out.unionAll(met)
    return out


def with_summary(rows: DataFrame, keys: list[str], summary: DataFrame, size: str, total: int, inner: bool = False) -> DataFrame:
    """``rows`` joined to one ``summary`` row a key, left (null keys meet none) or inner; ``size`` is about how many rows have the key.

    Heavy keys, fewer than HEAVY by definition, are broadcast; so rows of a hot key do not shuffle, and no key of the
    shuffled rest has more than total / HEAVY rows. ``rows`` and ``summary`` are read several times: written tables.
    """
    hot = F.col(size) * F.lit(HEAVY) > F.lit(total)
    few, rest = summary.filter(hot), summary.filter(~hot)
    new = [f for f in summary.schema if f.name not in keys]
    columns = [*rows.columns, *[f.name for f in new]]
    empty = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0
    some = rows.filter(~empty)
    heavy = some.join(F.broadcast(few), keys).select(columns)
    light = some.join(F.broadcast(few.select(keys)), keys, "left_anti").join(rest, keys, "inner" if inner else "left").select(columns)
    if inner:
        return heavy.unionAll(light)
    return rows.filter(empty).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in new]).unionAll(heavy).unionAll(light)
