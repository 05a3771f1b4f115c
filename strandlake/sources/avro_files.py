"""Avro object container files without spark-avro.

Reading is distributed by file through Spark's own file source, so any store that Spark reads will do; a file must fit a
task. Writing goes through Spark's text sink, one file a partition, and so has its save modes, its commit protocol and any
store that Spark writes: a container's header and each of its blocks end with the file's mark, whose last byte is a
newline, so each is a "line" of bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from strandlake.functions.codec import _long, avro_schema, decode, encode, read_long

MAGIC = b"Obj\x01"
BLOCK_ROWS = 4000


def container_rows(raw: bytes) -> Iterator[dict[str, Any]]:
    """The records of a container file, null or deflate coded."""
    src = io.BytesIO(raw)
    if src.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = decode(src, {"type": "map", "values": "bytes"})
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null")
    if codec not in (b"null", b"deflate"):
        raise ValueError(f"unknown codec {codec!r}")
    sync = src.read(16)
    while src.tell() < len(raw):
        count, size = read_long(src), read_long(src)
        block = src.read(size)
        body = io.BytesIO(zlib.decompress(block, -15) if codec == b"deflate" else block)
        for _ in range(count):
            yield decode(body, schema)
        if src.read(16) != sync:
            raise ValueError("a block ends without the file's mark")


def container(rows: Iterator[Any], schema: StructType, name: str = "record") -> Iterator[bytes]:
    """The bytes of a container file, deflate coded."""
    text = json.dumps(avro_schema(schema, name)).encode()
    sync = hashlib.md5(text).digest()[:15] + b"\n"
    head = bytearray(MAGIC) + _long(2)
    for key, value in (("avro.schema", text), ("avro.codec", b"deflate")):
        head += _long(len(key)) + key.encode() + _long(len(value)) + value
    yield bytes(head + _long(0) + sync)
    body, count = bytearray(), 0
    for row in rows:
        encode(row, schema, body)
        count += 1
        if count == BLOCK_ROWS:
            yield _block(body, count, sync)
            body, count = bytearray(), 0
    if count:
        yield _block(body, count, sync)


def _block(body: bytearray, count: int, sync: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(bytes(body)) + packer.flush()
    return _long(count) + _long(len(packed)) + packed + sync


def _fitted(value: Any, kind: Any) -> Any:
    """Only the fields that the reader's schema names; missing ones are null."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return {f.name: _fitted(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, ArrayType):
        return [_fitted(x, kind.elementType) for x in value]
    return value


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for raw in batch.column(0):
                rows: list[Any] = []
                for row in container_rows(raw.as_py()):
                    rows.append(_fitted(row, schema))
                    if len(rows) == BLOCK_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content").mapInArrow(run, schema)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in container((row for batch in batches for row in batch.to_pylist()), schema):
            yield pa.RecordBatch.from_arrays([pa.array([part.removesuffix(b"\n")], pa.binary())], names=["value"])

    df.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.mode(mode).option("lineSep", "\n").text(path)
