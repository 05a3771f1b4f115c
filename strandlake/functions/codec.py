"""Avro binary encoding of rows and its base64 form.

spark-avro need not be installed: rows are encoded in Arrow batches from their Spark schema, every field
or array item as a union with null. Base64 comes in lines of 76 characters with CRLF, as MIME has it, or unbroken.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

_NAMES = {StringType: "string", IntegerType: "int", LongType: "long", DoubleType: "double", FloatType: "float", BooleanType: "boolean", BinaryType: "bytes"}


def avro_schema(kind: DataType, name: str = "record") -> Any:
    """The Avro schema, as JSON data, of a Spark type; every struct field and array item may be null."""
    if isinstance(kind, StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_schema(f.dataType, f"{name}_{f.name}")], "default": None} for f in kind]}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": ["null", avro_schema(kind.elementType, f"{name}_item")]}
    return _NAMES[type(kind)]


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(value: Any, kind: DataType, out: bytearray) -> None:
    """Append the encoding of a value that is not null."""
    if isinstance(kind, StructType):
        for f in kind:
            _encode_union(value[f.name], f.dataType, out)
    elif isinstance(kind, ArrayType):
        if value:
            out += _long(len(value))
            for x in value:
                _encode_union(x, kind.elementType, out)
        out += _long(0)
    elif isinstance(kind, (StringType, BinaryType)):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        out += _long(len(raw)) + raw
    elif isinstance(kind, (IntegerType, LongType)):
        out += _long(int(value))
    elif isinstance(kind, BooleanType):
        out.append(int(value))
    else:
        out += struct.pack("<f" if isinstance(kind, FloatType) else "<d", value)


def _encode_union(value: Any, kind: DataType, out: bytearray) -> None:
    out += _long(0 if value is None else 1)
    if value is not None:
        encode(value, kind, out)


def read_long(src: io.BytesIO) -> int:
    shift = n = 0
    while True:
        b = src.read(1)
        if not b:
            raise EOFError("the data ends inside a number")
        n |= (b[0] & 0x7F) << shift
        shift += 7
        if not b[0] & 0x80:
            return (n >> 1) ^ -(n & 1)


def decode(src: io.BytesIO, schema: Any, named: dict[str, Any] | None = None) -> Any:
    """A value by its Avro schema (records, arrays, maps, unions, enums, fixed and primitives)."""
    named = {} if named is None else named
    if isinstance(schema, list):
        return decode(src, schema[read_long(src)], named)
    if isinstance(schema, str) and schema in named:
        schema = named[schema]
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, dict) and "name" in schema:
        named[schema["name"]] = schema
    if kind == "record":
        return {f["name"]: decode(src, f["type"], named) for f in schema["fields"]}
    if kind in ("array", "map"):
        pairs: list[Any] = []
        while n := read_long(src):
            if n < 0:  # a block with its size in bytes
                n = -n
                read_long(src)
            for _ in range(n):
                key = src.read(read_long(src)).decode() if kind == "map" else None
                item = decode(src, schema["items" if kind == "array" else "values"], named)
                pairs.append(item if key is None else (key, item))
        return pairs if kind == "array" else dict(pairs)
    if kind in ("string", "bytes"):
        raw = src.read(read_long(src))
        return raw.decode() if kind == "string" else raw
    if kind in ("int", "long"):
        return read_long(src)
    if kind == "enum":
        return schema["symbols"][read_long(src)]
    if kind == "fixed":
        return src.read(schema["size"])
    if kind == "boolean":
        return src.read(1) == b"\1"
    if kind in ("float", "double"):
        size = 4 if kind == "float" else 8
        return struct.unpack("<f" if size == 4 else "<d", src.read(size))[0]
    if kind == "null":
        return None
    return decode(src, kind, named)  # {"type": <schema>}


def with_avro(df: DataFrame, key: str, name: str = "avro") -> DataFrame:
    """(key, name): each row's key and its whole row in Avro binary, without a header."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = bytearray()
                encode(row, schema, raw)
                out.append(bytes(raw))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array(out, pa.binary())], names=[key, name])

    return df.mapInArrow(run, StructType([schema[key], *StructType().add(name, BinaryType())]))


def mime_base64(raw: Column, chunked: bool = True) -> Column:
    """Base64 in lines of 76 characters, each ended by CRLF, or in one line."""
    flat = F.regexp_replace(F.base64(raw), "\r\n", "")
    return F.regexp_replace(flat, "(.{1,76})", "$1\r\n") if chunked else flat


def encoded_nodes(contigs: DataFrame, chunked: bool = True) -> DataFrame:
    """(node_id, node_data): each node's Avro binary as base64."""
    return with_avro(contigs, "node_id").select("node_id", mime_base64(F.col("avro"), chunked).alias("node_data"))
