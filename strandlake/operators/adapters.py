"""Adapters for user code that maps records or reduces groups, and row counters.

Built-in expressions come first; these are for code that has none. Functions are built once for each task, so costly
set-up belongs in the factory, which also gets the settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = Mapping[str, Any]
Factory = Callable[[Mapping[str, str]], Callable[..., Iterable[Row]]]
#: Output rows of one batch.
BATCH = 4096


def _batches(rows: Iterable[Row], schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _table(rows: Iterable[Row], schema: StructType) -> pa.Table:
    return pa.Table.from_batches(list(_batches(rows, schema)), to_arrow_schema(schema))


def map_records(df: DataFrame, factory: Factory, schema: StructType, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Zero or more output rows for each input row, by ``factory(settings)(row)``. Values pass through Arrow, so longs beside nulls stay longs."""
    own = dict(settings or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = factory(own)
        yield from _batches((out for batch in batches for row in batch.to_pylist() for out in each(row)), schema)

    return df.mapInArrow(run, schema)


def reduce_groups(df: DataFrame, key: str, factory: Factory, schema: StructType, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Output rows for each group, by ``factory(settings)(key, rows)``; a group must fit a task."""
    own = dict(settings or {})

    def run(k: tuple, rows: pa.Table) -> pa.Table:
        return _table(factory(own)(k[0].as_py(), rows.to_pylist()), schema)

    return df.groupBy(key).applyInArrow(run, schema)


def reduce_two(left: DataFrame, right: DataFrame, key: str, factory: Factory, schema: StructType, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Output rows for each key of two tables, by ``factory(settings)(key, left rows, right rows)``."""
    own = dict(settings or {})

    def run(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _table(factory(own)(k[0].as_py(), a.to_pylist(), b.to_pylist()), schema)

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


def counted(df: DataFrame, name: str, **conditions: Any) -> tuple[DataFrame, Any]:
    """``df`` with counters that fill as it runs: all rows and those meeting each condition."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]]
    return df.observe(seen, *counts), seen
