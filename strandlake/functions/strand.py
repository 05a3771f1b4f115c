"""Strand and extent of a mapping. Coordinates in falling order mean the reverse strand; equal ones the forward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strand(start: Column | str, end: Column | str) -> Column:
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.when(start > end, "R").otherwise("F")


def leftmost(start: str, end: str) -> Column:
    return F.least(start, end)


def rightmost(start: str, end: str) -> Column:
    return F.greatest(start, end)
