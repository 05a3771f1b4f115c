"""FASTA and FASTQ text of a record; each ends with a newline unless the sink adds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fasta(name: Column, sequence: Column, newline: bool = True) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), sequence, F.lit("\n" if newline else ""))


def fastq(name: Column, read: Column, qvalue: Column, newline: bool = True) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), read, F.lit("\n+\n"), qvalue, F.lit("\n" if newline else ""))
