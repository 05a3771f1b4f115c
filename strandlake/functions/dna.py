"""Sequences: reverse complement, mismatches, shortening and random bases."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.strand import strand


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def mismatches(reference: Column, read: Column, start: Column, end: Column) -> Column:
    """Differing bases of a read and the stretch of the reference that it maps to, over their common length.

    ``start`` and ``end`` are 0-based and inclusive; in falling order the stretch is reverse-complemented. No indels.
    """
    low, high = F.least(start, end), F.greatest(start, end)
    stretch = F.substring(reference, (low + 1).cast("int"), (high - low + 1).cast("int"))
    own = F.when(strand(start, end) == "R", reverse_complement(stretch)).otherwise(stretch)
    size = F.least(F.length(own), F.length(read))
    bases = lambda s: F.split(F.substring(s, F.lit(1), size), "")
    return F.aggregate(F.zip_with(bases(own), bases(read), lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, x: a + x)


def pieces(seq: Column, length: int) -> Column:
    """The first, last and middle ``length`` characters; none of a shorter sequence."""
    n = F.length(seq)
    part = lambda start: F.substring(seq, start.cast("int"), F.lit(length))
    middle = F.floor(n / 2.0 - length / 2.0) + 1
    return F.when(n >= length, F.array(part(F.lit(1)), part(n - length + 1), part(middle))).otherwise(F.array().cast("array<string>"))


def shorten_reads(reads: DataFrame, length: int = 25) -> DataFrame:
    """FASTQ records (id, read, qvalue) cut into head, tail and middle, the quality alike.

    Records shorter than ``length``, or whose quality is not as long as the read, give nothing.
    """
    whole = reads.filter((F.length("read") >= length) & (F.length("read") == F.length("qvalue")))
    parts = F.arrays_zip(pieces(F.col("read"), length).alias("read"), pieces(F.col("qvalue"), length).alias("qvalue"))
    return whole.select("id", F.posexplode(parts).alias("piece", "p")).select("id", "piece", "p.read", "p.qvalue")


def random_bases(rng: random.Random, length: int) -> str:
    return "".join(rng.choices("ACGT", k=length))
