"""Coverage against length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_and_length(contigs: DataFrame) -> DataFrame:
    return contigs.select("coverage", F.length("sequence").alias("length"))


def _bin(x: str, low: str, high: str, bins: int) -> Column:
    """Equal bins, the last closed; where all values are equal, unit width around them."""
    width = F.when(F.col(high) > F.col(low), F.col(high) - F.col(low)).otherwise(F.lit(1.0))
    start = F.when(F.col(high) > F.col(low), F.col(low)).otherwise(F.col(low) - 0.5)
    return F.least(F.lit(bins - 1), F.floor((F.col(x) - start) * bins / width)).cast("int")


def histogram2d(points: DataFrame, x: str, y: str, bins: int = 10, logged: bool = False) -> DataFrame:
    """(x_bin, y_bin, n) of the non-empty cells; the bounds are one row, broadcast. ``logged`` adds log10(n + 1)."""
    own = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    bounds = own.agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"))
    cells = own.join(F.broadcast(bounds)).select(_bin("_x", "_x0", "_x1", bins).alias("x_bin"), _bin("_y", "_y0", "_y1", bins).alias("y_bin"))
    out = cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    return out.withColumn("log_n", F.log10(F.col("n") + 1)) if logged else out
