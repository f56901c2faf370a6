"""Parametric corrections of residual planes: biases and least-squares fits of tiles and of blocks within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels(planes: DataFrame, key: list[str], w: int, block: int, **columns: Column) -> DataFrame:
    """A row for each pixel of equally long arrays, with its block (bx, by)."""
    zipped = planes.select(*key, F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in columns.items()])).alias("i", "p"))
    x, y = F.col("i") % w, F.floor(F.col("i") / w)
    return zipped.select(*key, x.alias("x"), y.cast("int").alias("y"), F.floor(x / block).cast("int").alias("bx"), F.floor(y / block).cast("int").alias("by"), *[F.col(f"p.{n}").alias(n) for n in columns])


def bias(px: DataFrame, by: list[str], residual: str) -> DataFrame:
    """The mean residual of each group, and what squared error it leaves."""
    r = F.col(residual)
    return px.groupBy(*by).agg(F.round(F.avg(r), 6).alias("bias"), F.round(F.sum(r * r) - F.sum(r) * F.sum(r) / F.count(r), 4).alias("rest"))


def affine(px: DataFrame, by: list[str], residual: str, predicted: str) -> DataFrame:
    """residual = slope predicted + intercept by least squares; a group without spread has slope 0 and its mean as intercept."""
    n, sx, sy = F.count(F.lit(1)), F.sum(predicted), F.sum(residual)
    spread, joint = n * F.sum(F.col(predicted) * F.col(predicted)) - sx * sx, n * F.sum(F.col(predicted) * F.col(residual)) - sx * sy
    slope = F.when(spread == 0, 0.0).otherwise(joint / spread)
    return px.groupBy(*by).agg(F.round(slope, 6).alias("slope"), F.round((sy - slope * sx) / n, 6).alias("intercept"))
