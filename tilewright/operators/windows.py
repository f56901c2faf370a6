"""Order-dependent computations over curves and containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.aggregates import value_counts


def pareto_frontier(points: DataFrame, by: list[str], size: str, gain: str, floor: float = -999.0) -> DataFrame:
    """Points whose gain beats all smaller ones'. Of one size only the best can be on the frontier, so sizes are aggregated before the window."""
    best = points.groupBy(*by, size).agg(F.max(gain).alias(gain))
    before = F.max(gain).over(Window.partitionBy(*by).orderBy(size).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", F.coalesce(before, F.lit(floor))).where(F.col(gain) > F.col("before")).drop("before")


def offsets(blobs: DataFrame, by: list[str], order: list[str], length: str, base: int) -> DataFrame:
    """Where each blob starts in its container: base plus the lengths before it."""
    before = F.sum(length).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return blobs.withColumn("offset", (F.coalesce(before, F.lit(0)) + base).cast("bigint"))


def marginal_cost(points: DataFrame, by: list[str], order: str, cost: str) -> DataFrame:
    """The cost over the previous quality's, and the sum of those steps."""
    seq = Window.partitionBy(*by).orderBy(order)
    step = points.withColumn("step", F.coalesce(F.col(cost) - F.lag(cost).over(seq), F.lit(0)))
    return step.withColumn("cumulative", F.sum("step").over(seq.rowsBetween(Window.unboundedPreceding, 0)))


def normalised(value: str, by: list[str], flat: float = 0.0) -> Column:
    """(value - least) / range of the group; `flat` where the range is 0."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(high == low, flat).otherwise((F.col(value) - low) / (high - low))


def balance_scores(points: DataFrame, by: list[str], gain: str, size: str, ratio: str) -> DataFrame:
    """points with `balance`, 0.6 gain and 0.4 smallness, and `even`, half gain and half compression ratio, each normalised over the group; a range of 0 scores 0."""
    better = normalised(gain, by)
    return points.withColumns({"balance": 0.6 * better + 0.4 * (1 - normalised(size, by, 1.0)), "even": 0.5 * better + 0.5 * normalised(ratio, by)})


def trapezoid_area(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    seq = Window.partitionBy(*by).orderBy(x)
    part = (F.col(y) + F.lead(y).over(seq)) / 2 * (F.lead(x).over(seq) - F.col(x))
    return points.withColumn("part", part).groupBy(*by).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("area"))


def representatives(rows: DataFrame, by: list[str], size: str, key: str, percents: list[int]) -> DataFrame:
    """For each percentile the row at its nearest rank by (size, key). The size at the rank is read off counts; only rows of that size are ranked by key."""
    wanted = F.explode(F.array(*[F.lit(p) for p in percents]))
    rank = F.least(F.floor(F.col("total") * F.col("percentile") / 100), F.col("total") - 1)
    found = value_counts(rows, by, size).withColumn("percentile", wanted).where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
    places = found.select(*by, F.col("value").alias(size), "percentile", (rank - F.col("upto") + F.col("n")).alias("place"))
    ranked = rows.select(*by, size, key).join(places, [*by, size]).withColumn("k", F.row_number().over(Window.partitionBy(*by, size, "percentile").orderBy(key)) - 1)
    return ranked.where("k = place").select(*by, "percentile", key, size)
