"""Distributions, conditional counters, pivots and group summaries.

Percentiles are exact and named by convention. They are read off value counts: values are counted first, which map-side aggregation
shrinks, and only distinct values are ranked, so a group is never sorted row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, n, upto, total): rows with the value, rows up to it and rows of the group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    return counted.withColumns({"upto": F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})


def at_rank(rank: Column) -> Column:
    """Aggregate over value_counts: the value at a 0-based rank."""
    return F.min(F.when(F.col("upto") > rank, F.col("value")))


def nearest_rank(percent: int) -> Column:
    """sorted[floor(n p)], not past the last."""
    return at_rank(F.least(F.floor(F.col("total") * percent / 100), F.col("total") - 1))


def linear(percent: int) -> Column:
    """Interpolated between the neighbours of (n - 1) p."""
    whole = F.floor((F.col("total") - 1) * percent / 100)
    part = (F.col("total") - 1) * percent / 100 - whole
    low, high = at_rank(whole), at_rank(F.least(whole + 1, F.col("total") - 1))
    return low + (high - low) * F.max(part)


def exclusive(percent: int) -> Column:
    """Interpolated at (n + 1) p counted from 1, with integers, so that weights are exact; groups of at most 20 (over 95 percent: 100) give the maximum."""
    place = F.floor(percent * (F.col("total") + 1) / 100)
    weight = (percent * (F.col("total") + 1)) % 100
    inside = F.greatest(F.lit(1), F.least(place, F.col("total") - 1))
    low, high = at_rank(inside - 1), at_rank(inside)
    small = F.max(F.col("total")) <= F.lit(20 if percent <= 95 else 100)
    return F.when(small, F.max("value")).otherwise(low + (high - low) * F.max(weight) / 100)


def size_statistics(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """count, total, megabytes of 2^20, whole mean (half to even), least, nearest-rank percentiles and greatest of sizes."""
    n = F.sum("n")
    total = F.sum(F.col("value") * F.col("n"))
    return value_counts(df, by, size).groupBy(*by).agg(
        n.alias("count"), total.cast("bigint").alias("total_bytes"), F.round(total / 1048576, 2).alias("total_mb"), F.bround(total / n, 0).cast("bigint").alias("avg"), F.min("value").alias("min"),
        *[nearest_rank(p).alias(name) for p, name in ((5, "p5"), (25, "p25"), (50, "median"), (75, "p75"), (95, "p95"), (99, "p99"))], F.max("value").alias("max"),
    )


def request_counters(requests: DataFrame, by: list[Column], kinds: list[str], kind: str = "kind", ms: str = "ms") -> DataFrame:
    """Requests in all and by kind; sum, maximum and whole mean of their times."""
    each = [F.count_if(F.col(kind) == k).alias(f"tile_{k}") for k in kinds]
    total = F.sum(ms)
    return requests.groupBy(*by).agg(F.count("*").alias("tile_total"), *each, total.cast("bigint").alias("tile_ms_sum"), F.max(ms).cast("bigint").alias("tile_ms_max"), F.floor(total / F.count("*")).cast("bigint").alias("tile_ms_avg"))


def family_counters(families: DataFrame, by: list[Column], ms: str = "ms") -> DataFrame:
    """Families generated; sum, maximum and whole mean of their times."""
    total = F.sum(ms)
    return families.groupBy(*by).agg(F.count("*").alias("family_generated"), total.cast("bigint").alias("family_ms_sum"), F.max(ms).cast("bigint").alias("family_ms_max"), F.floor(total / F.count("*")).cast("bigint").alias("family_ms_avg"))


def fractional_counters(requests: DataFrame, by: list[Column], kinds: list[str], kind: str = "kind", ms: str = "ms") -> DataFrame:
    """As request_counters, with times kept in whole microseconds, and mean and maximum as fractions of milliseconds."""
    us = F.floor(F.col(ms) * 1000)
    each = [F.count_if(F.col(kind) == k).alias(f"tile_{k}") for k in kinds]
    return requests.groupBy(*by).agg(F.count("*").alias("tile_total"), *each, (F.sum(us) / F.count("*") / 1000.0).alias("tile_avg_ms"), (F.max(us) / 1000.0).alias("tile_max_ms"))


def with_totals(df: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    """Measures by group and, in the row 'all', over everything: one rollup instead of two passes."""
    out = df.rollup(by).agg(F.grouping(by).alias("g"), *[c.alias(name) for name, c in measures.items()])
    return out.withColumn(by, F.when(F.col("g") == 1, "all").otherwise(F.col(by))).drop("g")


def pivot_metric(df: DataFrame, row: str, column: str, values: list, metric: Column) -> DataFrame:
    """One row for each `row` value; the column values are given, so Spark needs no pass to find them."""
    return df.groupBy(row).pivot(column, values).agg(metric)


def best_by(df: DataFrame, by: list[str], score: Column, tie: list[str], keep: list[str], highest: bool = True) -> DataFrame:
    """The best row of each group; of equals the first by `tie`. An aggregate, no sort."""
    key = F.struct((-score if highest else score).alias("s"), *tie)
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("b")).select(*by, *[F.col(f"b.{k}").alias(k) for k in keep])


def share_of_total(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Each row's percentage of its group's total; 0 where the total is 0."""
    total = F.sum(amount).over(Window.partitionBy(*by))
    return df.withColumn("share", F.when(total == 0, 0.0).otherwise(100.0 * F.col(amount) / total))


def running_peak(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    return df.withColumn("peak", F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def array_statistics(plane: Column) -> dict[str, Column]:
    """Least, greatest, mean and population deviation of an array of numbers."""
    n = F.size(plane)
    total = lambda f: F.aggregate(plane, F.lit(0).cast("bigint"), lambda a, v: a + f(v))
    mean = total(lambda v: v) / n
    return {"px_min": F.array_min(plane), "px_max": F.array_max(plane), "px_mean": mean, "px_std": F.sqrt(F.greatest(total(lambda v: v * v) / n - mean * mean, F.lit(0.0)))}
