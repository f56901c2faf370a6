"""Lookups between tiles, residuals and curves, as joins that scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_parents(tiles: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """N:1 on computed family keys; which side is broadcast is for the optimiser, by size."""
    return tiles.join(parents, on, "inner")


def first_available(wanted: DataFrame, key: list[str], sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Each wanted key with the value of the first source that has it, and that source's name; null and 'missing' if none has."""
    out = wanted
    for k, (_, table, value) in enumerate(sources):
        out = out.join(table.select(*key, F.col(value).alias(f"v{k}"), F.lit(True).alias(f"has{k}")), key, "left")
    chosen, name = F.lit(None), F.lit("missing")
    for k in range(len(sources) - 1, -1, -1):
        chosen = F.when(F.col(f"has{k}"), F.col(f"v{k}")).otherwise(chosen)
        name = F.when(F.col(f"has{k}"), sources[k][0]).otherwise(name)
    return out.withColumns({"value": chosen, "found_in": name}).drop(*[f"{p}{k}" for k in range(len(sources)) for p in ("v", "has")])


def present(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(others.select(*key), key, "left_semi")


def missing(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(others.select(*key), key, "left_anti")


#: Ranges into which nearest matches cut the sizes.
RANGES = 64


def nearest_size(points: DataFrame, references: DataFrame, by: list[str], size: str, keep: list[str]) -> DataFrame:
    """Each point with the reference of its group nearest in size; of equally near ones the smaller, of equal sizes the first by `keep`.

    References and points are merged in size order and each point looks to both sides, so nothing is crossed. No group is one task: sizes are cut into
    RANGES by approximate quantiles of the references, each range is sorted apart, and what lies beyond its ends is carried over from the other ranges' least
    and greatest references.
    """
    names = [f"ref_{k}" for k in (size, *keep)]
    refs = references.groupBy(*by, size).agg(F.min(F.struct(*keep)).alias("k"))
    ref_rows = refs.select(*by, F.col(size).alias("at"), F.struct(F.col(size).alias(names[0]), *[F.col(f"k.{k}").alias(n) for k, n in zip(keep, names[1:], strict=True)]).alias("ref"))
    found = references.agg(F.percentile_approx(size, [k / RANGES for k in range(1, RANGES)], 1000)).first()[0]
    cuts = sorted(set(found or []))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("at"))) if cuts else F.lit(0)
    both = points.withColumn("at", F.col(size)).unionByName(ref_rows, allowMissingColumns=True).withColumn("range", place)
    ends = both.where(F.col("ref").isNotNull()).groupBy(*by, "range").agg(F.min("ref").alias("least"), F.max("ref").alias("most"))
    ranges = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("range")
    every = ends.select(*by).distinct().select(*by, ranges).join(ends, [*by, "range"], "left")
    order = Window.partitionBy(*by).orderBy("range")  # RANGES rows a group
    carried = every.select(*by, "range", F.last("most", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("least", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    span = Window.partitionBy(*by, "range").orderBy("at")
    low = F.last("ref", ignorenulls=True).over(span.rangeBetween(Window.unboundedPreceding, 0))
    high = F.first("ref", ignorenulls=True).over(span.rangeBetween(0, Window.unboundedFollowing))
    met = both.withColumns({"low": low, "high": high}).where(F.col("ref").isNull()).join(carried, [*by, "range"], "left")
    met = met.withColumns({"low": F.coalesce("low", "below"), "high": F.coalesce("high", "above")})
    down, up = F.col("at") - F.col(f"low.{names[0]}"), F.col(f"high.{names[0]}") - F.col("at")
    best = F.when(F.col("high").isNull() | (down <= up), F.col("low")).otherwise(F.col("high"))
    return met.withColumn("best", best).select(*points.columns, *[F.col(f"best.{n}").alias(n) for n in names])


def common_range(curves: DataFrame, series: str, value: str, reference: str) -> DataFrame:
    """For each series the overlap of its range with the reference series': low and high, null where they don't meet."""
    spans = curves.groupBy(series).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    own = F.col(series) == reference
    all_rows = Window.partitionBy(F.lit(0))  # one row for each series
    with_ref = spans.withColumns({"ra": F.max(F.when(own, F.col("a"))).over(all_rows), "rb": F.max(F.when(own, F.col("b"))).over(all_rows)})
    low, high = F.greatest("a", "ra"), F.least("b", "rb")
    return with_ref.where(~own).select(series, F.when(low < high, low).alias("low"), F.when(low < high, high).alias("high"))


def grid_probe(found: DataFrame, axes: dict[str, list], value: str) -> DataFrame:
    """Every combination of the axes' given values, with the value found for it, or null. The grid is an explode of literals."""
    grid = found.sparkSession.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id").join(found.select(*axes, value), list(axes), "left")


def compare_runs(tiles: DataFrame, run: str, a, b, key: list[str], value: str) -> DataFrame:
    """Tiles that two runs share, side by side: one pass and a conditional aggregate, not a self join."""
    pick = lambda r: F.max(F.when(F.col(run) == r, F.col(value)))
    out = tiles.where(F.col(run).isin(a, b)).groupBy(*key).agg(pick(a).alias("value_a"), pick(b).alias("value_b"))
    return out.where("value_a IS NOT NULL AND value_b IS NOT NULL").withColumn("diff", F.col("value_b") - F.col("value_a"))


def compare_many(tiles: DataFrame, run: str, names: list, key: list[str], value: str) -> DataFrame:
    """Tiles that all the given runs share, a column value_<k> for each; one pass and a conditional aggregate."""
    each = [F.max(F.when(F.col(run) == name, F.col(value))).alias(f"value_{k}") for k, name in enumerate(names)]
    return tiles.where(F.col(run).isin(*names)).groupBy(*key).agg(*each).where(" AND ".join(f"value_{k} IS NOT NULL" for k in range(len(names))))


def aligned(left: Column, right: Column, f) -> Column:
    """Pixel by pixel over two planes."""
    return F.zip_with(left, right, f)
