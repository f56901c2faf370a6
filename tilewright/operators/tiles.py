"""Tiles, parents and families. A family is one tile of level L2, its 4 children of L1 and 16 grandchildren of L0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT_NAME = r"^(\d+)_(\d+)\.jpg$"
LENIENT_NAME = r"^(\d+)_(\d+)(?:\.jpg|\.webp)?$"


def tile_coordinates(name: Column, strict: bool = True) -> tuple[Column, Column]:
    """x and y of a tile's file name; null where it is none. Lenient names may end in .webp or in nothing."""
    pattern = STRICT_NAME if strict else LENIENT_NAME
    return tuple(F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k)).cast("int") for k in (1, 2))


def parent(coordinate: Column, levels: int = 1) -> Column:
    return F.shiftright(coordinate, levels)


def child_index(x: Column, y: Column, levels: int) -> Column:
    """The place among its ancestor's children, row by row: 2 wide one level down, 4 wide two."""
    wide = 1 << levels
    return (y % wide) * wide + x % wide


def with_family(tiles: DataFrame, x: str = "x", y: str = "y", levels: int = 2) -> DataFrame:
    return tiles.withColumns({"x2": parent(F.col(x), levels), "y2": parent(F.col(y), levels)})


def prune_by_tile(tiles: DataFrame, x: int, y: int, levels: int = 2) -> DataFrame:
    """One tile's row, by a predicate on the family too, which partition pruning and Parquet statistics can use."""
    return tiles.where((F.col("x2") == x >> levels) & (F.col("y2") == y >> levels) & (F.col("x") == x) & (F.col("y") == y))


def route(level: Column, x: Column, y: Column, l2: Column | int) -> tuple[Column, Column, Column]:
    """(kind, family x, family y) of a tile request: baseline up to L2, then L1 and L0; deeper is an error."""
    kind = F.when(level <= l2, "baseline").when(level == l2 + 1, "L1").when(level == l2 + 2, "L0").otherwise("error")
    at = lambda c: F.when(kind == "L1", F.shiftright(c, 1)).when(kind == "L0", F.shiftright(c, 2))
    return kind, at(x), at(y)


def children(parents: DataFrame, levels: int) -> DataFrame:
    """A row for each child of (x2, y2), with its place idx: an explode, no join."""
    wide = 1 << levels
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dy * wide + dx).alias("idx")) for dy in range(wide) for dx in range(wide)])
    out = parents.withColumn("c", F.explode(steps))
    return out.select(*parents.columns, (F.col("x2") * wide + F.col("c.dx")).alias("x"), (F.col("y2") * wide + F.col("c.dy")).alias("y"), F.col("c.idx").alias("idx"))


def first_parents(tiles: DataFrame, n: int, row_major: bool) -> DataFrame:
    """The first n distinct families: column by column (x, then y), or row by row."""
    order = ["y2", "x2"] if row_major else ["x2", "y2"]
    return tiles.select("x2", "y2").distinct().orderBy(*order).limit(n)


def one_per_family(tiles: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """One tile of each family, the same at every run: the least by a seeded hash, an aggregate without a sort."""
    rank = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)).alias("h"), *key)
    return tiles.groupBy("x2", "y2").agg(F.min(rank).alias("r")).select("x2", "y2", *[F.col(f"r.{k}").alias(k) for k in key])


def preferred_sample(tiles: DataFrame, key: list[str], share: float, n: int, seed: int = 7) -> DataFrame:
    """(level, x, y) of n tiles drawn by a hash of their keys: a share of them as they are (L0), the others as their parents (L1). The same rows on every run."""
    draw = lambda s: F.md5(F.concat_ws(":", F.lit(str(s)), *key))
    large = F.substring(draw(seed), 1, 2) < f"{int(share * 256):02x}"
    pick = lambda c: F.when(large, F.col(c)).otherwise(parent(F.col(c))).alias(c)
    return tiles.orderBy(draw(seed + 1), *key).limit(n).select(F.when(large, "L0").otherwise("L1").alias("level"), pick("x"), pick("y"))


def retile(tiles: DataFrame, side: int, new_side: int, width: int, height: int) -> DataFrame:
    """(x, y, px, blank) of an image of width by height pixels cut anew: from tiles (x, y, px) of `side` pixels to tiles of new_side.

    Each tile goes to the new tiles that it meets, at most (side / new_side + 2) squared, and those are aggregated; a new tile holds at most (new_side / side + 2)
    squared pieces. Missing tiles and what lies beyond the image are zeros; a tile of zeros is blank.
    """
    at = lambda c, size: F.explode(F.sequence(F.floor(F.col(c) * side / new_side).cast("int"), F.floor(F.least((F.col(c) + 1) * side - 1, F.lit(size - 1)) / new_side).cast("int")))
    inside = tiles.where((F.col("x") * side < width) & (F.col("y") * side < height))
    sent = inside.withColumn("nx", at("x", width)).withColumn("ny", at("y", height))
    held = sent.groupBy("nx", "ny").agg(F.collect_list(F.struct("x", "y", "px")).alias("pieces"))

    def run(nx: pa.Array, ny: pa.Array, pieces: pa.Array) -> pa.Array:
        out = np.zeros((len(nx), new_side, new_side), np.int64)
        for k, (cx, cy, own) in enumerate(zip(nx.to_pylist(), ny.to_pylist(), pieces, strict=True)):
            left, top = cx * new_side, cy * new_side
            for piece in own.values:
                x, y = piece["x"].as_py() * side, piece["y"].as_py() * side
                plane = piece["px"].values.to_numpy(zero_copy_only=False).reshape(side, side)
                x0, x1, y0, y1 = max(x, left), min(x + side, left + new_side, width), max(y, top), min(y + side, top + new_side, height)
                out[k, y0 - top : y1 - top, x0 - left : x1 - left] = plane[y0 - y : y1 - y, x0 - x : x1 - x]
        return pa.array(list(out.reshape(len(out), -1)), pa.list_(pa.int32()))

    run.__annotations__ = {"nx": pa.Array, "ny": pa.Array, "pieces": pa.Array, "return": pa.Array}
    cut = held.select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.arrow_udf(run, "array<int>")("nx", "ny", "pieces").alias("px"))
    return cut.withColumn("blank", F.array_max("px") == 0)


def family_coverage(tiles: DataFrame, full: int, empty: Column) -> DataFrame:
    """Tiles present and empty of each family; whether all are empty, and whether some are missing."""
    out = tiles.groupBy("x2", "y2").agg(F.count("*").alias("tiles"), F.count_if(empty).alias("empty_tiles"))
    return out.withColumns({"all_empty": F.col("empty_tiles") == F.col("tiles"), "is_partial": F.col("tiles") < full})


def pyramid_levels(slides: DataFrame, width: Column, height: Column) -> DataFrame:
    """max_level and the levels L0, L1, L2 that it has; none goes under 0."""
    from tilewright.functions.scalar import dzi_max_level

    top = dzi_max_level(width, height)
    return slides.withColumns({"max_level": top, "l0": top, "l1": F.greatest(top - 1, F.lit(0)), "l2": F.greatest(top - 2, F.lit(0))})
