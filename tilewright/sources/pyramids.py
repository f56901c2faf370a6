"""Tile pyramids on disk: scans of slide folders and tile trees, Deep Zoom descriptors, and writers of the same."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.tiles import LENIENT_NAME

#: Names of files and the text of descriptors are those of the Deep Zoom format.
TILE_PATH = r"/([^/]+)_files/(\d+)/(\d+)_(\d+)\.(jpg|jpeg|webp|jxl|png)$"
#: Which file stands for a tile that has several, first choice first.
PREFERRED = ("jpg", "jpeg", "webp", "jxl", "png")


def scan_tiles(spark: SparkSession, root: str, with_data: bool = False) -> DataFrame:
    """(slide, level, x, y, ext, path, bytes[, data]) of all tiles under root; other files and non-numeric level folders are passed over.

    Without data only the files' metadata are read: the binary column is pruned from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").rlike(TILE_PATH))
    part = lambda k: F.regexp_extract("path", TILE_PATH, k)
    out = files.select(part(1).alias("slide"), part(2).cast("int").alias("level"), part(3).cast("int").alias("x"), part(4).cast("int").alias("y"), part(5).alias("ext"), "path", F.col("length").alias("bytes"), *["content"] * with_data)
    return out.withColumnRenamed("content", "data")


def preferred_tiles(tiles: DataFrame) -> DataFrame:
    """One file for each tile, by the order of preference of its endings."""
    rank = F.array_position(F.array(*[F.lit(e) for e in PREFERRED]), F.col("ext"))
    rest = [c for c in tiles.columns if c not in ("slide", "level", "x", "y")]
    return tiles.groupBy("slide", "level", "x", "y").agg(F.min_by(F.struct(*rest), rank).alias("t")).select("slide", "level", "x", "y", *[F.col(f"t.{c}").alias(c) for c in rest])


def scan_descriptors(spark: SparkSession, root: str) -> DataFrame:
    """(slide, tile_size, overlap, format, width, height) of the .dzi files under root; null attributes where they aren't given."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dzi").load(root)
    attr = lambda name: F.nullif(F.regexp_extract("value", name + r'\s*=\s*"([^"]*)"', 1), F.lit(""))
    slide = F.regexp_extract(F.input_file_name(), r"([^/]+)\.dzi$", 1)
    return files.select(slide.alias("slide"), *[attr(a).try_cast("int").alias(n) for a, n in (("TileSize", "tile_size"), ("Overlap", "overlap"))], attr("Format").alias("format"), *[attr(a).try_cast("int").alias(n) for a, n in (("Width", "width"), ("Height", "height"))])


def discover(tiles: DataFrame, descriptors: DataFrame, default_tile_size: int = 256) -> DataFrame:
    """Slides that have both tiles and a descriptor: their tile size, top level, and the levels L0, L1 and L2."""
    top = tiles.groupBy("slide").agg(F.max("level").alias("max_level"), F.sum("bytes").alias("disk_bytes"))
    out = top.join(descriptors, "slide").withColumn("tile_size", F.coalesce("tile_size", F.lit(default_tile_size)))
    return out.withColumns({"l0": F.col("max_level"), "l1": F.greatest(F.col("max_level") - 1, F.lit(0)), "l2": F.greatest(F.col("max_level") - 2, F.lit(0))})


def descriptor_text(tile_size: int, width: int, height: int, ending: str = "jpg", overlap: int = 0) -> str:
    return (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" Format="{ending}" Overlap="{overlap}" TileSize="{tile_size}">\n'
        f'  <Size Width="{width}" Height="{height}"/>\n</Image>\n'
    )


def with_url(descriptor, url: str):
    """A descriptor column whose Url attribute is replaced."""
    return F.regexp_replace(descriptor, r'Url="[^"]*"', F.lit(f'Url="{url}"'))


def write_tiles(tiles: DataFrame, root: str) -> DataFrame:
    """Write (slide, level, x, y, ext, data) as a tile tree, from the executors, through Hadoop's file systems only where they are mounted as paths.

    Returns the rows written by slide and level. Files are replaced, so a task that runs again writes the same.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            for row in batch.itertuples(index=False):
                folder = os.path.join(root, f"{row.slide}_files", str(row.level))
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, f"{row.x}_{row.y}.{row.ext}")
                with open(path + f".{os.getpid()}", "wb") as out:
                    out.write(row.data)
                os.replace(path + f".{os.getpid()}", path)
            yield batch.groupby(["slide", "level"]).size().rename("n").reset_index()

    return tiles.select("slide", "level", "x", "y", "ext", "data").mapInPandas(put, "slide string, level int, n bigint").groupBy("slide", "level").agg(F.sum("n").alias("n"))


def requested_tile(name):
    """x and y of a requested tile's name, in its lenient form."""
    return tuple(F.when(name.rlike(LENIENT_NAME), F.regexp_extract(name, LENIENT_NAME, k)).cast("int") for k in (1, 2))


def regions(count, wide: int):
    """Column and row of a linear fragment index on a grid `wide` tiles wide."""
    return count % wide, F.floor(count / wide)


def family_tiles(packs: DataFrame, path: str = "path") -> DataFrame:
    """From pack files named x_y.pack, the keys of the 20 tiles that each family holds: 4 of the level above, 16 of the one above that."""
    at = lambda k: F.regexp_extract(path, r"(?:^|/)(\d+)_(\d+)\.pack$", k).cast("int")
    named = packs.where(F.col(path).rlike(r"(?:^|/)\d+_\d+\.pack$")).select(at(1).alias("x2"), at(2).alias("y2"))
    one = named.select("x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    near = F.col("k") < 4
    i, wide = F.when(near, F.col("k")).otherwise(F.col("k") - 4), F.when(near, 2).otherwise(4)
    return one.select("x2", "y2", F.when(near, "L1").otherwise("L0").alias("level"), (F.col("x2") * wide + i % wide).alias("x"), (F.col("y2") * wide + F.floor(i / wide)).cast("int").alias("y"))
