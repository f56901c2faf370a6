"""Summaries and manifests in JSON, read with a fixed schema, and written."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = (
    "encoder string, quality int, baseq int, l1q int, l0q int, subsamp string, optl2 boolean, sharpen float, tile_size int, l1_residuals bigint, l0_residuals bigint, total_bytes bigint, parents bigint, pack boolean, elapsed_secs double, "
    "source string, source_w int, source_h int, l2_bytes bigint, tiles array<struct<level: string, tx: int, ty: int, residual_bytes: bigint, y_psnr_db: double, y_mse: double>>"
)
BASELINE = "tiles map<string, struct<size: bigint, psnr: double, ssim: double>>"


def read_summaries(spark: SparkSession, path: str, schema: str = SUMMARY) -> DataFrame:
    """One row for each JSON file, named by its folder as `run`. Fields that a file hasn't are null."""
    files = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return files.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def size_summary(sizes: DataFrame, by: str) -> DataFrame:
    """One JSON text `stats` of the size statistics (see aggregates.size_statistics) of each group, numbers as they are, megabytes and means as texts."""
    fields = [c for c in sizes.columns if c != by]
    texts = {"total_mb": F.format_string("%.2f", "total_mb"), "avg": F.col("avg").cast("string")}
    return sizes.select(by, F.to_json(F.struct(*[texts.get(c, F.col(c)).alias(c) for c in fields])).alias("stats"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, values) of the .npy files under a path: numbers as doubles, row-major. A file is read whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.load(io.BytesIO(data), allow_pickle=False)
                yield pa.record_batch([pa.array([name]), pa.array([list(found.shape)], pa.list_(pa.int64())), pa.array([found.reshape(-1).astype(float)], pa.list_(pa.float64()))], names=["path", "shape", "values"])

    return files.mapInArrow(load, "path string, shape array<bigint>, values array<double>")


def read_captures(spark: SparkSession, path: str, schema: str = SUMMARY) -> DataFrame:
    """Summaries with the arrays that lie in their folders: (run, ..., arrays), arrays as (name, shape, values)."""
    own = read_arrays(spark, path)
    held = own.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("name"), "shape", "values"))).alias("arrays"))
    return read_summaries(spark, path, schema).join(held, "run", "left")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, px) of the images under a path, colours interleaved row by row; Spark's own source decodes them, in blue, green, red order."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path).select("image.*")

    def order(data: pa.Array, channels: pa.Array) -> pa.Array:
        out = []
        for one, n in zip(data.to_pylist(), channels.to_pylist(), strict=True):
            px = np.frombuffer(one, np.uint8).reshape(-1, n)
            out.append((px[:, 2::-1] if n > 1 else px.repeat(3, 1)).reshape(-1).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    order.__annotations__ = {"data": pa.Array, "channels": pa.Array, "return": pa.Array}
    return found.select(F.col("origin").alias("path"), F.col("width").alias("w"), F.col("height").alias("h"), F.arrow_udf(order, "array<int>")("data", "nChannels").alias("px"))


def write_summaries(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
