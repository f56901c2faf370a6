"""Packs and bundles as tables, and back: one row for each entry of a family's pack."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import codec
from tilewright.operators.windows import offsets

ENTRY = "x2 int, y2 int, level_kind int, idx_in_parent int, offset bigint, length bigint, data binary"
PACK_NAME = r"(\d+)_(\d+)\.pack$"


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all packs under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pack").load(root)
    at = lambda k: F.regexp_extract("path", PACK_NAME, k).cast("int")
    return unpack(files.select(at(1).alias("x2"), at(2).alias("y2"), F.col("content").alias("pack")))


def unpack(packs: DataFrame) -> DataFrame:
    """(x2, y2, pack) to entries. A damaged pack fails its task with the reason."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, y, *entry) for x, y, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for entry in codec.decode_pack(data)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int32()] * 4, pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["x2", "y2", "level_kind", "idx_in_parent", "offset", "length", "data"])

    return packs.select("x2", "y2", "pack").mapInArrow(read, ENTRY)


def pack(entries: DataFrame) -> DataFrame:
    """(x2, y2, level_kind, idx_in_parent, data) to (x2, y2, n, pack). A family has 20 entries at most, so its list is small; L1 comes first, in order."""
    listed = entries.groupBy("x2", "y2").agg(F.array_sort(F.collect_list(F.struct((-F.col("level_kind")).alias("k"), F.col("idx_in_parent").alias("i"), F.col("data").alias("d")))).alias("e"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codec.encode_pack([(-e["k"], e["i"], e["d"]) for e in row]) for row in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(r) for r in batch.column(2)], pa.int32()), pa.array(made, pa.binary())], names=["x2", "y2", "n", "pack"])

    return listed.mapInArrow(write, "x2 int, y2 int, n int, pack binary")


def lookup(entries: DataFrame, level_kind: int, idx: int) -> DataFrame:
    return entries.where((F.col("level_kind") == level_kind) & (F.col("idx_in_parent") == idx))


def bundle_layout(packs: DataFrame, cols: int) -> DataFrame:
    """Where each pack goes in its slide's bundle: packs in row-major order after the header. One running sum for each slide, over sizes only."""
    order = packs.withColumn("place", F.col("y2") * cols + F.col("x2")).withColumn("length", F.octet_length("pack"))
    return offsets(order.select("slide", "x2", "y2", "place", "length"), ["slide"], ["place"], "length", codec.BUNDLE_HEAD.size)


def bundle(packs: DataFrame, cols: int, rows: int) -> DataFrame:
    """(slide, bundle): each slide's packs as one file. The format is one file, so a slide's packs meet in one task; tables of packs need none."""

    def build(table: pa.Table) -> pa.Table:
        families = sorted(zip(table["x2"].to_pylist(), table["y2"].to_pylist(), table["pack"].to_pylist(), strict=True), key=lambda f: (f[1], f[0]))
        return pa.table([table["slide"][:1], pa.array([codec.encode_bundle(cols, rows, families)], pa.binary())], names=["slide", "bundle"])

    return packs.select("slide", "x2", "y2", "pack").groupBy("slide").applyInArrow(build, "slide string, bundle binary")


def read_bundle(bundles: DataFrame) -> DataFrame:
    """(slide, x2, y2, offset, length, pack) of the families that bundles have."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slide, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(slide, c, r, at, n, data[at : at + n]) for c, r, at, n in codec.bundle_index(data)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["slide", "x2", "y2", "offset", "length", "pack"])

    return bundles.select("slide", "bundle").mapInArrow(read, "slide string, x2 int, y2 int, offset bigint, length bigint, pack binary")


def parents_to_decode(residuals: DataFrame | None = None, packs: DataFrame | None = None, pack_file: DataFrame | None = None, bundle_index: DataFrame | None = None, baseline: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The families to decode, from exactly one source; of a bundle only those with a baseline tile. Sorted by (x2, y2) and cut off at `most`."""
    given = [s for s in (residuals, packs, pack_file, bundle_index) if s is not None]
    if len(given) != 1:
        raise ValueError("give exactly one source")
    found = given[0].select("x2", "y2").distinct()
    if bundle_index is not None:
        found = found.join(baseline.select("x2", "y2"), ["x2", "y2"], "left_semi")
    found = found.orderBy("x2", "y2")
    return found if most is None else found.limit(most)
