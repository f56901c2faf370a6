"""Encoding and reconstruction of whole families, closed loop: every residual is taken against what a decoder will predict.

A family is a large plane (its L0 tiles joined), with side 4 times that of its L2 plane. The codec is the dead-zone one; all families of an
Arrow batch are computed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import codec, raster


def predicted(planes: np.ndarray) -> np.ndarray:
    return np.floor(raster.upsample_float(planes))


def encode(full: np.ndarray, l1_step: float, l0_step: float, optimise: bool = False) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """(L2 planes, deflated residuals of L1, of L0) of full planes (n, 4 s, 4 s). Both small levels come from the full one."""
    n, h, w = full.shape
    l1 = np.round(raster.resample(full, w // 2, h // 2, "lanczos3"))
    l2 = np.round(raster.resample(full, w // 4, h // 4, "lanczos3"))
    if optimise:
        l2 = raster.optimised_base(l2, l1)
    first = [codec.deadzone_encode(r, l1_step, wide=True) for r in l1 - predicted(l2)]
    seen = rebuild_level(l2, first)
    second = [codec.deadzone_encode(r, l0_step, wide=True) for r in full - predicted(seen)]
    return l2, first, second


def rebuild_level(small: np.ndarray, residuals: list[bytes]) -> np.ndarray:
    return np.clip(np.round(predicted(small) + np.stack([codec.deadzone_decode(r, wide=True) for r in residuals])), 0, 255)


def swept(full: np.ndarray, name: str, step: float) -> tuple[int, float, float]:
    """(bytes, squared error of L1, of L0) of full planes coded closed loop by a codec and a step for both levels; L2 comes without loss."""
    n, h, w = full.shape
    l1 = np.round(raster.resample(full, w // 2, h // 2, "lanczos3"))
    now = np.round(raster.resample(full, w // 4, h // 4, "lanczos3"))
    encode, decode = codec.codec(name)
    total, errors = 0, []
    for truth in (l1, full):
        guess = predicted(now)
        coded = [encode(r, step) for r in truth - guess]
        total += sum(map(len, coded))
        now = np.clip(np.round(guess + np.stack([decode(c) for c in coded])), 0, 255)
        errors.append(float(((now - truth) ** 2).sum()))
    return total, *errors


def encode_families(planes: DataFrame, key: list[str], side: int, l1_step: float, l0_step: float, optimise: bool = False) -> DataFrame:
    """key and (l2 array<double>, l1_residual, l0_residual binary) from a column px of side * side pixels."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in planes.select(*key).schema) + ", l2 array<double>, l1_residual binary, l0_residual binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            full = batch.column(len(key)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, side, side)
            l2, first, second = encode(full, l1_step, l0_step, optimise)
            yield pa.record_batch([*batch.columns[: len(key)], pa.array(list(l2.reshape(len(l2), -1)), pa.list_(pa.float64())), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=[*key, "l2", "l1_residual", "l0_residual"])

    return planes.select(*key, "px").mapInArrow(run, schema)


def reconstruct_families(coded: DataFrame, key: list[str], side: int) -> DataFrame:
    """key and the rebuilt L1 and L0 planes of encode_families' rows."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.select(*key).schema) + ", l1 array<double>, l0 array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = len(key)
            l2 = batch.column(k).flatten().to_numpy().reshape(-1, side // 4, side // 4)
            l1 = rebuild_level(l2, batch.column(k + 1).to_pylist())
            l0 = rebuild_level(l1, batch.column(k + 2).to_pylist())
            yield pa.record_batch([*batch.columns[:k], *[pa.array(list(p.reshape(len(p), -1)), pa.list_(pa.float64())) for p in (l1, l0)]], names=[*key, "l1", "l0"])

    return coded.select(*key, "l2", "l1_residual", "l0_residual").mapInArrow(run, schema)


def lanczos_half(planes: np.ndarray) -> np.ndarray:
    n, h, w = planes.shape
    return np.floor(raster.resample(planes.astype(float), w // 2, h // 2, "lanczos3") + 0.5).astype(np.int64)


HALVES = {"lanczos3": lanczos_half, "box": raster.box_half}


def lower_levels(tiles: DataFrame, level: int, side: int, stop: int = 0, white: int = 255, kind: str = "lanczos3") -> list[DataFrame]:
    """The levels under `level`, down to `stop`: each tile from its four children, missing ones white, halved by Lanczos or by box means.

    One aggregate on the parents' keys for each level; a level has a quarter of the rows of the one above. (x, y, px) in and out.
    """
    out = []
    now = tiles
    for _ in range(level - stop):
        idx = (F.col("y") % 2) * 2 + F.col("x") % 2
        each = F.array(*[F.max_by("px", F.when(idx == k, 1)) for k in range(4)])
        grouped = now.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(each.alias("four"))
        now = grouped.select("x", "y", raster.on_mosaic(F.col("four"), side, 2, HALVES[kind], white).alias("px"))
        out.append(now)
    return out


def sharpened_levels(tiles: DataFrame, level: int, side: int, cols: int, rows: int, strength: float = 0.25, stop: int = 0) -> list[DataFrame]:
    """As lower_levels over one whole image of cols by rows tiles: box means, then an unsharp mask that sees across tiles.

    Missing tiles are black. Each level's tiles get a rim of one pixel from their neighbours, by one more aggregate; the image's own edge repeats.
    """
    out = []
    now = tiles
    width, height = cols * side, rows * side
    for _ in range(level - stop):
        width, height = max(1, width // 2), max(1, height // 2)
        idx = (F.col("y") % 2) * 2 + F.col("x") % 2
        each = F.array(*[F.max_by("px", F.when(idx == k, 1)) for k in range(4)])
        grouped = now.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(each.alias("four"))
        half = grouped.select("x", "y", raster.on_mosaic(F.col("four"), side, 2, raster.box_half).alias("px"))
        steps = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        sent = half.select("px", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(4 - 3 * dy - dx).alias("from")) for dx, dy in steps])).alias("to")).select("px", "to.x", "to.y", "to.from")
        nine = F.array(*[F.max_by("px", F.when(F.col("from") == k, 1)) for k in range(9)])
        met = sent.groupBy("x", "y").agg(nine.alias("nine"), F.max(F.col("from") == 4).alias("own")).where("own")
        # pixels of this tile inside the image; beyond, the image's last ones repeat before the mask and nothing is drawn after it
        inside = lambda at, size: F.least(F.lit(side), F.greatest(F.lit(0), F.lit(size) - F.col(at) * side))
        now = met.select("x", "y", _rimmed(F.col("nine"), F.col("x"), F.col("y"), inside("x", width), inside("y", height), side, strength).alias("px"))
        out.append(now)
    return out


def _rimmed(nine: Column, x: Column, y: Column, w: Column, h: Column, side: int, strength: float) -> Column:
    def run(nine: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        planes = raster.mosaics(nine, side, 3, 0)[:, side - 1 : 2 * side + 1, side - 1 : 2 * side + 1].copy()
        out = np.zeros((len(planes), side, side), np.int64)
        for k, (cx, cy, cw, ch) in enumerate(zip(x.to_pylist(), y.to_pylist(), w.to_pylist(), h.to_pylist(), strict=True)):
            if not cw or not ch:
                continue
            p = planes[k]
            if cx == 0:
                p[:, 0] = p[:, 1]
            if cy == 0:
                p[0] = p[1]
            if cw < side or not nine[k][5].is_valid:
                p[:, cw + 1 :] = p[:, cw : cw + 1]
            if ch < side or not nine[k][7].is_valid:
                p[ch + 1 :] = p[ch : ch + 1]
            out[k, :ch, :cw] = raster.sharpen(p[None], strength)[0, 1 : ch + 1, 1 : cw + 1]
        return raster._lists(out, np.ones(len(out), bool), pa.int32())

    run.__annotations__ = {k: pa.Array for k in ("nine", "x", "y", "w", "h", "return")}
    return F.arrow_udf(run, "array<int>")(nine, x, y, w, h)
