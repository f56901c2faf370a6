"""Raster operators on planes: row-major arrays of a size that the plan knows.

Operators that move pixels (resampling, cutting, joining, filters) are numpy functions over whole Arrow batches of planes, so a plan stays as small for a
tile of 256 pixels a side as for one of 8. Integer ones are exact and give arrays of integers. Pixel-by-pixel operators are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.scalar import clamp


def _lists(values: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Planes as flat lists, in turn for each valid row, null for the others."""
    wide = int(np.prod(values.shape[1:]))
    offsets = np.concatenate(([0], np.cumsum(np.where(valid, wide, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)).cast(kind), mask=pa.array(~valid))


def on_array(plane: Column, h: int, w: int, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    """f of planes (n, h, w) of integers, flat again; null planes stay null."""

    def run(planes: pa.Array) -> pa.Array:
        valid = planes.is_valid().to_numpy(zero_copy_only=False)
        values = planes.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, h, w)
        return _lists(f(values), valid, pa.int32())

    run.__annotations__ = {"planes": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(plane)


def _taps(size: int, scale: int) -> list[tuple[int, int, int]]:
    """(pixel, next pixel, weight of the next of 256) for each target position: centres aligned, 8-bit fixed point, clamped to the edge."""
    place = np.clip(np.arange(size * scale) * (256 // scale) - (128 - 128 // scale), 0, (size - 1) * 256)
    return list(zip((place >> 8).tolist(), np.minimum((place >> 8) + 1, size - 1).tolist(), (place & 255).tolist(), strict=True))


def bilinear(planes: np.ndarray, scale: int) -> np.ndarray:
    """Bilinear by 2 or 4 in fixed point; the sum of weights is 2^16 and the result is truncated."""
    (y0, y1, fy), (x0, x1, fx) = (np.array(_taps(n, scale)).T for n in planes.shape[1:])
    fy, rows = fy[None, :, None], (planes[:, y0], planes[:, y1])
    wide = (rows[0] * (256 - fy) + rows[1] * fy).astype(np.int64)
    return (wide[:, :, x0] * (256 - fx) + wide[:, :, x1] * fx) >> 16


def nearest(planes: np.ndarray, scale: int) -> np.ndarray:
    return planes.repeat(scale, 1).repeat(scale, 2)


def box_half(planes: np.ndarray) -> np.ndarray:
    """2 by 2 means, (sum + 2) / 4 truncated; odd edges repeat their last pixel."""
    even = np.pad(planes, ((0, 0), (0, planes.shape[1] % 2), (0, planes.shape[2] % 2)), mode="edge")
    return (even[:, ::2, ::2] + even[:, ::2, 1::2] + even[:, 1::2, ::2] + even[:, 1::2, 1::2] + 2) >> 2


def cut(planes: np.ndarray, x: int, y: int, size: int, fill: int) -> np.ndarray:
    out = np.full((len(planes), size, size), fill, planes.dtype)
    own = planes[:, y * size : (y + 1) * size, x * size : (x + 1) * size]
    out[:, : own.shape[1], : own.shape[2]] = own
    return out


def sharpen(planes: np.ndarray, strength: float) -> np.ndarray:
    """src + strength (src - blur), blur by 1-2-1 both ways; 8-bit fixed point, rounded, and negative values shift downwards."""
    factor = int(strength * 256 + 0.5)
    wide = np.pad(planes, ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = wide[:, :-2] + 2 * wide[:, 1:-1] + wide[:, 2:]
    blur = rows[:, :, :-2] + 2 * rows[:, :, 1:-1] + rows[:, :, 2:]
    own = planes * 16
    return np.clip((own * 256 + (own - blur) * factor + 2048) >> 12, 0, 255)


def upsample_bilinear(plane: Column, w: int, h: int, scale: int) -> Column:
    return on_array(plane, h, w, lambda p: bilinear(p, scale))


def upsample_nearest(plane: Column, w: int, h: int, scale: int) -> Column:
    return on_array(plane, h, w, lambda p: nearest(p, scale))


def downsample_box(plane: Column, w: int, h: int) -> Column:
    return on_array(plane, h, w, box_half)


def extract_tile(plane: Column, w: int, h: int, x: int, y: int, size: int, fill: int = 0) -> Column:
    """The tile (x, y) of a plane; what lies outside is fill."""
    return on_array(plane, h, w, lambda p: cut(p, x, y, size, fill))


def unsharp(plane: Column, w: int, h: int, strength: float) -> Column:
    return on_array(plane, h, w, lambda p: sharpen(p, strength))


def mosaics(tiles: pa.Array, size: int, wide: int, fill: int) -> np.ndarray:
    """(n, size * wide, size * wide) planes from lists of tiles in row order; missing tiles are fill."""
    n, each = len(tiles), tiles.value_lengths().fill_null(0).to_numpy()
    flat = tiles.flatten()
    row = np.repeat(np.arange(n), each)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(each) - each, each)
    there = flat.is_valid().to_numpy(zero_copy_only=False) & (place < wide * wide)
    values = flat.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False)
    out = np.full((n, wide * wide, size, size), fill, np.int64)
    out[row[there], place[there]] = values.reshape(-1, size, size)
    return out.reshape(n, wide, wide, size, size).transpose(0, 1, 3, 2, 4).reshape(n, wide * size, wide * size)


def on_mosaic(tiles: Column, size: int, wide: int, f: Callable[[np.ndarray], np.ndarray], fill: int = 0) -> Column:
    """f of the planes that arrays of wide by wide tiles make."""

    def run(column: pa.Array) -> pa.Array:
        planes = mosaics(column, size, wide, fill)
        return _lists(f(planes), np.ones(len(planes), bool), pa.int32())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(tiles)


def mosaic(tiles: Column, size: int, wide: int) -> Column:
    """One plane of wide by wide tiles from an array of planes in row order; missing tiles leave zeros."""
    return on_mosaic(tiles, size, wide, lambda p: p)


def residual_raw(truth: Column, predicted: Column) -> Column:
    return F.zip_with(truth, predicted, lambda a, b: a - b)


def residual_centred(raw: Column) -> Column:
    return F.transform(raw, lambda v: clamp(v + 128))


def apply_residual(predicted: Column, centred: Column) -> Column:
    return F.zip_with(predicted, centred, lambda p, r: clamp(p + (r - 128)))


def dark_rows(plane: Column, w: int, h: int, level: int = 10, share: float = 0.8) -> Column:
    """How many rows have more than `share` of their pixels under `level`."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.size(F.filter(F.slice(plane, y * w + 1, w), lambda v: v < level)))
    return F.size(F.filter(rows, lambda n: n > share * w))


# --- numpy operators, on planes of shape (n, h, w) ---


def on_planes(df: DataFrame, column: str, out: str, f: Callable[[np.ndarray], np.ndarray], w: int, h: int, keep: list[str]) -> DataFrame:
    """keep columns and f of all planes of a batch at once, as an array of doubles."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, h, w)
            got = f(values).reshape(len(values), -1)
            lists = pa.ListArray.from_arrays(np.arange(0, got.size + 1, max(got.shape[1], 1), dtype=np.int32)[: len(values) + 1], pa.array(got.reshape(-1)))
            yield pa.record_batch([*batch.columns[: len(keep)], lists], names=schema.names)

    return df.select(*keep, column).mapInArrow(run, schema)


def tap_matrix(size: int, scale: int = 2) -> np.ndarray:
    """The fixed-point bilinear upsampler of one axis as a matrix, targets by sources."""
    out = np.zeros((size * scale, size))
    for row, (a, b, f) in enumerate(_taps(size, scale)):
        out[row, a] += 1 - f / 256
        out[row, b] += f / 256
    return out


def upsample_float(planes: np.ndarray, scale: int = 2) -> np.ndarray:
    rows, cols = tap_matrix(planes.shape[1], scale), tap_matrix(planes.shape[2], scale)
    return rows @ planes @ cols.T


def upsample_adjoint(planes: np.ndarray, scale: int = 2) -> np.ndarray:
    """The transpose of upsample_float: what each source pixel gave, gathered back."""
    rows, cols = tap_matrix(planes.shape[1] // scale, scale), tap_matrix(planes.shape[2] // scale, scale)
    return rows.T @ planes @ cols


def optimised_base(base: np.ndarray, target: np.ndarray, most: float = 15.0, steps: int = 50, rate: float = 0.3) -> np.ndarray:
    """The small planes moved, by at most `most` and within 0..255, so that their upsampling comes near the target: projected gradient steps.

    Each step predicts from rounded pixels, as a decoder would; the state after the step of least error before it is the result.
    """
    now, best = base.copy(), base.copy()
    least = np.full(len(base), np.inf)
    for _ in range(steps):
        rest = target - np.floor(upsample_float(np.floor(np.clip(now, 0, 255) + 0.5)))
        error = (rest**2).sum((1, 2))
        now = np.clip(np.clip(now + rate * upsample_adjoint(rest), base - most, base + most), 0, 255)
        better = error < least
        least[better], best[better] = error[better], now[better]
    return np.floor(np.clip(best, 0, 255) + 0.5)


def optimised_chroma(small: np.ndarray, target: np.ndarray, most: float = 8.0, steps: int = 50, rate: float = 0.25) -> np.ndarray:
    """As optimised_base, with the mean of each 2 by 2 block of the error in place of the gradient, and the last state as the result."""
    now = small.copy()
    for _ in range(steps):
        rest = target - np.floor(upsample_float(np.floor(np.clip(now, 0, 255) + 0.5)))
        n, h, w = rest.shape
        now = np.clip(np.clip(now + rate * rest.reshape(n, h // 2, 2, w // 2, 2).mean((2, 4)), small - most, small + most), 0, 255)
    return np.floor(np.clip(now, 0, 255) + 0.5)


def kernel_matrix(size: int, target: int, support: float, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A resampling matrix, targets by sources: the kernel is widened when shrinking, and weights sum to 1."""
    ratio = size / target
    widen = max(1.0, ratio)
    centre = (np.arange(target) + 0.5) * ratio - 0.5
    weight = kernel((np.arange(size)[None, :] - centre[:, None]) / widen)
    weight[np.abs(np.arange(size)[None, :] - centre[:, None]) > support * widen] = 0
    return weight / weight.sum(1, keepdims=True)


def lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def resample(planes: np.ndarray, w: int, h: int, kind: str, most: float | None = 255) -> np.ndarray:
    """Planes at another size; within 0 and most, if there is one."""
    support, kernel = {"lanczos3": (3.0, lanczos3), "triangle": (1.0, triangle)}[kind]
    out = kernel_matrix(planes.shape[1], h, support, kernel) @ planes @ kernel_matrix(planes.shape[2], w, support, kernel).T
    return out if most is None else np.clip(out, 0, most)


def dct_matrix(n: int = 8) -> np.ndarray:
    k = np.arange(n)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def dct(planes: np.ndarray) -> np.ndarray:
    m = dct_matrix(planes.shape[1])
    return m @ planes @ m.T


def inverse_dct(planes: np.ndarray) -> np.ndarray:
    m = dct_matrix(planes.shape[1])
    return m.T @ planes @ m


def largest_coefficients(planes: np.ndarray, k: int) -> np.ndarray:
    """The field from its k largest DCT coefficients; of equals, the earlier."""
    spectrum = dct(planes).reshape(len(planes), -1)
    order = np.argsort(-np.abs(spectrum), axis=1, kind="stable")
    kept = np.zeros_like(spectrum)
    rows = np.arange(len(planes))[:, None]
    kept[rows, order[:, :k]] = spectrum[rows, order[:, :k]]
    return inverse_dct(kept.reshape(planes.shape))
