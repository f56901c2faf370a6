"""Colour planes and the reconstruction of colour tiles, in numpy over Arrow batches. Planes are (n, h, w) of 0..255, colours (n, h, w, 3).

The weights of BT.601 are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.operators import raster


def fitted(values: np.ndarray) -> np.ndarray:
    """Rounded half away from zero, within 0..255."""
    return np.clip(np.trunc(values + np.copysign(0.5, values)), 0, 255).astype(np.int64)


def split(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, Cb and Cr planes of colours."""
    r, g, b = np.moveaxis(rgb.astype(float), -1, 0)
    return fitted(0.299 * r + 0.587 * g + 0.114 * b), fitted(-0.168736 * r - 0.331264 * g + 0.5 * b + 128.0), fitted(0.5 * r - 0.418688 * g - 0.081312 * b + 128.0)


def merge(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Colours of planes, the inverse of split to two units."""
    y, u, v = y.astype(float), cb - 128.0, cr - 128.0
    return np.stack((fitted(y + 1.402 * v), fitted(y - 0.344136 * u - 0.714136 * v), fitted(y + 1.772 * u)), -1)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma, truncated."""
    return (rgb.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.int64)


def halved_chroma(plane: np.ndarray, optimise: bool = False) -> np.ndarray:
    """A chroma plane at half size: box means, moved so that their upsampling comes near the plane, if wanted."""
    small = raster.box_half(plane)
    return raster.optimised_chroma(small.astype(float), plane.astype(float)).astype(np.int64) if optimise else small


def region(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, x: int, top: int, size: int, residual: np.ndarray) -> np.ndarray:
    """The colour tile (size, size, 3) at a place of predicted planes (h, w), its luma corrected by a residual centred at 128; black outside the planes."""
    out = np.zeros((size, size, 3), np.int64)
    own = (slice(top, top + size), slice(x, x + size))
    luma = y[own]
    h, w = luma.shape
    if h and w:
        out[:h, :w] = merge(np.clip(luma + residual[:h, :w] - 128, 0, 255)[None], cb[own][None], cr[own][None])[0]
    return out


def rebuild(l2: np.ndarray, residuals: list[list[np.ndarray | None]], baselines: list[list[np.ndarray | None]], sharpen: float | None = None) -> list[list[tuple[np.ndarray, bool]]]:
    """(tile, whether a residual made it) of the 4 tiles over an L2 tile (s, s, 3) and of the 16 over those.

    A tile is its prediction and its residual, or else its baseline; one with neither is an error. Luma of the larger level is predicted from the rebuilt
    smaller one, chroma of both from L2.
    """
    size = len(l2)
    if sharpen is not None:
        l2 = np.stack([raster.sharpen(l2[None, ..., c], sharpen)[0] for c in range(3)], -1)
    y, cb, cr = split(l2[None])
    out = []
    for level, wide in enumerate((2, 4)):
        y, cb, cr = (raster.bilinear(p, 2) for p in (y, cb, cr))
        tiles = []
        for k in range(wide * wide):
            residual, base = residuals[level][k], baselines[level][k]
            if residual is not None:
                tiles.append((region(y[0], cb[0], cr[0], k % wide * size, k // wide * size, size, residual), True))
            elif base is not None:
                tiles.append((base, False))
            else:
                raise ValueError(f"tile {k} of level {1 - level} has neither a residual nor a baseline")
        out.append(tiles)
        if level == 0:
            mosaic = np.concatenate([np.concatenate([tiles[r * 2 + c][0] for c in range(2)], 1) for r in range(2)], 0)
            y = split(mosaic[None])[0]
    return out


def rebuild_families(families: DataFrame, side: int, sharpen: float | None = None, in_grey: bool = False) -> DataFrame:
    """(x2, y2, level, x, y, used_residual, px): the 20 tiles of each family, row-major, interleaved colours or luma alone.

    families has (x2, y2, l2, residual_1, residual_0, base_1, base_0): a colour tile, and arrays of 4 and 16 planes of residuals and of colour tiles, null
    where there is none. A family is a row, so families are spread by the scan, and a batch holds few.
    """
    schema = "x2 int, y2 int, level int, x int, y int, used_residual boolean, px array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                given = lambda name, n, shape: [None if v is None else np.array(v).reshape(shape) for v in (row[name] or [None] * n)]  # noqa: E731, B023
                residuals = [given(f"residual_{k}", n, (side, side)) for k, n in ((1, 4), (0, 16))]
                baselines = [given(f"base_{k}", n, (side, side, 3)) for k, n in ((1, 4), (0, 16))]
                levels = rebuild(np.array(row["l2"]).reshape(side, side, 3), residuals, baselines, sharpen)
                rows = [(row["x2"], row["y2"], 1 - k, row["x2"] * w + i % w, row["y2"] * w + i // w, used, (grey(t) if in_grey else t).reshape(-1)) for k, w in ((0, 2), (1, 4)) for i, (t, used) in enumerate(levels[k])]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["x2", "y2", "level", "x", "y", "used_residual", "px"])

    return families.select("x2", "y2", "l2", "residual_1", "residual_0", "base_1", "base_0").mapInArrow(run, schema)


def encode_family(full: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(L2 tile, residuals of L1, of L0) of a family's colours (4 s, 4 s, 3), closed loop: L0 is predicted from the L1 that a decoder rebuilds.

    base stands for L2 where it was coded with loss.
    """
    side = len(full) // 4
    small = [np.floor(np.stack([raster.resample(full[None, ..., c].astype(float), n, n, "lanczos3")[0] for c in range(3)], -1) + 0.5).astype(np.int64) for n in (2 * side, side)]
    l2 = small[1] if base is None else base
    found = []
    y, cb, cr = split(l2[None])
    for level, truth in enumerate((small[0], full)):
        wide = 2 << level
        y, cb, cr = (raster.bilinear(p, 2) for p in (y, cb, cr))
        rest = np.clip(split(truth[None])[0] - y + 128, 0, 255)[0]
        found.append([rest[k // wide * side : (k // wide + 1) * side, k % wide * side : (k % wide + 1) * side] for k in range(wide * wide)])
        if level == 0:
            tiles = [region(y[0], cb[0], cr[0], k % 2 * side, k // 2 * side, side, found[0][k]) for k in range(4)]
            y = split(np.concatenate([np.concatenate(tiles[r * 2 : r * 2 + 2], 1) for r in range(2)], 0)[None])[0]
    return l2, found[0], found[1]
