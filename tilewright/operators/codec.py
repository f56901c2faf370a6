"""Residual codecs and containers of families: bytes in, bytes out, and the same over Arrow batches.

Fixed values are those of the formats: magic words, header and index sizes, and the order of their fields (little-endian).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from tilewright.operators import raster

PACK_HEAD = struct.Struct("<4sHHIIII")
PACK_ENTRY = struct.Struct("<BBHIII")
PACK_MAGIC = (b"ORIG", b"RRIP")
BUNDLE_HEAD = struct.Struct("<4sHHHIQ10x")
BUNDLE_ENTRY = struct.Struct("<QI")
BUNDLE_MAGIC = b"ORIB"
FIELD_HEAD = struct.Struct("<HHf")
SPARSE_HEAD = struct.Struct("<HHeI")

_lz4 = pa.Codec("lz4_raw")


def lz4_pack(data: bytes) -> bytes:
    """An LZ4 block after its plain size."""
    return len(data).to_bytes(4, "little") + (_lz4.compress(data, asbytes=True) if data else b"\x00")


def lz4_unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:4], "little")
    return _lz4.decompress(data[4:], size, asbytes=True) if size else b""


def encode_pack(entries: Iterable[tuple[int, int, bytes]], compress: bool = True) -> bytes:
    """(level kind, index in parent, blob) entries of a family, in their order, as a pack."""
    entries = list(entries)
    start = PACK_HEAD.size + PACK_ENTRY.size * len(entries)
    index, at = [], 0
    for kind, idx, blob in entries:
        index.append(PACK_ENTRY.pack(kind, idx, 0, at, len(blob), 0))
        at += len(blob)
    data = b"".join([PACK_HEAD.pack(PACK_MAGIC[0], 1, 0, len(entries), PACK_HEAD.size, start, 0), *index, *[blob for *_, blob in entries]])
    return lz4_pack(data) if compress else data


def decode_pack(data: bytes, compressed: bool = True) -> list[tuple[int, int, int, int, bytes]]:
    """(level kind, index in parent, offset, length, blob) of a pack's entries. Bytes 6 to 8 are ignored: writers differ there."""
    if compressed:
        data = lz4_unpack(data)
    if len(data) < PACK_HEAD.size:
        raise ValueError("pack too small")
    magic, version, _, n, index_at, data_at, _ = PACK_HEAD.unpack_from(data)
    if magic not in PACK_MAGIC:
        raise ValueError("not a pack")
    if version != 1:
        raise ValueError(f"pack version {version}")
    out = []
    for kind, idx, _, at, length, _ in PACK_ENTRY.iter_unpack(data[index_at : index_at + n * PACK_ENTRY.size]):
        out.append((kind, idx, at, length, data[data_at + at : data_at + at + length]))
    return out


def pack_lookup(data: bytes, kind: int, idx: int) -> bytes | None:
    return next((blob for k, i, _, _, blob in decode_pack(data) if (k, i) == (kind, idx)), None)


def encode_bundle(cols: int, rows: int, families: Iterable[tuple[int, int, bytes]]) -> bytes:
    """A grid of packs in one file; families that are missing have length 0 in the row-major index."""
    index = [(0, 0)] * (cols * rows)
    parts, at = [], BUNDLE_HEAD.size
    for col, row, blob in families:
        index[row * cols + col] = (at, len(blob))
        parts.append(blob)
        at += len(blob)
    return b"".join([BUNDLE_HEAD.pack(BUNDLE_MAGIC, 1, cols, rows, cols * rows, at), *parts, *[BUNDLE_ENTRY.pack(*e) for e in index]])


def bundle_index(data: bytes) -> list[tuple[int, int, int, int]]:
    """(col, row, offset, length) of the families that a bundle has."""
    magic, version, cols, _, n, at = BUNDLE_HEAD.unpack_from(data)
    if magic != BUNDLE_MAGIC or version != 1:
        raise ValueError("not a bundle")
    entries = BUNDLE_ENTRY.iter_unpack(data[at : at + n * BUNDLE_ENTRY.size])
    return [(k % cols, k // cols, offset, length) for k, (offset, length) in enumerate(entries) if length]


def bundle_read(data: bytes, col: int, row: int) -> bytes:
    _, _, cols, rows, _, at = BUNDLE_HEAD.unpack_from(data)
    if not (0 <= col < cols and 0 <= row < rows):
        raise IndexError("outside the grid")
    offset, length = BUNDLE_ENTRY.unpack_from(data, at + (row * cols + col) * BUNDLE_ENTRY.size)
    if not length:
        raise KeyError("empty family")
    return data[offset : offset + length]


def deadzone_encode(residual: np.ndarray, step: float, wide: bool = False) -> bytes:
    """Quantised by step, half to even, into 8-bit numbers that wrap (wide: 16-bit), deflated after height, width and step."""
    levels = np.round(residual / step).astype(np.int64).astype(np.int16 if wide else np.int8)
    return zlib.compress(FIELD_HEAD.pack(*residual.shape, step) + levels.astype(levels.dtype.newbyteorder("<")).tobytes(), 9)


def deadzone_decode(data: bytes, wide: bool = False) -> np.ndarray:
    plain = zlib.decompress(data)
    h, w, step = FIELD_HEAD.unpack_from(plain)
    return np.frombuffer(plain, "<i2" if wide else np.int8, offset=FIELD_HEAD.size).reshape(h, w).astype(np.float32) * np.float32(step)


def delta_encode(residual: np.ndarray, step: float) -> bytes:
    """Differences from the pixel above, but in the first row and column, quantised as deadzone does."""
    change = residual.astype(float).copy()
    change[1:, 1:] -= residual[:-1, 1:]
    return deadzone_encode(change, step)


def delta_decode(data: bytes) -> np.ndarray:
    change = deadzone_decode(data)
    out = change.copy()
    out[:, 1:] = np.cumsum(change[:, 1:], axis=0)
    return out


def sparse_encode(residual: np.ndarray, threshold: float, bits: int = 5) -> bytes:
    """Only pixels over the threshold: place and value, in units of the greatest of them. Places are 16-bit numbers, so planes have at most 65,536 pixels."""
    if residual.size > 1 << 16:
        raise ValueError(f"{residual.size} pixels: a sparse plane has at most 65536")
    place = np.flatnonzero(np.abs(residual) > threshold)
    values = residual.reshape(-1)[place]
    most = max(np.abs(values).max(initial=0), 1)
    levels = np.round(values / most * (1 << (bits - 1))).astype(np.int8)
    body = np.zeros(len(place), [("p", "<u2"), ("v", "i1")])
    body["p"], body["v"] = place, levels
    return zlib.compress(SPARSE_HEAD.pack(*residual.shape, most, len(place)) + body.tobytes(), 9)


def sparse_decode(data: bytes, bits: int = 5) -> np.ndarray:
    plain = zlib.decompress(data)
    h, w, most, n = SPARSE_HEAD.unpack_from(plain)
    body = np.frombuffer(plain, [("p", "<u2"), ("v", "i1")], count=n, offset=SPARSE_HEAD.size)
    out = np.zeros(h * w, np.float32)
    out[body["p"]] = body["v"].astype(np.float32) / (1 << (bits - 1)) * most
    return out.reshape(h, w)


def precompensated(residual: np.ndarray, step: float, scale: float = 1.0, rounds: int = 0) -> tuple[np.ndarray, int]:
    """(what a decoder makes of a residual, bytes) when it is coded scaled, and scaled back; or after rounds of adding what coding lost."""
    code = lambda r: deadzone_encode(np.clip(np.round(r + 128), 0, 255) - 128, step)
    now = residual * scale
    for _ in range(rounds):
        now = residual + (residual - deadzone_decode(code(now)))
    data = code(now)
    return deadzone_decode(data) / scale, len(data)


EDGE_STEP = 2.0


def edge_mask(base: np.ndarray, shape: tuple[int, int], threshold: float = 1.0) -> np.ndarray:
    """Where the base plane, which the decoder has, is steep: Sobel magnitudes, resized, over the threshold times their mean."""
    wide = np.pad(base.astype(float), 1, mode="symmetric")
    smooth, slope = np.array([1, 2, 1]), np.array([-1, 0, 1])
    both = []
    for down, across in ((smooth, slope), (slope, smooth)):
        rows = sum(k * wide[i : i + base.shape[0]] for i, k in enumerate(down))
        both.append(sum(k * rows[:, i : i + base.shape[1]] for i, k in enumerate(across)))
    steep = np.hypot(*both)
    return raster.resample(steep[None], shape[1], shape[0], "triangle", None)[0] > steep.mean() * threshold


def edge_encode(residual: np.ndarray, base: np.ndarray, threshold: float = 1.0) -> bytes:
    """Only pixels where the base is steep, quantised by EDGE_STEP; the mask as bits, then the values at its places, deflated."""
    mask = edge_mask(base, residual.shape, threshold)
    bits = np.packbits(mask.ravel()).tobytes()
    levels = np.round(residual / EDGE_STEP).astype(np.int64).astype(np.int8)[mask]
    return zlib.compress(FIELD_HEAD.pack(*residual.shape, EDGE_STEP) + struct.pack("<I", len(bits)) + bits + levels.tobytes(), 9)


def edge_decode(data: bytes) -> np.ndarray:
    plain = zlib.decompress(data)
    h, w, step = FIELD_HEAD.unpack_from(plain)
    (size,) = struct.unpack_from("<I", plain, FIELD_HEAD.size)
    start = FIELD_HEAD.size + 4
    mask = np.unpackbits(np.frombuffer(plain, np.uint8, size, start))[: h * w].astype(bool)
    out = np.zeros(h * w, np.float32)
    out[mask] = np.frombuffer(plain, np.int8, offset=start + size).astype(np.float32) * np.float32(step)
    return out.reshape(h, w)


CODECS = {"deadzone": (deadzone_encode, deadzone_decode), "delta": (delta_encode, delta_decode)}
ALIASES = {"zlib": "deadzone", "raw": "deadzone"}


def codec(name: str):
    """(encode, decode) by name; image codecs aren't built in, and are refused like unknown ones."""
    found = CODECS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown encoder: {name}")
    return found
