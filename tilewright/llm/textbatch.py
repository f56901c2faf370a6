"""Arrow string batches as numpy arrays: word spans, 64-bit word hashes and k-word windows, without a Python loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D; those are single bytes in UTF-8, so bytes and code points agree on the spans.
Hashes are polynomials modulo 2^64 with an odd multiplier, mixed afterwards; two different words of a batch collide with a chance of about 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

CHUNK_BYTES = (1 << 20) - 1
#: Longer texts are worked through in pieces of this size, so that what is held for each byte is bounded; what is held for each word isn't.
PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for lo in range(0, len(x), PIECE):
        part = x[lo : lo + PIECE]
        part ^= part >> np.uint64(30)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(27)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `most` bytes; a longer text is a run of its own."""
    data, at = raw(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    release_memory()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # other C libraries
    _trim = None


def release_memory() -> None:
    """Give freed memory back to the system: Spark keeps idle Python workers, and with them all that their allocators hold."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words:
    """The words of a run of texts.

    starts, ends: byte spans; bounds: words before each text, so text d has words bounds[d]:bounds[d + 1].
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n_texts = data, at, len(at) - 1
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = at[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.bounds)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A mixed 64-bit hash of each word's bytes."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        out = np.zeros(self.n_texts, np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            out[some] = np.add.reduceat(mask.view(np.uint8), self.at[:-1][some], dtype=np.int64)
        return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > PIECE:
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
            first, last = starts[lo], ends[hi - 1]
            out[lo:hi] = span_hashes(data[first:last], starts[lo:hi] - first, ends[lo:hi] - first) if last - first <= PIECE else _long_hash(data[first:last])
            lo = hi
        return out
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long_hash(data: np.ndarray) -> np.ndarray:
    """The hash of one long span."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), PIECE):
            part = data[lo : lo + PIECE].astype(np.uint64) + np.uint64(1)
            total += (part * _power_tables(len(part))[0][: len(part)]).sum(dtype=np.uint64) * np.uint64(pow(_BASE, lo, 1 << 64))
        return mix(np.array([total + np.uint64(len(data)) * np.uint64(0xD6E8FEB86659FD93)], np.uint64))


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each k-word window that lies in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    inside = np.ones(len(hashes), bool)
    for j in range(1, k):  # the last k - 1 words of each text begin no window
        at = bounds[1:] - j
        inside[at[at >= bounds[:-1]]] = False
    first = np.flatnonzero(inside)
    return mix(total[first]), first


def repeats(keys: np.ndarray) -> np.ndarray:
    """True for each element that occurs twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each line: texts cut at \\n."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate((at[:-1], breaks + 1))
    text = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1))
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    final = np.concatenate((text[1:] != text[:-1], [True])) if len(text) else np.zeros(0, bool)
    ends[final] = at[text[final] + 1]
    return starts, ends, text
