"""Scalar functions as Column builders. Conventions that differ between uses are separate, named functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The luminance quantisation table of the JPEG standard (Annex K), at quality 50, row by row.
JPEG_LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
EXTENSIONS = {"webp": "webp", "jpegxl": "jxl", "jp2": "jp2"}


def clamp(value: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_away(value: Column) -> Column:
    return F.when(value < 0, -F.floor(-value + 0.5)).otherwise(F.floor(value + 0.5))


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0)


def truncate(value: Column) -> Column:
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))


# The weights of BT.601, and their fixed-point forms.


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 full range, rounded half away from zero and clamped."""
    fit = lambda v: clamp(round_half_away(v)).cast("int")
    return (
        fit(0.299 * r + 0.587 * g + 0.114 * b),
        fit(-0.168736 * r - 0.331264 * g + 0.5 * b + 128.0),
        fit(0.5 * r - 0.418688 * g - 0.081312 * b + 128.0),
    )


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    fit = lambda v: clamp(round_half_away(v)).cast("int")
    u, v = cb - 128.0, cr - 128.0
    return fit(y + 1.402 * v), fit(y - 0.344136 * u - 0.714136 * v), fit(y + 1.772 * u)


def ycbcr_to_rgb_fixed(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """The same in 10-bit fixed point; right shifts floor."""
    u, v = cb - 128, cr - 128
    shift = lambda x: F.shiftright(x.cast("int"), 10)
    return clamp(y + shift(v * 1436)).cast("int"), clamp(y - shift(u * 352 + v * 731)).cast("int"), clamp(y + shift(u * 1815)).cast("int")


def unpremultiply(c: Column, alpha: Column) -> Column:
    """Transparent is white; partial alpha divides, rounded and capped."""
    return F.when(alpha == 0, 255).when(alpha == 255, c).otherwise(F.least(F.lit(255), round_half_away(c * 255.0 / alpha))).cast("int")


def dzi_max_level(width: Column, height: Column) -> Column:
    """ceil(log2(longest side)), by comparison with powers of two, so that no rounding of a logarithm matters; 0 for nothing."""
    side = F.greatest(width, height)
    return F.coalesce(F.when(side <= 1, 0), *[F.when(side <= (1 << k), k) for k in range(1, 32)]).cast("int")


def ceil_div(value: Column, by: int) -> Column:
    return F.floor((value + (by - 1)) / by).cast("bigint")


def psnr(mse: Column, identical: float | None) -> Column:
    """10 log10(255^2 / mse). Where nothing differs: infinity (None), 100 or 999, as the use has it."""
    same = F.lit(float("inf") if identical is None else float(identical))
    return F.when(mse == 0, same).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def jpeg_scale(quality: Column) -> Column:
    q = clamp(quality, 1, 100)
    return F.when(q < 50, 5000.0 / q).otherwise(200.0 - 2 * q)


def jpeg_qtable(quality: Column) -> Column:
    """The 64 quantisers at a quality from 1 to 100, by the usual scaling."""
    scale = jpeg_scale(quality)
    return F.transform(F.array(*[F.lit(v) for v in JPEG_LUMINANCE]), lambda v: clamp(F.floor((v * scale + 50) / 100), 1, 255).cast("int"))


# The numbers of both rate maps.


def jp2_rate_rounded(quality: Column) -> Column:
    """Compression ratio by 105 exp(-0.032 q), to one decimal, at least 1; 1 from quality 100, 100 to quality 1."""
    return F.when(quality >= 100, 1.0).when(quality <= 1, 100.0).otherwise(F.greatest(F.lit(1.0), F.round(105.0 * F.exp(-0.032 * quality), 1)))


def jp2_rate_plain(quality: Column) -> Column:
    """Compression ratio by 500 exp(-0.055 q), at least 1."""
    return F.greatest(F.lit(1.0), 500.0 * F.exp(-0.055 * quality))


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, 100.0 * (1.0 - after / before))


def ratio(before: Column, after: Column) -> Column:
    return F.when(after > 0, before / after)


def sniff_image(data: Column) -> Column:
    """webp, jxl or jpeg by the first bytes; jpeg is the default."""
    start = F.hex(F.substring(data, 1, 12))
    webp = F.startswith(start, F.lit("52494646")) & (F.substring(start, 17, 8) == "57454250")
    jxl = F.startswith(start, F.lit("FF0A")) | F.startswith(start, F.lit("0000000C4A584C20"))
    return F.when(webp, "webp").when(jxl, "jxl").otherwise("jpeg")


def extension(encoder: Column) -> Column:
    out = F.lit("jpg")
    for name, ext in EXTENSIONS.items():
        out = F.when(F.lower(encoder) == name, ext).otherwise(out)
    return out


def little_endian(data: Column, offset: int, size: int) -> Column:
    """An unsigned little-endian number of a binary column, offset counted from 0."""
    return F.conv(F.concat(*[F.hex(F.substring(data, offset + k + 1, 1)) for k in range(size - 1, -1, -1)]), 16, 10).cast("bigint")


def display_normalised(plane: Column) -> Column:
    """Values to 0..255 by the plane's own range; a range under 1e-8 is mid grey."""
    low, high = F.array_min(plane), F.array_max(plane)
    return F.transform(plane, lambda v: F.when(high - low < 1e-8, 128).otherwise(clamp(round_half_away((v - low) / (high - low) * 255))).cast("int"))
