"""Quality metrics: expressions over arrays where that is exact, numpy over batches of planes elsewhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def mse(a: Column, b: Column) -> Column:
    return squared_error(a, b) / F.size(a)


def max_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sparsity(residual: Column) -> Column:
    """The share of residuals under 1."""
    return F.size(F.filter(residual, lambda v: F.abs(v) < 1)) / F.size(residual)


def difference_statistics(a: Column, b: Column, threshold: int = 30) -> dict[str, Column]:
    """Whether planes are equal; greatest and mean difference; how many pixels differ at all, and by more than the threshold, in percent."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    n = F.size(a)
    over = lambda t: F.size(F.filter(diff, lambda v: v > t))
    return {
        "identical": F.array_max(diff) == 0, "max_diff": F.array_max(diff), "mean_diff": F.aggregate(diff, F.lit(0).cast("bigint"), lambda s, v: s + v) / n,
        "n_diff": over(0), "pct_diff": 100.0 * over(0) / n, "pct_significant": 100.0 * over(threshold) / n,
    }


def visual_comparison(a: list[Column], b: list[Column], threshold: int = 30, most_mse: float = 100.0, most_percent: float = 5.0) -> dict[str, Column]:
    """Two images as planes of their channels: mean squared error, greatest summed difference of a pixel, the percentage of pixels over the threshold, and whether
    the first and last are within their bounds."""
    sums = None
    for x, y in zip(a, b, strict=True):
        diff = F.zip_with(x, y, lambda p, q: F.abs(p - q))
        sums = diff if sums is None else F.zip_with(sums, diff, lambda p, q: p + q)
    n = F.size(a[0])
    error = sum((squared_error(x, y) for x, y in zip(a[1:], b[1:], strict=True)), squared_error(a[0], b[0])) / (n * len(a))
    percent = 100.0 * F.size(F.filter(sums, lambda v: v > threshold)) / n
    return {"mse": error, "max_diff": F.array_max(sums), "pct_significant": percent, "passed": (error <= most_mse) & (percent <= most_percent)}


def equivalent_db(before: Column, after: Column) -> Column:
    """The gain in dB of an energy that went down; 0 where it didn't, or where nothing is left."""
    return F.when((after > 0) & (after < before), 10 * F.log10(before / after)).otherwise(0.0)


def gaussian(size: int, sigma: float) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def _windowed(planes: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Separable filter, only where the kernel fits."""
    k = len(kernel)
    wide = np.lib.stride_tricks.sliding_window_view(planes, k, axis=2) @ kernel
    return np.lib.stride_tricks.sliding_window_view(wide, k, axis=1) @ kernel


def _reflected(planes: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    pad = len(kernel) // 2
    return _windowed(np.pad(planes, ((0, 0), (pad, pad), (pad, pad)), mode="symmetric"), kernel)


def ssim(a: np.ndarray, b: np.ndarray, window: str = "uniform", span: float = 255.0) -> np.ndarray:
    """Mean structural similarity of each pair. uniform: 7 by 7, sample covariances; gaussian: 11 by 11 of deviation 1.5, or as large as fits."""
    side = min(a.shape[1:])
    if window == "uniform":
        kernel = np.full(min(7, side - (side + 1) % 2), 1.0)
        kernel /= len(kernel)
        unbiased = len(kernel) ** 2 / (len(kernel) ** 2 - 1)
    else:
        kernel, unbiased = gaussian(min(11, side - (side + 1) % 2), 1.5), 1.0
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = _windowed(a, kernel), _windowed(b, kernel)
    va, vb, cov = (unbiased * (_windowed(x * y, kernel) - p * q) for x, y, p, q in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean((1, 2))


#: The weights of the five scales.
SCALE_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def multiscale_ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weighted product over scales, halved by a 1-4-6-4-1 blur; scales too small for a window are left out, and the weights made to sum to 1."""
    found, smooth = [], np.array([1, 4, 6, 4, 1]) / 16
    for _ in SCALE_WEIGHTS:
        if min(a.shape[1:]) < 7:
            break
        found.append(np.clip(ssim(a, b, "gaussian"), 1e-6, None))
        a, b = _reflected(a, smooth)[:, ::2, ::2], _reflected(b, smooth)[:, ::2, ::2]
    weight = np.array(SCALE_WEIGHTS[: len(found)])
    return np.exp((np.log(np.stack(found)) * (weight / weight.sum())[:, None]).sum(0))


def visual_information_fidelity(a: np.ndarray, b: np.ndarray, deviation: float = 1.5, noise: float = 2.0) -> np.ndarray:
    """Pixel-domain fidelity over Gaussian neighbourhoods; where the reference is flat nothing is transmitted."""
    tiny = 1e-10
    kernel = gaussian(2 * int(4 * deviation + 0.5) + 1, deviation)
    ma, mb = _reflected(a, kernel), _reflected(b, kernel)
    va, vb = np.maximum(_reflected(a * a, kernel) - ma**2, 0), np.maximum(_reflected(b * b, kernel) - mb**2, 0)
    cov = _reflected(a * b, kernel) - ma * mb
    gain = cov / (va + tiny)
    rest = vb - gain * cov
    flat_a, flat_b = va < tiny, vb < tiny
    gain[flat_a | flat_b] = 0
    rest[flat_a] = 0
    got = np.log10(1 + gain**2 * va / (rest + noise)).sum((1, 2))
    all_ = np.log10(1 + va / noise).sum((1, 2))
    return np.divide(got, all_, out=np.zeros(len(a)), where=all_ != 0)


# The sRGB curve, the matrix to XYZ, the D65 white and the thresholds of L*a*b*; the constants of CIEDE2000.


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    """sRGB of 0..1 to CIE L*a*b*, D65."""
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T
    f = xyz / np.array([0.95047, 1.0, 1.08883])
    f = np.where(f > 0.008856, np.cbrt(f), 7.787 * f + 16 / 116)
    return np.stack((116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])), -1)


def delta_e76(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.sqrt(((one - two) ** 2).sum(-1))


def delta_e2000(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The CIEDE2000 difference (Sharma, Wu and Dalal 2005), with unit weights."""
    l1, a1, b1 = np.moveaxis(one, -1, 0)
    l2, a2, b2 = np.moveaxis(two, -1, 0)
    c7 = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    g = 1.5 - 0.5 * np.sqrt(c7 / (c7 + 25.0**7))
    p1, p2 = a1 * g, a2 * g
    c1, c2 = np.hypot(p1, b1), np.hypot(p2, b2)
    h1, h2 = np.arctan2(b1, p1) % (2 * np.pi), np.arctan2(b2, p2) % (2 * np.pi)
    grey = c1 * c2 == 0
    dh = np.where(grey, 0, (h2 - h1 + np.pi) % (2 * np.pi) - np.pi)
    turn = 2 * np.sqrt(c1 * c2) * np.sin(dh / 2)
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    hm = np.where(grey, h1 + h2, (h1 + dh / 2) % (2 * np.pi))
    deg = np.degrees(hm)
    t = 1 - 0.17 * np.cos(hm - np.radians(30)) + 0.24 * np.cos(2 * hm) + 0.32 * np.cos(3 * hm + np.radians(6)) - 0.20 * np.cos(4 * hm - np.radians(63))
    sl, sc, sh = 1 + 0.015 * (lm - 50) ** 2 / np.sqrt(20 + (lm - 50) ** 2), 1 + 0.045 * cm, 1 + 0.015 * cm * t
    rt = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60) * np.exp(-(((deg - 275) / 25) ** 2)))
    x, y, z = (l2 - l1) / sl, (c2 - c1) / sc, turn / sh
    return np.sqrt(np.maximum(x * x + y * y + z * z + rt * y * z, 0))


def pchip_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone cubic through points (Fritsch and Butland 1984): weighted harmonic means inside, three-point ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    m = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (w1 + w2) / (w1 / d[:-1] + w2 / d[1:])
    m[1:-1] = np.where(d[:-1] * d[1:] > 0, mean, 0)
    for at, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[at] = 0 if s * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(s) > abs(3 * d0) else s
    return m


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    m = pchip_slopes(x, y)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t = (at - x[k]) / h
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + h * m[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + h * m[k + 1] * t * t * (t - 1)


def mean_gap(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, samples: int = 1000) -> float:
    """The mean of curve 1 minus curve 0 over the x range that both have, by trapezoids. Equal x count once; curves need four points."""
    if min(len(x0), len(x1)) < 4:
        raise ValueError("a curve needs four points")
    low, high = max(x0.min(), x1.min()), min(x0.max(), x1.max())
    if low >= high:
        raise ValueError("the curves don't overlap")
    at = np.linspace(low, high, samples)
    area = []
    for x, y in ((x0, y0), (x1, y1)):
        xs, first = np.unique(x, return_index=True)
        area.append(np.trapezoid(pchip(xs, y[first], at), at))
    return (area[1] - area[0]) / (high - low)


def bd_rate(rate0, psnr0, rate1, psnr1) -> float:
    """The rate that curve 1 needs more than curve 0 at equal quality, in percent."""
    rate0, psnr0, rate1, psnr1 = (np.asarray(v, float) for v in (rate0, psnr0, rate1, psnr1))
    return (10 ** mean_gap(psnr0, np.log10(rate0), psnr1, np.log10(rate1)) - 1) * 100


def bd_psnr(rate0, psnr0, rate1, psnr1) -> float:
    rate0, psnr0, rate1, psnr1 = (np.asarray(v, float) for v in (rate0, psnr0, rate1, psnr1))
    return mean_gap(np.log10(rate0), psnr0, np.log10(rate1), psnr1)
