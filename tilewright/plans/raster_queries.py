"""Queries over planes: resampling, residuals, colour, metrics, fits, codecs and containers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import aggregates as agg
from tilewright.operators import codec, colour, families, fits, joins, metrics, raster, tiles
from tilewright.plans import bind
from tilewright.plans.bind import PLANES_SQL, SIDE
from tilewright.plans.registry import Tables, query

N = SIDE


def _text(plane: Column) -> Column:
    return F.array_join(plane, ",")


def _pairs(t: Tables) -> DataFrame:
    """(vec_id, px, pred): each plane and its prediction, the plane's own halved and doubled again."""
    small = raster.downsample_box(F.col("px"), N, N)
    return bind.planes(t).withColumn("pred", raster.upsample_nearest(small, N // 2, N // 2, 2))


_SMALL = "list_transform(range(0, 16), lambda i: (px[2 * (i % 4) + 16 * (i // 4) + 1] + px[2 * (i % 4) + 16 * (i // 4) + 2] + px[2 * (i % 4) + 16 * (i // 4) + 9] + px[2 * (i % 4) + 16 * (i // 4) + 10] + 2) // 4)"
_PAIRS = f"{PLANES_SQL}, small AS (SELECT *, {_SMALL} AS s FROM planes), pairs AS (SELECT vec_id, label, px, list_transform(range(0, 64), lambda i: s[(i // 16) * 4 + (i % 8) // 2 + 1]) AS pred FROM small)"


@query(f"WITH {PLANES_SQL}, u AS (SELECT vec_id, unnest(px) AS v FROM planes) SELECT vec_id, min(v) AS px_min, max(v) AS px_max, round(avg(v), 9) AS px_mean, round(stddev_pop(v), 6) AS px_std FROM u GROUP BY vec_id")
def plane_stats(t: Tables) -> DataFrame:
    found = agg.array_statistics(F.col("px"))
    return bind.planes(t).select("vec_id", found["px_min"].alias("px_min"), found["px_max"].alias("px_max"), F.round(found["px_mean"], 9).alias("px_mean"), F.round(found["px_std"], 6).alias("px_std"))


@query(f"WITH {PLANES_SQL} SELECT vec_id, array_to_string({_SMALL}, ',') AS px FROM planes")
def plane_box_downsample(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(raster.downsample_box(F.col("px"), N, N)).alias("px"))


def _bilinear_sql(scale: int) -> str:
    n = N * scale
    step, back = 256 // scale, 128 - 128 // scale
    place = lambda v: f"greatest(0, least({(N - 1) * 256}, ({v}) * {step} - {back}))"
    return f"""WITH {PLANES_SQL}, taps AS (SELECT i, {place(f'i // {n}')} AS fy, {place(f'i % {n}')} AS fx FROM range(0, {n * n}) r(i)),
    t AS (SELECT i, fy // 256 AS y0, least(fy // 256 + 1, {N - 1}) AS y1, fy % 256 AS wy, fx // 256 AS x0, least(fx // 256 + 1, {N - 1}) AS x1, fx % 256 AS wx FROM taps),
    v AS (SELECT vec_id, i, (px[y0 * {N} + x0 + 1] * (256 - wx) * (256 - wy) + px[y0 * {N} + x1 + 1] * wx * (256 - wy) + px[y1 * {N} + x0 + 1] * (256 - wx) * wy + px[y1 * {N} + x1 + 1] * wx * wy) // 65536 AS v FROM planes, t)
    SELECT vec_id, string_agg(v, ',' ORDER BY i) AS px FROM v GROUP BY vec_id"""


@query(_bilinear_sql(2))
def plane_bilinear_2x(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(raster.upsample_bilinear(F.col("px"), N, N, 2)).alias("px"))


@query(_bilinear_sql(4))
def plane_bilinear_4x(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(raster.upsample_bilinear(F.col("px"), N, N, 4)).alias("px"))


@query(f"WITH {PLANES_SQL} SELECT vec_id, array_to_string(list_transform(range(0, 256), lambda i: px[(i // 32) * 8 + (i % 16) // 2 + 1]), ',') AS px FROM planes")
def plane_nearest_2x(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(raster.upsample_nearest(F.col("px"), N, N, 2)).alias("px"))


@query(f"WITH {PLANES_SQL} SELECT vec_id, array_to_string(list_transform(range(0, 9), lambda i: CASE WHEN 6 + i % 3 < 8 AND 6 + i // 3 < 8 THEN px[(6 + i // 3) * 8 + 6 + i % 3 + 1] ELSE 0 END), ',') AS px FROM planes")
def tile_extract(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(raster.extract_tile(F.col("px"), N, N, 2, 2, 3)).alias("px"))


@query(f"""WITH {PLANES_SQL}, f AS (SELECT vec_id >> 2 AS parent, (vec_id & 3)::INTEGER AS idx, px FROM planes), p AS (SELECT DISTINCT parent FROM f)
SELECT p.parent, string_agg(coalesce(f.px[((i // 16) % 8) * 8 + i % 8 + 1], 0), ',' ORDER BY i) AS px FROM p CROSS JOIN range(0, 256) r(i) LEFT JOIN f ON f.parent = p.parent AND f.idx = (i // 128) * 2 + (i % 16) // 8 GROUP BY p.parent""")
def family_mosaic(t: Tables) -> DataFrame:
    own = bind.planes(t).select(F.shiftright("vec_id", 2).alias("parent"), (F.col("vec_id") % 4).cast("int").alias("idx"), "px")
    placed = F.array(*[F.max_by("px", F.when(F.col("idx") == k, 1)) for k in range(4)])
    return own.groupBy("parent").agg(placed.alias("tiles")).select("parent", _text(raster.mosaic(F.col("tiles"), N, 2)).alias("px"))


@query(f"""WITH {_PAIRS}, r AS (SELECT vec_id, px, pred, list_transform(range(1, 65), lambda i: greatest(0, least(255, px[i] - pred[i] + 128))) AS res FROM pairs)
SELECT vec_id, array_to_string(res, ',') AS residual, array_to_string(list_transform(range(1, 65), lambda i: greatest(0, least(255, pred[i] + res[i] - 128))), ',') AS back FROM r""")
def residual_roundtrip(t: Tables) -> DataFrame:
    centred = raster.residual_centred(raster.residual_raw(F.col("px"), F.col("pred")))
    return _pairs(t).select("vec_id", "pred", centred.alias("res")).select("vec_id", _text(F.col("res")).alias("residual"), _text(raster.apply_residual(F.col("pred"), F.col("res"))).alias("back"))


@query(f"""WITH {_PAIRS}, u AS (SELECT vec_id, unnest(px) - unnest(pred) AS d FROM pairs), m AS (SELECT vec_id, sum(d * d) / 64 AS mse, max(abs(d)) AS most, count(*) FILTER (abs(d) < 1) / 64 AS sparse FROM u GROUP BY vec_id)
SELECT vec_id, round(mse, 9) AS mse, most AS max_err, round(CASE WHEN mse = 0 THEN 100 ELSE 10 * log10(65025 / mse) END, 6) AS psnr_100, round(CASE WHEN mse = 0 THEN 999 ELSE 10 * log10(65025 / mse) END, 6) AS psnr_999, sparse AS sparsity FROM m""")
def residual_mse_psnr(t: Tables) -> DataFrame:
    a, b = F.col("px"), F.col("pred")
    out = _pairs(t).select("vec_id", metrics.mse(a, b).alias("mse"), metrics.max_error(a, b).alias("max_err"), metrics.sparsity(raster.residual_raw(a, b)).alias("sparsity"))
    m = F.col("mse")
    return out.select("vec_id", F.round(m, 9).alias("mse"), "max_err", F.round(scalar.psnr(m, 100), 6).alias("psnr_100"), F.round(scalar.psnr(m, 999), 6).alias("psnr_999"), "sparsity")


@query(f"""WITH {_PAIRS}, u AS (SELECT vec_id, abs(unnest(px) - unnest(pred)) AS d FROM pairs)
SELECT vec_id, max(d) = 0 AS identical, max(d) AS max_diff, round(avg(d), 9) AS mean_diff, count(*) FILTER (d > 0)::INTEGER AS n_diff, round(100.0 * count(*) FILTER (d > 0) / 64, 6)::DOUBLE AS pct_diff, round(100.0 * count(*) FILTER (d > 30) / 64, 6)::DOUBLE AS pct_significant FROM u GROUP BY vec_id""")
def pixel_diff_stats(t: Tables) -> DataFrame:
    found = metrics.difference_statistics(F.col("px"), F.col("pred"))
    rounded = {"mean_diff": 9, "pct_diff": 6, "pct_significant": 6}
    return _pairs(t).select("vec_id", *[(F.round(c, rounded[n]) if n in rounded else c).alias(n) for n, c in found.items()])


@query(f"""WITH {PLANES_SQL}, near AS (SELECT i, dx, dy, greatest(0, least(7, i // 8 + dy)) * 8 + greatest(0, least(7, i % 8 + dx)) + 1 AS spot, (2 - abs(dx)) * (2 - abs(dy)) AS k FROM range(0, 64) r(i), range(-1, 2) a(dx), range(-1, 2) b(dy)),
s AS (SELECT vec_id, i, any_value(px[i + 1]) AS own, sum(px[spot] * k)::BIGINT AS blur FROM planes, near GROUP BY vec_id, i)
SELECT vec_id, string_agg(greatest(0, least(255, (own * 4096 + 128 * (own * 16 - blur) + 2048) >> 12)), ',' ORDER BY i) AS px FROM s GROUP BY vec_id""")
def plane_unsharp(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(raster.unsharp(F.col("px"), N, N, 0.5)).alias("px"))


@query(f"""WITH {PLANES_SQL}, c AS (SELECT vec_id, i, px[i]::DOUBLE AS r, px[i + 1]::DOUBLE AS g, px[i + 2]::DOUBLE AS b FROM planes, range(1, 63) t(i)),
y AS (SELECT *, greatest(0, least(255, floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)))::INTEGER AS y, greatest(0, least(255, floor(-0.168736 * r - 0.331264 * g + 0.5 * b + 128.0 + 0.5)))::INTEGER AS cb, greatest(0, least(255, floor(0.5 * r - 0.418688 * g - 0.081312 * b + 128.0 + 0.5)))::INTEGER AS cr FROM c),
f AS (SELECT *, greatest(0, least(255, y + (((cr - 128) * 1436) >> 10)))::INTEGER AS r2, greatest(0, least(255, y - (((cb - 128) * 352 + (cr - 128) * 731) >> 10)))::INTEGER AS g2, greatest(0, least(255, y + (((cb - 128) * 1815) >> 10)))::INTEGER AS b2 FROM y)
SELECT vec_id, i::INTEGER AS i, y, cb, cr, r2, g2, b2 FROM f""")
def ycbcr_roundtrip(t: Tables) -> DataFrame:
    at = lambda k: F.element_at("px", F.col("i") + k).cast("double")
    rows = bind.planes(t).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(62))))
    y, cb, cr = scalar.rgb_to_ycbcr(at(0), at(1), at(2))
    coded = rows.select("vec_id", "i", y.alias("y"), cb.alias("cb"), cr.alias("cr"))
    r, g, b = scalar.ycbcr_to_rgb_fixed(F.col("y"), F.col("cb"), F.col("cr"))
    return coded.select("vec_id", "i", "y", "cb", "cr", r.alias("r2"), g.alias("g2"), b.alias("b2"))


@query(f"""WITH {PLANES_SQL}, r AS (SELECT vec_id, y, count(*) FILTER (px[y * 8 + x + 1] < 118) AS n FROM planes, range(0, 8) a(y), range(0, 8) b(x) GROUP BY vec_id, y)
SELECT vec_id, count(*) FILTER (n > 0.5 * 8)::INTEGER AS dark, count(*) FILTER (n > 0.5 * 8) > 2 AS banded FROM r GROUP BY vec_id""")
def dark_bands(t: Tables) -> DataFrame:
    n = raster.dark_rows(F.col("px"), N, N, level=118, share=0.5)
    return bind.planes(t).select("vec_id", n.alias("dark"), (n > 2).alias("banded"))


@query(f"""WITH {PLANES_SQL}, m AS (SELECT vec_id, px, list_min(px) AS a, list_max(px) AS b FROM planes) SELECT vec_id, array_to_string(list_transform(px, lambda v: CASE WHEN b - a < 1e-8 THEN 128 ELSE floor((v - a) / (b - a) * 255 + 0.5)::INTEGER END), ',') AS px FROM m""")
def display_normalise(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", _text(scalar.display_normalised(F.col("px"))).alias("px"))


_PIXELS = f"{_PAIRS}, u AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px) - unnest(pred) AS r, unnest(pred) AS p FROM pairs), b AS (SELECT *, ((i % 8) // 4)::INTEGER AS bx, (i // 32)::INTEGER AS \"by\" FROM u)"


def _pixels(t: Tables) -> DataFrame:
    return fits.pixels(_pairs(t), ["vec_id"], N, 4, r=raster.residual_raw(F.col("px"), F.col("pred")), p=F.col("pred"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(avg(r), 6) AS bias, round(sum(r * r) - sum(r) * sum(r) / count(*), 4) AS rest FROM b GROUP BY vec_id")
def tile_bias(t: Tables) -> DataFrame:
    return fits.bias(_pixels(t), ["vec_id"], "r")


@query(f"WITH {_PIXELS} SELECT vec_id, bx, \"by\", round(avg(r), 6) AS bias, round(sum(r * r) - sum(r) * sum(r) / count(*), 4) AS rest FROM b GROUP BY vec_id, bx, \"by\"")
def block_bias(t: Tables) -> DataFrame:
    return fits.bias(_pixels(t), ["vec_id", "bx", "by"], "r")


_AFFINE = "round(CASE WHEN d = 0 THEN 0 ELSE j / d END, 6)::DOUBLE AS slope, round((sy - CASE WHEN d = 0 THEN 0 ELSE j / d END * sx) / n, 6)::DOUBLE AS intercept"
_SUMS = "count(*) AS n, sum(p) AS sx, sum(r) AS sy, count(*) * sum(p * p) - sum(p) * sum(p) AS d, (count(*) * sum(p * r) - sum(p) * sum(r))::DOUBLE AS j"


@query(f"WITH {_PIXELS}, s AS (SELECT vec_id, {_SUMS} FROM b GROUP BY vec_id) SELECT vec_id, {_AFFINE} FROM s")
def tile_affine(t: Tables) -> DataFrame:
    return fits.affine(_pixels(t), ["vec_id"], "r", "p")


@query(f"WITH {_PIXELS}, s AS (SELECT vec_id, bx, \"by\", {_SUMS} FROM b GROUP BY vec_id, bx, \"by\") SELECT vec_id, bx, \"by\", {_AFFINE} FROM s")
def block_affine(t: Tables) -> DataFrame:
    return fits.affine(_pixels(t), ["vec_id", "bx", "by"], "r", "p")


@query(f"""WITH {PLANES_SQL}, lv AS (SELECT 3 AS level, vec_id, px FROM planes) SELECT level, count(*) AS tiles, count(DISTINCT vec_id >> 2) AS parents, count(DISTINCT vec_id >> 4) AS families FROM lv GROUP BY level""")
def family_counts(t: Tables) -> DataFrame:
    own = bind.planes(t).select(F.lit(3).alias("level"), "vec_id")
    return own.groupBy("level").agg(F.count("*").alias("tiles"), F.count_distinct(F.shiftright("vec_id", 2)).alias("parents"), F.count_distinct(F.shiftright("vec_id", 4)).alias("families"))


def _numbers_sql(name: str, matrix: np.ndarray) -> str:
    """A table (a, i, w) of a matrix's numbers."""
    return f"{name}(a, i, w) AS (VALUES " + ", ".join(f"({a}, {i}, {float(matrix[a, i])!r}::DOUBLE)" for a in range(matrix.shape[0]) for i in range(matrix.shape[1])) + ")"


# --- numpy operators and containers: where SQL can't say them, tests hold them against plain loops ---


def _numbers(df: DataFrame, columns: list[str], f, out: str) -> DataFrame:
    """vec_id and doubles that f gives for a batch's planes (n, 8, 8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [batch.column(k + 1).flatten().to_numpy().astype(float).reshape(-1, N, N) for k in range(len(columns))]
            yield pa.record_batch([batch.column(0), *[pa.array(np.asarray(v, float)) for v in f(*planes)]], names=["vec_id", *out.split()])

    return df.select("vec_id", *columns).mapInArrow(run, "vec_id bigint, " + ", ".join(f"{c} double" for c in out.split()))


@query()
def structural_similarity(t: Tables) -> DataFrame:
    return _numbers(_pairs(t), ["px", "pred"], lambda a, b: (metrics.ssim(a, b), metrics.ssim(a, b, "gaussian"), metrics.multiscale_ssim(a, b), metrics.visual_information_fidelity(a, b)), "ssim ssim_gaussian ms_ssim vif")


def _lab(planes: np.ndarray) -> np.ndarray:
    """Three neighbouring pixels as a colour."""
    rgb = np.stack((planes, np.roll(planes, 1, 2), np.roll(planes, 2, 2)), -1)
    return metrics.rgb_to_lab(rgb / 255)


@query()
def colour_difference(t: Tables) -> DataFrame:
    def both(a, b):
        x, y = _lab(a), _lab(b)
        e = metrics.delta_e2000(x, y).reshape(len(a), -1)
        return metrics.delta_e76(x, y).mean((1, 2)), e.mean(1), np.median(e, 1), np.percentile(e, 95, 1), np.percentile(e, 99, 1), e.max(1)

    return _numbers(_pairs(t), ["px", "pred"], both, "de76 de2000 de_median de_p95 de_p99 de_max")


@query()
def optimised_bases(t: Tables) -> DataFrame:
    """Squared prediction error of each plane from its halved base, before and after optimising the base."""

    def both(px, pred):
        base = pred[:, ::2, ::2]
        error = lambda b: ((px - np.floor(raster.upsample_float(b))) ** 2).sum((1, 2))
        return error(base), error(raster.optimised_base(base, px)), error(base) - error(raster.optimised_chroma(base, px))

    return _numbers(_pairs(t), ["px", "pred"], both, "before after chroma_gain")


def _spectra_sql() -> str:
    d, l, g = raster.dct_matrix(N), raster.kernel_matrix(N, 4, 3.0, raster.lanczos3), raster.kernel_matrix(N, 16, 1.0, raster.triangle)
    resized = lambda k, out, n: f"""{out}_r AS (SELECT vec_id, k.a AS y, p.i % 8 AS x, sum(p.v * k.w) AS v FROM p JOIN {k} k ON k.i = p.i // 8 GROUP BY vec_id, k.a, p.i % 8),
    {out}_c AS (SELECT vec_id, y, k.a AS x, greatest(0, least(255, sum(v * k.w))) AS v FROM {out}_r JOIN {k} k ON k.i = {out}_r.x GROUP BY vec_id, y, k.a), {out} AS (SELECT vec_id, avg(v) AS v FROM {out}_c GROUP BY vec_id)"""  # noqa: E731
    return f"""WITH {_PAIRS}, {_numbers_sql('d', d)}, {_numbers_sql('l', l)}, {_numbers_sql('g', g)}, p AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px)::DOUBLE AS v FROM pairs),
    u AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px) - unnest(pred) AS r FROM pairs), rows AS (SELECT vec_id, d.a AS y, u.i % 8 AS x, sum(u.r * d.w) AS v FROM u JOIN d ON d.i = u.i // 8 GROUP BY vec_id, d.a, u.i % 8),
    f AS (SELECT vec_id, y, d.a AS x, sum(v * d.w) AS v FROM rows JOIN d ON d.i = rows.x GROUP BY vec_id, y, d.a), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC) AS k FROM f),
    s AS (SELECT vec_id, sum(v * v) AS energy, sum(v * v) FILTER (k > 8) AS rest FROM o GROUP BY vec_id), {resized('l', 'shrunk', 4)}, {resized('g', 'grown', 16)}
    SELECT vec_id, round(energy, 4) + 0.0 AS energy, round(rest, 4) + 0.0 AS "left", round(shrunk.v, 6) AS lanczos_mean, round(grown.v, 6) AS triangle_mean FROM s JOIN shrunk USING (vec_id) JOIN grown USING (vec_id)"""


@query(_spectra_sql())
def spectra(t: Tables) -> DataFrame:
    """Energy of each residual's spectrum, what its eight largest coefficients leave, and the means of the plane resized by Lanczos and triangle kernels."""

    def both(px, pred):
        rest = px - pred
        return (raster.dct(rest) ** 2).sum((1, 2)), ((rest - raster.largest_coefficients(rest, 8)) ** 2).sum((1, 2)), raster.resample(px, 4, 4, "lanczos3").mean((1, 2)), raster.resample(px, 16, 16, "triangle").mean((1, 2))

    found = _numbers(_pairs(t), ["px", "pred"], both, "energy left lanczos_mean triangle_mean")
    return found.select("vec_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("energy", "left")], *[F.round(c, 6).alias(c) for c in ("lanczos_mean", "triangle_mean")])


_RETILED = 12


@query(f"""WITH {PLANES_SQL}, g AS (SELECT (vec_id % 16) * 8 + i % 8 AS gx, (vec_id // 16) * 8 + i // 8 AS gy, px[i + 1] AS v FROM planes, range(0, 64) r(i)), n AS (SELECT (gx // {_RETILED})::INTEGER AS x, (gy // {_RETILED})::INTEGER AS y, gx % {_RETILED} AS c, gy % {_RETILED} AS r, v FROM g),
t AS (SELECT DISTINCT x, y FROM n) SELECT t.x, t.y, string_agg(coalesce(n.v, 0), ',' ORDER BY i) AS px, max(coalesce(n.v, 0)) = 0 AS blank FROM t CROSS JOIN range(0, {_RETILED * _RETILED}) p(i) LEFT JOIN n ON n.x = t.x AND n.y = t.y AND n.c = i % {_RETILED} AND n.r = i // {_RETILED} GROUP BY t.x, t.y""")
def retiled_planes(t: Tables) -> DataFrame:
    own = bind.planes(t).select((F.col("vec_id") % 16).cast("int").alias("x"), F.floor(F.col("vec_id") / 16).cast("int").alias("y"), "px")
    return tiles.retile(own, N, _RETILED, 16 * N, 1 << 20).select("x", "y", _text(F.col("px")).alias("px"), "blank")


@query()
def precompensation(t: Tables) -> DataFrame:
    """Bytes and mean squared error of residuals coded scaled, or after rounds of correction, summed over all planes."""
    ways = [("baseline", 1.0, 0), *[(f"scale_{s}", s, 0) for s in (1.1, 1.2, 1.3, 1.5)], *[(f"iterative_{k}", 1.0, k) for k in (1, 2, 3)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, pred = (batch.column(k).flatten().to_numpy().astype(float).reshape(-1, N, N) for k in (0, 1))
            rows = []
            for name, scale, rounds in ways:
                for rest in px - pred:
                    got, size = codec.precompensated(rest, 4.0, scale, rounds)
                    rows.append((name, size, float(((got - rest) ** 2).sum())))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["strategy", "bytes", "error"])

    each = _pairs(t).select("px", "pred").mapInArrow(run, "strategy string, bytes bigint, error double")
    return each.groupBy("strategy").agg(F.sum("bytes").alias("bytes"), F.round(F.sum("error") / (N * N * F.count("*")), 6).alias("mse"))


SWEEP = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 16.0)


def codec_sweep(t: Tables) -> DataFrame:
    """(codec, step, bytes, psnr): all planes as families of 2, 4 and 8 pixels a side, closed loop, by codec and step; the lower of both levels' PSNR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N, N)
            rows = []
            for name in codec.CODECS:
                for step in SWEEP:
                    bytes_, one, two = families.swept(full, name, step)
                    rows.append((name, step, bytes_, one, two, len(full)))
            if len(full):
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["codec", "step", "bytes", "e1", "e0", "n"])

    sums = bind.planes(t).select("px").mapInArrow(run, "codec string, step double, bytes bigint, e1 double, e0 double, n bigint").groupBy("codec", "step").agg(*[F.sum(c).alias(c) for c in ("bytes", "e1", "e0", "n")])
    psnr = lambda e, pixels: scalar.psnr(F.col(e) / (F.col("n") * pixels), 100)
    return sums.select("codec", "step", "bytes", F.least(psnr("e1", N * N // 4), psnr("e0", N * N)).alias("psnr"))


@query()
def iso_size_comparison(t: Tables) -> DataFrame:
    """Each step of the dead-zone codec against the step of the delta codec that is nearest in bytes: what it gains in PSNR."""
    sweep = codec_sweep(t).withColumn("one", F.lit(1))
    own, others = sweep.where("codec = 'deadzone'").drop("codec"), sweep.where("codec = 'delta'").select("one", "bytes", "step", "psnr")
    met = joins.nearest_size(own, others, ["one"], "bytes", ["step", "psnr"])
    return met.select("step", "bytes", F.round("psnr", 6).alias("psnr"), "ref_step", "ref_bytes", F.round("ref_psnr", 6).alias("ref_psnr"), F.round(F.col("psnr") - F.col("ref_psnr"), 6).alias("gain"))


@query()
def colour_families(t: Tables) -> DataFrame:
    """Tiles of 2 by 2 colours rebuilt from families of 8 by 8 (three planes are the channels): how far they are from the truth, by level and whether a residual made them."""
    side = N // 4

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x2, y2 = [], []
            columns = [[], [], [], [], []]
            for key, px in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plane = np.array(px).reshape(N, N)
                full = np.stack((plane, plane.T, 255 - plane), -1)
                l2, one, two = colour.encode_family(full)
                keep = [None if (key + k) % 5 == 0 else r.reshape(-1).tolist() for k, r in enumerate(two)]
                bases = [full[k // 4 * side : (k // 4 + 1) * side, k % 4 * side : (k % 4 + 1) * side].reshape(-1).tolist() for k in range(16)]
                for column, value in zip(columns, (l2.reshape(-1).tolist(), [r.reshape(-1).tolist() for r in one], keep, None, bases), strict=True):
                    column.append(value)
                x2.append(key)
                y2.append(0)
            planes = pa.list_(pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(x2, pa.int32()), pa.array(y2, pa.int32()), pa.array(columns[0], pa.list_(pa.int32())), *[pa.array(c, planes) for c in columns[1:]]], names=["x2", "y2", "l2", "residual_1", "residual_0", "base_1", "base_0"])

    coded = bind.planes(t).select("vec_id", "px").mapInArrow(code, "x2 int, y2 int, l2 array<int>, residual_1 array<array<int>>, residual_0 array<array<int>>, base_1 array<array<int>>, base_0 array<array<int>>")
    rebuilt = colour.rebuild_families(coded, side)
    total = F.aggregate("px", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rebuilt.groupBy("level", "used_residual").agg(F.count("*").alias("tiles"), F.sum(total).alias("px_sum"))


@query()
def residual_codecs(t: Tables) -> DataFrame:
    """Bytes and squared error of each plane's residual by codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, pred = (batch.column(k).flatten().to_numpy().astype(float).reshape(-1, N, N) for k in (1, 2))
            rows = []
            for vec, rest in zip(batch.column(0).to_pylist(), px - pred, strict=True):
                for name, (encode, decode) in codec.CODECS.items():
                    data = encode(rest, 4.0)
                    rows.append((vec, name, len(data), float(((decode(data) - rest) ** 2).sum())))
                data = codec.sparse_encode(rest, 4.0)
                rows.append((vec, "sparse", len(data), float(((codec.sparse_decode(data) - rest) ** 2).sum())))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["vec_id", "codec", "bytes", "error"])

    return _pairs(t).select("vec_id", "px", "pred").mapInArrow(run, "vec_id bigint, codec string, bytes bigint, error double")


@query(f"""WITH {_PAIRS}, u AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px) - unnest(pred) AS r FROM pairs), g AS (SELECT vec_id, i % 8 AS c, i // 8 AS y, r, CASE WHEN i % 8 = 0 OR i < 8 THEN 0 ELSE lag(r, 8) OVER (PARTITION BY vec_id ORDER BY i) END AS above FROM u),
q AS (SELECT *, round_even(r / 4.0, 0) * 4 AS plain, round_even((r - above) / 4.0, 0) * 4 AS step FROM g), d AS (SELECT *, CASE WHEN c = 0 THEN step ELSE sum(step) OVER (PARTITION BY vec_id, c ORDER BY y) END AS summed FROM q)
SELECT vec_id, sum((plain - r) * (plain - r))::DOUBLE AS deadzone_error, sum((summed - r) * (summed - r))::DOUBLE AS delta_error FROM d GROUP BY vec_id""")
def residual_codec_errors(t: Tables) -> DataFrame:
    """Squared error of each plane's residual after the dead-zone and the delta codec, bytes and back."""

    def both(px, pred):
        return [[float(((decode(encode(r, 4.0)) - r) ** 2).sum()) for r in px - pred] for encode, decode in (codec.CODECS["deadzone"], codec.CODECS["delta"])]

    return _numbers(_pairs(t), ["px", "pred"], both, "deadzone_error delta_error")


def family_packs(t: Tables) -> DataFrame:
    """(family, n, pack): the 16 planes of a family, deflated and packed together. One group is one family, so groups are small."""
    own = _pairs(t).select(F.shiftright("vec_id", 4).alias("family"), (F.col("vec_id") % 16).cast("int").alias("idx"), raster.residual_raw(F.col("px"), F.col("pred")).alias("r"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        entries = [(0, i, codec.deadzone_encode(np.array(r, float).reshape(N, N), 4.0)) for i, r in zip(table["idx"].to_pylist(), table["r"].to_pylist(), strict=True)]
        return pa.table([table["family"][:1], pa.array([len(entries)], pa.int32()), pa.array([codec.encode_pack(entries)], pa.binary())], names=["family", "n", "pack"])

    return own.groupBy("family").applyInArrow(pack, "family bigint, n int, pack binary")


@query()
def pack_contents(t: Tables) -> DataFrame:
    """The index of every family's pack, read back from its bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, k, i, at, n, float(np.abs(codec.deadzone_decode(blob)).sum())) for f, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, i, at, n, blob in codec.decode_pack(p)]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["family", "level_kind", "idx", "offset", "length", "energy"])

    return family_packs(t).select("family", "pack").mapInArrow(read, "family bigint, level_kind int, idx int, offset bigint, length bigint, energy double")


@query()
def bd_rates(t: Tables) -> DataFrame:
    """Rate and quality differences of each series' curve from the reference series', by monotone cubics; null where they can't be compared."""
    money = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    ladder = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series"), F.floor(F.col("l_quantity") / 5).cast("int").alias("step")).agg(F.avg(money).alias("rate"), F.avg("l_quantity").alias("psnr"))
    reference = ladder.where("series = 'NO'").agg(F.collect_list("rate").alias("r0"), F.collect_list("psnr").alias("p0"))
    curves = ladder.where("series <> 'NO'").groupBy("series").agg(F.collect_list("rate").alias("r1"), F.collect_list("psnr").alias("p1"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                curve = (row["r0"], row["p0"], row["r1"], row["p1"])
                try:
                    rows.append((row["series"], metrics.bd_rate(*curve), metrics.bd_psnr(*curve)))
                except ValueError:
                    rows.append((row["series"], None, None))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.float64()), strict=True)], names=["series", "bd_rate", "bd_psnr"])

    # one row of at most eleven points
    return curves.join(F.broadcast(reference), F.lit(True)).mapInArrow(compare, "series string, bd_rate double, bd_psnr double")


@query()
def family_closed_loop(t: Tables) -> DataFrame:
    """Bytes of each plane coded as a family of 2, 4 and 8 pixels a side, and the greatest error of its reconstruction."""
    coded = families.encode_families(bind.planes(t), ["vec_id"], N, 2.0, 2.0)
    back = families.reconstruct_families(coded, ["vec_id"], N)
    sized = coded.select("vec_id", (F.octet_length("l1_residual") + F.octet_length("l0_residual")).alias("bytes"))
    error = F.array_max(F.zip_with("px", "l0", lambda a, b: F.abs(a - b)))
    return bind.planes(t).join(back, "vec_id").select("vec_id", error.alias("max_error")).join(sized, "vec_id")


@query(f"""WITH {PLANES_SQL}, g AS (SELECT (vec_id % 16)::INTEGER AS x, (vec_id // 16)::INTEGER AS y, px FROM planes WHERE vec_id >= 0), p AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y FROM g),
v AS (SELECT p.x, p.y, i, sum(coalesce(g.px[((2 * (i // 8) + b) % 8) * 8 + (2 * (i % 8) + a) % 8 + 1], 255)) AS s FROM p CROSS JOIN range(0, 64) r(i) CROSS JOIN range(0, 2) ra(a) CROSS JOIN range(0, 2) rb(b)
LEFT JOIN g ON g.x = p.x * 2 + (2 * (i % 8) + a) // 8 AND g.y = p.y * 2 + (2 * (i // 8) + b) // 8 GROUP BY p.x, p.y, i)
SELECT x, y, string_agg((s::BIGINT + 2) // 4, ',' ORDER BY i) AS px FROM v GROUP BY x, y""")
def lower_level(t: Tables) -> DataFrame:
    own = bind.planes(t).select((F.col("vec_id") % 16).cast("int").alias("x"), F.floor(F.col("vec_id") / 16).cast("int").alias("y"), "px")
    return families.lower_levels(own, 1, N, kind="box")[0].select("x", "y", _text(F.col("px")).alias("px"))


def _lanczos_sql() -> str:
    """The weights of 16 pixels for 8, as a table."""
    weights = raster.kernel_matrix(2 * N, N, 3.0, raster.lanczos3)
    rows = ", ".join(f"({i}, {j}, {float(weights[i, j])!r}::DOUBLE)" for i in range(N) for j in range(2 * N) if weights[i, j])
    return f"""WITH {PLANES_SQL}, k(i, j, w) AS (VALUES {rows}), g AS (SELECT (vec_id % 16)::INTEGER AS x, (vec_id // 16)::INTEGER AS y, px FROM planes), p AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y FROM g),
    m AS (SELECT p.x, p.y, c, r, coalesce(g.px[(r % 8) * 8 + c % 8 + 1], 255) AS v FROM p CROSS JOIN range(0, 16) rc(c) CROSS JOIN range(0, 16) rr(r) LEFT JOIN g ON g.x = p.x * 2 + c // 8 AND g.y = p.y * 2 + r // 8),
    a AS (SELECT x, y, c, k.i AS r, sum(v * k.w) AS v FROM m JOIN k ON k.j = m.r GROUP BY x, y, c, k.i),
    b AS (SELECT x, y, k.i AS c, r, sum(v * k.w) AS v FROM a JOIN k ON k.j = a.c GROUP BY x, y, k.i, r)
    SELECT x, y, string_agg(floor(round(greatest(0, least(255, v)), 9) + 0.5)::INTEGER, ',' ORDER BY r, c) AS px FROM b GROUP BY x, y"""


@query(_lanczos_sql())
def lower_level_lanczos(t: Tables) -> DataFrame:
    own = bind.planes(t).select((F.col("vec_id") % 16).cast("int").alias("x"), F.floor(F.col("vec_id") / 16).cast("int").alias("y"), "px")
    return families.lower_levels(own, 1, N)[0].select("x", "y", _text(F.col("px")).alias("px"))


@query(f"""WITH {PLANES_SQL}, s AS (SELECT vec_id, i, px[i + 1] AS v, (px[2 * ((i % 8) // 2) + 16 * (i // 16) + 1] + px[2 * ((i % 8) // 2) + 16 * (i // 16) + 2] + px[2 * ((i % 8) // 2) + 16 * (i // 16) + 9] + px[2 * ((i % 8) // 2) + 16 * (i // 16) + 10]) / 4 AS m FROM planes, range(0, 64) r(i))
SELECT vec_id, sum((v - floor(m)) * (v - floor(m)))::BIGINT AS by_floor, sum((v - ceil(m)) * (v - ceil(m)))::BIGINT AS by_ceil, sum((v - floor(m + 0.5)) * (v - floor(m + 0.5)))::BIGINT AS by_round FROM s GROUP BY vec_id""")
def rounding_energy(t: Tables) -> DataFrame:
    """Squared error of each plane from its 2 by 2 means, when these are rounded down, up and to the nearest."""
    sums = raster.on_array(F.col("px"), N, N, lambda p: raster.nearest(p[:, ::2, ::2] + p[:, ::2, 1::2] + p[:, 1::2, ::2] + p[:, 1::2, 1::2], 2))
    energy = lambda add: F.aggregate(F.zip_with("px", "sums", lambda v, s: (v - F.shiftright((s + add).cast("int"), 2)) * (v - F.shiftright((s + add).cast("int"), 2))), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return bind.planes(t).select("vec_id", "px", sums.alias("sums")).select("vec_id", energy(0).alias("by_floor"), energy(3).alias("by_ceil"), energy(2).alias("by_round"))


@query(f"""WITH {PLANES_SQL} SELECT vec_id, list_max(px) = 0 AS is_zero, list_max(px) - list_min(px) < 90 AS is_flat FROM planes""")
def blank_tiles(t: Tables) -> DataFrame:
    return bind.planes(t).select("vec_id", (F.array_max("px") == 0).alias("is_zero"), (F.array_max("px") - F.array_min("px") < 90).alias("is_flat"))


def _surface() -> np.ndarray:
    """An orthonormal basis of quadratic surfaces, pixels by six."""
    y, x = np.mgrid[0:N, 0:N] / (N - 1)
    return np.linalg.qr(np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], -1).reshape(N * N, 6))[0]


@query(f"""WITH {_PAIRS}, {_numbers_sql('basis', _surface().T)}, u AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(px) - unnest(pred) AS r FROM pairs), c AS (SELECT vec_id, a, sum(r * w) AS c FROM u JOIN basis USING (i) GROUP BY vec_id, a),
e AS (SELECT vec_id, sum(r * r)::DOUBLE AS energy FROM u GROUP BY vec_id), s AS (SELECT vec_id, sum(c * c) AS fitted FROM c GROUP BY vec_id)
SELECT vec_id, energy, round(energy - fitted, 4) + 0.0 AS "left" FROM e JOIN s USING (vec_id)""")
def quadratic_fit(t: Tables) -> DataFrame:
    """What a quadratic surface fitted to each residual plane leaves of its energy."""
    basis = _surface()

    def both(px, pred):
        rest = (px - pred).reshape(len(px), -1)
        return (rest**2).sum(1), ((rest - rest @ basis @ basis.T) ** 2).sum(1)

    found = _numbers(_pairs(t), ["px", "pred"], both, "energy left")
    return found.select("vec_id", "energy", (F.round("left", 4) + 0.0).alias("left"))
