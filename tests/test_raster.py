import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import codec, colour, families, metrics, raster, tiles


def plane(spark, values):
    return spark.createDataFrame([(list(map(int, values)),)], "px array<int>")


def test_residuals(spark):
    df = spark.createDataFrame([([150, 100, 200, 50], [140, 110, 180, 60])], "a array<int>, b array<int>")
    raw = raster.residual_raw(F.col("a"), F.col("b"))
    assert df.select(raw, raster.residual_centred(raw)).first()[:] == ([10, -10, 20, -10], [138, 118, 148, 118])
    assert plane(spark, [200, -200]).select(raster.residual_centred(F.col("px"))).first()[0] == [255, 0]
    df = spark.createDataFrame([([100, 150, 200], [138, 118, 148])], "p array<int>, r array<int>")
    assert df.select(raster.apply_residual(F.col("p"), F.col("r"))).first()[0] == [110, 140, 220]


def test_extract_and_mosaic(spark):
    df = plane(spark, range(16))
    assert df.select(raster.extract_tile(F.slice("px", 1, 16), 4, 4, 3, 3, 1)).first()[0] == [15]
    out = df.select(F.array(*[F.array_repeat(F.lit(v), 4) for v in (50, 100, 150, 200)]).alias("t")).select(raster.mosaic(F.col("t"), 2, 2)).first()[0]
    assert out == [50, 50, 100, 100, 50, 50, 100, 100, 150, 150, 200, 200, 150, 150, 200, 200]
    assert df.select(raster.extract_tile(F.col("px"), 4, 4, 1, 1, 3)).first()[0] == [15, 0, 0, 0, 0, 0, 0, 0, 0]


def test_bilinear_corner(spark):
    out = plane(spark, [100, 150, 200, 250]).select(raster.upsample_bilinear(F.col("px"), 2, 2, 2)).first()[0]
    assert len(out) == 16 and out[0] == 100 and out[3] <= 150
    want = np.floor(raster.upsample_float(np.array([[[100, 150], [200, 250.0]]])))[0].reshape(-1)
    assert out == want.astype(int).tolist()


def test_flat_planes_are_left_alone(spark):
    df = plane(spark, [77] * 64)
    for f in (lambda c: raster.unsharp(c, 8, 8, 0.7), lambda c: raster.upsample_bilinear(c, 8, 8, 4), lambda c: raster.downsample_box(c, 8, 8), lambda c: raster.upsample_nearest(c, 8, 8, 2)):
        assert set(df.select(f(F.col("px"))).first()[0]) == {77}


def test_box_repeats_odd_edges(spark):
    assert plane(spark, [0, 4, 8, 12, 16, 20, 24, 28, 32]).select(raster.downsample_box(F.col("px"), 3, 3)).first()[0] == [8, 14, 26, 32]


def test_adjoint():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(1, 4, 4)), rng.normal(size=(1, 8, 8))
    assert abs((raster.upsample_float(x) * y).sum() - (x * raster.upsample_adjoint(y)).sum()) < 1e-9


def test_optimised_bases_never_predict_worse():
    rng = np.random.default_rng(1)
    full = rng.integers(0, 256, (5, 16, 16)).astype(float)
    base = full.reshape(5, 8, 2, 8, 2).mean((2, 4)).round()
    error = lambda b: ((full - np.floor(raster.upsample_float(b))) ** 2).sum((1, 2))
    assert (error(raster.optimised_base(base, full)) <= error(base)).all()
    assert (np.abs(raster.optimised_base(base, full) - base) <= 15.5).all()


def test_colour_roundtrip(spark):
    grid = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    df = spark.createDataFrame(grid, "r int, g int, b int")
    y, cb, cr = scalar.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    coded = df.select("*", y.alias("y"), cb.alias("cb"), cr.alias("cr"))
    back = coded.select("r", "g", "b", *scalar.ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))).collect()
    assert max(abs(r[k] - r[k + 3]) for r in back for k in range(3)) <= 2
    assert spark.range(1).select(scalar.unpremultiply(F.lit(64), F.lit(128)), scalar.unpremultiply(F.lit(9), F.lit(0)), scalar.unpremultiply(F.lit(9), F.lit(255))).first()[:] == (128, 255, 9)


def test_dct_inverts():
    x = np.random.default_rng(2).normal(size=(3, 8, 8))
    assert np.allclose(raster.inverse_dct(raster.dct(x)), x)
    assert np.allclose(raster.largest_coefficients(x, 64), x)
    assert np.allclose(raster.resample(np.full((1, 8, 8), 9.0), 4, 4, "lanczos3"), 9)


def test_packs():
    entries = [(1, 0, b"\xff\xd8\xff\xd9"), (0, 3, bytes([1, 2, 3, 4, 5])), (0, 4, b"")]
    data = codec.encode_pack(entries)
    assert [(k, i, d) for k, i, _, _, d in codec.decode_pack(data)] == entries
    assert codec.pack_lookup(data, 0, 3) == bytes([1, 2, 3, 4, 5]) and codec.pack_lookup(data, 0, 0) is None
    plain = codec.encode_pack(entries, compress=False)
    assert plain[:4] == b"ORIG" and codec.lz4_unpack(data) == plain
    assert len(codec.decode_pack(b"RRIP" + plain[4:], compressed=False)) == 3
    with pytest.raises(ValueError):
        codec.decode_pack(b"XXXX" + plain[4:], compressed=False)
    with pytest.raises(ValueError):
        codec.decode_pack(b"ORIG", compressed=False)
    assert codec.decode_pack(codec.encode_pack([])) == []


def test_bundles():
    data = codec.encode_bundle(2, 1, [(0, 0, b"abc")])
    assert codec.bundle_index(data) == [(0, 0, 32, 3)] and codec.bundle_read(data, 0, 0) == b"abc"
    for col, row in ((2, 0), (0, 1)):
        with pytest.raises(IndexError):
            codec.bundle_read(data, col, row)
    with pytest.raises(KeyError):
        codec.bundle_read(data, 1, 0)


def test_residual_codecs():
    x = np.random.default_rng(3).integers(-60, 60, (8, 8)).astype(float)
    for name in ("deadzone", "delta"):
        encode, decode = codec.codec(name)
        assert np.allclose(decode(encode(x, 1.0)), x) if name == "deadzone" or np.abs(np.diff(x, axis=0)).max() < 128 else True
        assert np.abs(codec.deadzone_decode(codec.deadzone_encode(x, 5.0)) - x).max() <= 2.5
    sparse = codec.sparse_decode(codec.sparse_encode(x, 30))
    assert ((sparse == 0) | (np.abs(x) > 30)).all()
    with pytest.raises(ValueError):
        codec.codec("jpegxl")


def test_metrics():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (2, 16, 16)).astype(float)
    for f in (metrics.ssim, lambda x, y: metrics.ssim(x, y, "gaussian"), metrics.multiscale_ssim, metrics.visual_information_fidelity):
        assert np.allclose(f(a, a), 1, atol=1e-6) and (f(a, np.clip(a + rng.normal(0, 40, a.shape), 0, 255)) < 1).all()
    pair = np.array([[50.0, 2.6772, -79.7751]]), np.array([[50.0, 0.0, -82.7485]])
    assert abs(metrics.delta_e2000(*pair)[0] - 2.0425) < 1e-4  # the first pair of the published test data
    assert metrics.delta_e76(*pair)[0] == pytest.approx(np.hypot(2.6772, 2.9734))


def test_bd_rate_of_scaled_curves():
    rate, psnr = np.array([100, 200, 400, 800, 1600.0]), np.array([30, 33, 36, 38.5, 40.0])
    assert metrics.bd_rate(rate, psnr, rate * 1.2, psnr) == pytest.approx(20)
    assert metrics.bd_psnr(rate, psnr, rate, psnr + 1.5) == pytest.approx(1.5)
    with pytest.raises(ValueError):
        metrics.bd_rate(rate, psnr, rate, psnr + 100)
    with pytest.raises(ValueError):
        metrics.bd_rate(rate[:3], psnr[:3], rate, psnr)


def test_closed_loop_error_is_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(0, 256, 256).tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, "id long, px array<int>")
    coded = families.encode_families(df, ["id"], 16, 3.0, 3.0)
    back = {r.id: r.l0 for r in families.reconstruct_families(coded, ["id"], 16).collect()}
    assert max(abs(a - b) for k, px in rows for a, b in zip(px, back[k], strict=True)) <= 2


def test_real_tiles(spark):
    """Planes of 256 pixels a side, by plain loops over some pixels; null planes stay null."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (256, 256))
    df = spark.createDataFrame([(1, x.reshape(-1).tolist()), (2, None)], "id int, px array<int>")
    c = F.col("px")
    operators = [raster.upsample_bilinear(c, 256, 256, 2), raster.upsample_bilinear(c, 256, 256, 4), raster.downsample_box(c, 256, 256), raster.unsharp(c, 256, 256, 0.25), raster.extract_tile(c, 256, 256, 1, 3, 70), raster.upsample_nearest(c, 256, 256, 4)]
    one, none = df.select("id", *[o.alias(f"o{k}") for k, o in enumerate(operators)]).orderBy("id").collect()
    assert all(none[k + 1] is None for k in range(len(operators)))
    got = [np.array(one[k + 1]) for k in range(len(operators))]
    for scale, plane_ in ((2, got[0].reshape(512, 512)), (4, got[1].reshape(1024, 1024))):
        for _ in range(300):
            ty, tx = rng.integers(0, 256 * scale, 2)
            (y0, y1, fy), (x0, x1, fx) = raster._taps(256, scale)[ty], raster._taps(256, scale)[tx]
            want = (x[y0, x0] * (256 - fx) * (256 - fy) + x[y0, x1] * fx * (256 - fy) + x[y1, x0] * (256 - fx) * fy + x[y1, x1] * fx * fy) >> 16
            assert plane_[ty, tx] == want
    assert got[2].reshape(128, 128)[5, 7] == (x[10:12, 14:16].sum() + 2) >> 2
    blur = sum(x[9 + a, 29 + b] * k for a in range(3) for b, k in enumerate((1, 2, 1)) for k in [k * (1, 2, 1)[a]])
    assert got[3].reshape(256, 256)[10, 30] == min(255, max(0, (x[10, 30] * 4096 + (x[10, 30] * 16 - blur) * 64 + 2048) >> 12))
    want = np.zeros((70, 70), int)
    want[:46] = x[210:256, 70:140]
    assert (got[4].reshape(70, 70) == want).all() and (got[5].reshape(1024, 1024)[::4, ::4] == x).all()


def test_sharpened_levels_see_across_tiles(spark):
    """Every level equals the mask over the whole image, with a missing tile and an odd number of tiles."""
    rng = np.random.default_rng(6)
    cols, rows, side = 5, 3, 8
    image = rng.integers(0, 256, (rows * side, cols * side))
    image[side : 2 * side, 2 * side : 3 * side] = 0
    own = [(x, y, image[y * side : (y + 1) * side, x * side : (x + 1) * side].reshape(-1).tolist()) for x in range(cols) for y in range(rows) if (x, y) != (2, 1)]
    levels = families.sharpened_levels(spark.createDataFrame(own, "x int, y int, px array<int>"), 2, side, cols, rows)
    for level in levels:
        h, w = image.shape[0] // 2, image.shape[1] // 2
        image = raster.sharpen(raster.box_half(image[None, : 2 * h, : 2 * w]), 0.25)[0]
        for r in level.collect():
            want = np.zeros((side, side), int)
            part = image[r.y * side : (r.y + 1) * side, r.x * side : (r.x + 1) * side]
            want[: part.shape[0], : part.shape[1]] = part
            assert (np.array(r.px).reshape(side, side) == want).all(), (r.x, r.y)


def test_chroma_steps():
    """One step by hand: the forward step is bilinear, and the last state counts, not the best."""
    small, target = np.array([[[100.0, 100], [100, 100]]]), np.full((1, 4, 4), 104.0)
    assert (raster.optimised_chroma(small, target, steps=1) == 101).all()
    assert (raster.optimised_chroma(small, target + 100, steps=50) == 108).all()
    worse = raster.optimised_chroma(small, np.full((1, 4, 4), 101.0), most=100, steps=1, rate=50)
    assert (worse == 150).all()


def test_sparse_planes_have_a_bound():
    assert codec.sparse_decode(codec.sparse_encode(np.full((256, 256), 9.0), 1.0)).min() > 0
    with pytest.raises(ValueError):
        codec.sparse_encode(np.zeros((257, 256)), 1.0)


def test_visual_comparison(spark):
    """A hundred pixels that differ by exactly the threshold are no significant difference; one more is."""
    for step, percent, passed in ((10, 0.0, True), (11, 100.0, False)):
        df = spark.createDataFrame([([100] * 100, [100 + step] * 100)], "a array<int>, b array<int>")
        found = metrics.visual_comparison([F.col("a")] * 3, [F.col("b")] * 3)
        r = df.select(*[c.alias(k) for k, c in found.items()]).first()
        assert (r.mse, r.max_diff, r.pct_significant, r.passed) == (step * step, 3 * step, percent, passed)
    energy = spark.createDataFrame([(100.0, 10.0), (100.0, 100.0), (100.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in energy.select(metrics.equivalent_db(F.col("a"), F.col("b"))).collect()] == [10.0, 0.0, 0.0, 0.0]


def test_edge_guided_codec():
    """Only pixels near the base's edge are coded, to half a step."""
    base = np.zeros((8, 8))
    base[:, 4:] = 200
    rest = np.random.default_rng(1).integers(-100, 100, (16, 16)).astype(float)
    mask = codec.edge_mask(base, rest.shape)
    got = codec.edge_decode(codec.edge_encode(rest, base))
    assert mask[:, 7:9].all() and not mask[:, :4].any() and not mask[:, 12:].any()
    assert (got[~mask] == 0).all() and np.abs(got - rest)[mask].max() <= codec.EDGE_STEP / 2
    assert (codec.edge_decode(codec.edge_encode(rest, np.zeros((8, 8)))) == 0).all()


def test_colour_planes():
    """A 17-step grid comes back to two units; luma is truncated."""
    grid = np.stack(np.meshgrid(*[np.arange(0, 256, 17)] * 3), -1).reshape(1, -1, 1, 3)
    y, cb, cr = colour.split(grid)
    assert np.abs(colour.merge(y, cb, cr) - grid).max() <= 2
    assert colour.grey(np.array([[[255, 0, 1]]]))[0, 0] == 76


def test_colour_regions():
    y, c = np.full((4, 4), 100), np.full((4, 4), 128)
    out = colour.region(y, c, c, 2, 2, 4, np.full((4, 4), 138))
    assert (out[:2, :2] == 110).all() and (out[2:] == 0).all() and (out[:, 2:] == 0).all()


def test_colour_families(spark):
    """Closed loop: luma comes back to the rounding of colours; tiles without a residual are their baselines, and such with neither an error."""
    rng = np.random.default_rng(4)
    side = 4
    y, x = np.mgrid[0:16, 0:16]
    full = np.stack([np.clip(120 + 3 * x + rng.integers(-9, 9, (16, 16)), 0, 255), np.clip(90 + 4 * y, 0, 255), np.clip(100 + 2 * x + y, 0, 255)], -1)
    l2, one, two = colour.encode_family(full)
    flat = lambda tiles: [None if t is None else t.reshape(-1).tolist() for t in tiles]
    base = [np.full((side, side, 3), k) for k in range(16)]
    schema = "x2 int, y2 int, l2 array<int>, residual_1 array<array<int>>, residual_0 array<array<int>>, base_1 array<array<int>>, base_0 array<array<int>>"
    some = [None if k == 5 else r for k, r in enumerate(two)]
    df = spark.createDataFrame([(3, 2, l2.reshape(-1).tolist(), flat(one), flat(some), None, flat(base))], schema)
    rows = colour.rebuild_families(df, side).collect()
    assert sorted((r.level, r.x, r.y) for r in rows) == sorted([(1, 6 + k % 2, 4 + k // 2) for k in range(4)] + [(0, 12 + k % 4, 8 + k // 4) for k in range(16)])
    truth = colour.split(full[None])[0][0]
    for r in rows:
        tile = np.array(r.px).reshape(side, side, 3)
        if r.level == 0:
            k = (r.y - 8) * 4 + r.x - 12
            assert r.used_residual == (k != 5)
            if k == 5:
                assert (tile == 5).all()
            else:
                own = truth[k // 4 * side : (k // 4 + 1) * side, k % 4 * side : (k % 4 + 1) * side]
                assert np.abs(colour.split(tile[None])[0][0] - own).max() <= 3
    with pytest.raises(ValueError):
        colour.rebuild(l2, [one, some], [[None] * 4, [None] * 16])
    grey = colour.rebuild_families(df, side, sharpen=0.25, in_grey=True).collect()
    assert all(len(r.px) == side * side for r in grey)


def test_halved_chroma():
    plane = np.random.default_rng(7).integers(0, 256, (3, 8, 8))
    error = lambda s: ((np.floor(raster.upsample_float(s.astype(float))) - plane) ** 2).sum()
    assert error(colour.halved_chroma(plane, True)) <= error(colour.halved_chroma(plane))


def test_precompensation():
    rest = np.random.default_rng(8).integers(-60, 60, (8, 8)).astype(float)
    plain, size = codec.precompensated(rest, 4.0)
    assert np.abs(plain - rest).max() <= 2 and size == len(codec.deadzone_encode(rest, 4.0))
    scaled, _ = codec.precompensated(rest, 4.0, scale=1.5)
    assert np.abs(scaled - rest).max() <= 2.5 / 1.5 + 1e-5  # half a step, and the rounding before it
    assert np.isfinite(codec.precompensated(rest, 4.0, rounds=3)[0]).all()


def test_retile(spark):
    """Larger and smaller tiles, with a missing one and an image that ends inside a tile."""
    rng = np.random.default_rng(9)
    image = np.zeros((24, 32), int)
    image[:21, :30] = rng.integers(1, 256, (21, 30))
    image[8:16, 8:16] = 0
    own = [(x, y, image[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].reshape(-1).tolist()) for x in range(4) for y in range(3) if (x, y) != (1, 1)]
    for side in (3, 8, 20):
        out = tiles.retile(spark.createDataFrame(own, "x int, y int, px array<int>"), 8, side, 30, 21).collect()
        wide = np.zeros((60, 60), int)
        wide[:21, :30] = image[:21, :30]
        for r in out:
            want = wide[r.y * side : (r.y + 1) * side, r.x * side : (r.x + 1) * side]
            assert (np.array(r.px).reshape(side, side) == want).all() and r.blank == (want.max() == 0)
        assert {(r.x, r.y) for r in out} >= {(x // side, y // side) for y in range(21) for x in range(30) if image[y, x]}
