import random
import statistics

from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import aggregates, joins, runs, tiles, windows


def test_tile_names(spark):
    df = spark.createDataFrame([("3_2.jpg",), ("foo.jpg",), ("3_2.png",), ("3_2",), ("",), (None,)], "name string")
    strict = df.select(*tiles.tile_coordinates(F.col("name"))).collect()
    assert [tuple(r) for r in strict] == [(3, 2)] + [(None, None)] * 5
    lenient = df.select(*tiles.tile_coordinates(F.col("name"), strict=False)).collect()
    assert [tuple(r) for r in lenient][:4] == [(3, 2), (None, None), (None, None), (3, 2)]


def test_children_and_index(spark):
    out = tiles.children(spark.createDataFrame([(1, 2)], "x2 int, y2 int"), 2).withColumn("back", tiles.child_index(F.col("x"), F.col("y"), 2)).collect()
    assert len(out) == 16 and all(r.idx == r.back and r.x >> 2 == 1 and r.y >> 2 == 2 for r in out)


def test_prune_reaches_the_scan(spark, tmp_path):
    df = tiles.with_family(spark.range(1000).select((F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") / 32).cast("int").alias("y")))
    df.write.parquet(str(tmp_path / "t"))
    plan = tiles.prune_by_tile(spark.read.parquet(str(tmp_path / "t")), 9, 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(x2,2)" in plan and "EqualTo(y2,1)" in plan


def test_dzi_levels(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (256, 100), (257, 1), (1 << 20, 5)], "w int, h int")
    assert [r[0] for r in df.select(scalar.dzi_max_level(F.col("w"), F.col("h"))).collect()] == [0, 0, 1, 8, 9, 20]


def test_rounding_variants(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.4,), (-1.6,)], "v double")
    v = F.col("v")
    assert [tuple(r) for r in df.select(scalar.round_half_away(v), scalar.round_half_even(v), scalar.truncate(v)).collect()] == [(3, 2, 2), (-3, -2, -2), (1, 1, 1), (-2, -2, -1)]


def test_psnr_variants(spark):
    df = spark.createDataFrame([(0.0,), (65025.0,)], "m double")
    m = F.col("m")
    assert [tuple(r) for r in df.select(scalar.psnr(m, None), scalar.psnr(m, 100), scalar.psnr(m, 999)).collect()] == [(float("inf"), 100.0, 999.0), (0.0, 0.0, 0.0)]


def test_sniff_and_endian(spark):
    df = spark.createDataFrame([(bytearray(b"RIFF\x10\x00\x00\x00WEBPVP8 "),), (bytearray(b"\xff\x0a\x00"),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b""),)], "d binary")
    assert [r[0] for r in df.select(scalar.sniff_image(F.col("d"))).collect()] == ["webp", "jxl", "jpeg", "jpeg"]
    assert df.select(scalar.little_endian(F.col("d"), 4, 4)).first()[0] == 16


def test_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in range(1, 31)] + [("b", 7)], "g string, v int")
    counts = aggregates.value_counts(df, ["g"], "v")
    out = {r.g: r for r in counts.groupBy("g").agg(aggregates.nearest_rank(50).alias("n50"), aggregates.nearest_rank(95).alias("n95"), aggregates.linear(95).alias("l95"), aggregates.exclusive(95).alias("e95")).collect()}
    assert (out["a"].n50, out["a"].n95, round(out["a"].l95, 9), round(out["a"].e95, 9)) == (16, 29, 28.55, 29.45)
    assert (out["b"].n50, out["b"].l95, out["b"].e95) == (7, 7, 7)


def test_pareto_keeps_strict_improvements(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 1, 6.0), ("s", 2, 6.0), ("s", 3, 7.0), ("s", 4, 1.0)], "g string, size int, gain double")
    assert sorted((r.size, r.gain) for r in windows.pareto_frontier(df, ["g"], "size", "gain").collect()) == [(1, 6.0), (3, 7.0)]


def test_nearest_size_ties_go_down(spark):
    points = spark.createDataFrame([(1, 10), (1, 15), (1, 99), (1, 1)], "g int, size int")
    refs = spark.createDataFrame([(1, 5, "a"), (1, 15, "b"), (1, 15, "c"), (1, 20, "d")], "g int, size int, name string")
    got = {r.size: (r.ref_size, r.ref_name) for r in joins.nearest_size(points, refs, ["g"], "size", ["name"]).collect()}
    assert got == {10: (5, "a"), 15: (15, "b"), 99: (20, "d"), 1: (5, "a")}


def test_run_names(spark):
    names = ["webp_jpeg_baseline_q80", "jp2_baseline_q50", "single_origami_p90_r40", "jpegli_single_ycbcr_y70_c30", "optl2_debug_l1q60_l0q40_pac", "optl2_j40", "rs_mozjpeg_debug_l1q50_l0q30_s420_optl2", "j45", "rs_444_j40", "rs_420opt_optl2_l1q60_l0q50",
             "rs_444_optl2_d20_l1q70_l0q60", "rs_444_b95_l1q70_l0q60", "rs_420_b90_sharp15_l1q70_l0q60", "rs_420_b90_sdec5_l1q70_l0q60", "gpu_444_b80_s0.25_saved_l1q70_l0q60", "nonsense"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = {r.name: r for r in runs.with_run_fields(df, "name").collect()}
    assert [out[n].run_kind for n in names[:-1]] == [k for k, _ in runs.NAMES] and out["nonsense"].run_kind is None
    assert out["webp_jpeg_baseline_q80"].encoder == "webp" and out["j45"].encoder == "libjpeg-turbo"
    assert out["rs_420_b90_sharp15_l1q70_l0q60"].sharp == 1.5 and out["gpu_444_b80_s0.25_saved_l1q70_l0q60"].strength == 0.25
    assert out["optl2_j40"].optl2 and not out["j45"].optl2 and out["rs_444_optl2_d20_l1q70_l0q60"].delta == 20


def test_manifest_dialects(spark):
    listed = spark.createDataFrame([("r", [("L1", 1, 2, 100, 40.5, 1.0)])], "run string, tiles array<struct<level: string, tx: int, ty: int, residual_bytes: bigint, y_psnr_db: double, y_mse: double>>")
    mapped = spark.createDataFrame([("q", {"L0_3_4": (50, 33.0, 0.9), "bad": (1, 1.0, 1.0)})], "run string, tiles map<string, struct<size: bigint, psnr: double, ssim: double>>")
    both = runs.tiles_of_list(listed).unionByName(runs.tiles_of_map(mapped, "tiles"))
    assert sorted(tuple(r) for r in both.collect()) == [("q", "L0", 3, 4, 50, 33.0), ("r", "L1", 1, 2, 100, 40.5)]


def test_exclusive_quantiles_of_small_groups(spark):
    """The maximum up to 20 values (99: up to 100), interpolated beyond."""
    df = spark.createDataFrame([(n, v) for n in (1, 19, 20, 21, 99, 100, 101) for v in range(1, n + 1)], "g int, v int")
    out = aggregates.value_counts(df, ["g"], "v").groupBy("g").agg(aggregates.exclusive(95).alias("p95"), aggregates.exclusive(99).alias("p99")).collect()
    for r in out:
        v = list(range(1, r.g + 1))
        assert float(r.p95) == (statistics.quantiles(v, n=20)[18] if r.g > 20 else r.g)
        assert abs(float(r.p99) - (statistics.quantiles(v, n=100)[98] if r.g > 100 else r.g)) < 1e-9


def test_size_means_are_whole(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("b", 3), ("b", 4), ("c", 10), ("c", 11), ("c", 11)], "g string, v int")
    assert {r.g: r.avg for r in aggregates.size_statistics(df, ["g"], "v").collect()} == {"a": 2, "b": 4, "c": 11}


def test_flat_ranges_score_nothing(spark):
    df = spark.createDataFrame([("s", 1.0, 5.0, 2.0), ("s", 3.0, 5.0, 2.0), ("t", 1.0, 4.0, 1.0), ("t", 1.0, 8.0, 3.0)], "g string, gain double, size double, ratio double")
    out = sorted((r.g, r.gain, r["size"], r.balance, r.even) for r in windows.balance_scores(df, ["g"], "gain", "size", "ratio").collect())
    assert out == [("s", 1.0, 5.0, 0.0, 0.0), ("s", 3.0, 5.0, 0.6, 0.5), ("t", 1.0, 4.0, 0.4, 0.0), ("t", 1.0, 8.0, 0.0, 0.5)]


def test_labels_of_summaries(spark):
    rows = ['{"mode": "ingest-jpeg-only", "baseq": 80, "l1q": 3, "total_bytes": 1048576}', '{"mode": "ingest-jpeg-only"}', '{"baseq": 95, "l1q": 70, "l0q": 60, "l2_bytes": 1048576, "residual_bytes": 524288}', '{"l1q": 3}', '{"residual_jpeg_q_L": 32, "proposed_bytes": 2097152}', "not json"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string").orderBy("k")
    got = df.select(runs.label(F.col("s"), F.lit("dir"), "Word"), runs.disk_megabytes(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("JPEG Q80", 1.0), ("JPEG Q0", 0.0), ("Word 95/70/60", 1.5), ("dir", 0.0), ("Word Q32", 2.0), ("dir", 0.0)]


def test_nearest_size_over_ranges(spark):
    """Ranges without references, and points beyond all of them, look to the other ranges."""
    rng = random.Random(2)
    points = [(g, rng.randint(0, 3000)) for g in (1, 2) for _ in range(200)]
    refs = [(g, rng.choice([rng.randint(0, 200), rng.randint(1500, 1600)]), f"n{rng.randint(0, 9)}") for g in (1, 2) for _ in range(150)]
    out = joins.nearest_size(spark.createDataFrame(points, "g int, size int"), spark.createDataFrame(refs, "g int, size int, name string"), ["g"], "size", ["name"]).collect()
    want = sorted((g, s, *min(((r, n) for h, r, n in refs if h == g), key=lambda x: (abs(x[0] - s), x[0], x[1]))) for g, s in points)
    assert sorted(tuple(r) for r in out) == want


def test_representatives(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 5), k) for g in "ab" for k in range(rng.randint(30, 60))]
    out = windows.representatives(spark.createDataFrame(rows, "g string, size int, key int"), ["g"], "size", "key", [0, 5, 50, 95, 100]).collect()
    for g in "ab":
        own = sorted((s, k) for h, s, k in rows if h == g)
        assert {r.percentile: (r["size"], r["key"]) for r in out if r.g == g} == {p: own[min(len(own) * p // 100, len(own) - 1)] for p in (0, 5, 50, 95, 100)}


def test_run_scan(spark):
    paths = ["rs_444_j40/images/x.png", "j45/manifest.json", "odd/compress/a", "plain/readme", "top.txt", "rs_444_j40/compress/b"]
    out = {r.run: r for r in runs.scan_runs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert {k: r.run_kind for k, r in out.items()} == {"rs_444_j40": "grid_uniform", "j45": "uniform", "odd": "unknown"}
    assert out["rs_444_j40"].has_images and out["rs_444_j40"].has_compress and not out["j45"].has_images
