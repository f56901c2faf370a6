import datetime as dt

from pyspark.sql import functions as F

from tilewright.operators.codec import BUNDLE_HEAD
from tilewright.plans.registry import Tables
from tilewright.plans import bind
from tilewright.sources import containers, manifests, pyramids
from tilewright.streaming import telemetry


def test_pyramid_scan(spark, tmp_path):
    rows = [("s", 9, x, y, "jpg", bytearray(b"\xff\xd8" + bytes([x, y]))) for x in range(3) for y in range(2)] + [("s", 9, 0, 0, "webp", bytearray(b"RIFF"))]
    tiles = spark.createDataFrame(rows, "slide string, level int, x int, y int, ext string, data binary")
    assert pyramids.write_tiles(tiles, str(tmp_path)).first().n == 7
    (tmp_path / "s.dzi").write_text(pyramids.descriptor_text(128, 512, 300))
    (tmp_path / "s_files" / "notes").mkdir()
    (tmp_path / "s_files" / "notes" / "0_0.jpg").write_bytes(b"x")
    found = pyramids.scan_tiles(spark, str(tmp_path))
    assert found.count() == 7 and pyramids.preferred_tiles(found).where("x = 0 AND y = 0").first().ext == "jpg"
    slide = pyramids.discover(found, pyramids.scan_descriptors(spark, str(tmp_path))).first()
    assert (slide.tile_size, slide.l0, slide.l1, slide.l2, slide.width) == (128, 9, 8, 7, 512)
    back = pyramids.scan_tiles(spark, str(tmp_path), with_data=True).where("x = 2 AND y = 1").first()
    assert bytes(back.data) == b"\xff\xd8\x02\x01"


def test_family_tiles(spark):
    out = pyramids.family_tiles(spark.createDataFrame([("/a/1_2.pack",), ("/a/x.pack",)], "path string")).collect()
    assert len(out) == 20 and {(r.x >> (1 if r.level == "L1" else 2), r.y >> (1 if r.level == "L1" else 2)) for r in out} == {(1, 2)}


def test_pack_and_bundle_tables(spark, tmp_path):
    rows = [(x, y, kind, i, bytearray([x, y, kind, i] * (i + 1))) for x in range(2) for y in range(2) for kind, i in ((1, 0), (0, 3), (0, 1)) if (x, y) != (1, 1)]
    entries = spark.createDataFrame(rows, "x2 int, y2 int, level_kind int, idx_in_parent int, data binary")
    packs = containers.pack(entries).withColumn("slide", F.lit("s"))
    for r in packs.collect():
        (tmp_path / f"{r.x2}_{r.y2}.pack").write_bytes(bytes(r.pack))
    key = lambda df: sorted((r.x2, r.y2, r.level_kind, r.idx_in_parent, bytes(r.data)) for r in df.collect())
    assert key(containers.read_packs(spark, str(tmp_path))) == key(entries) == key(containers.unpack(packs))
    back = containers.read_bundle(containers.bundle(packs, 2, 2))
    assert {(r.x2, r.y2): bytes(r.pack) for r in back.collect()} == {(r.x2, r.y2): bytes(r.pack) for r in packs.collect()}
    assert {(r.x2, r.y2): r.offset for r in back.collect()} == {(r.x2, r.y2): r.offset for r in containers.bundle_layout(packs, 2).collect()}
    assert min(r.offset for r in back.collect()) == BUNDLE_HEAD.size
    baseline = spark.createDataFrame([(0, 0), (1, 0)], "x2 int, y2 int")
    assert [tuple(r) for r in containers.parents_to_decode(bundle_index=back, baseline=baseline).collect()] == [(0, 0), (1, 0)]


def test_summaries(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "summary.json").write_text('{"encoder": "webp",\n "l1q": 60, "tiles": [{"level": "L1", "tx": 1, "ty": 0, "residual_bytes": 9}]}')
    row = manifests.read_summaries(spark, str(tmp_path)).first()
    assert row.run == "run1" and row.encoder == "webp" and row.quality is None and row.tiles[0].residual_bytes == 9


def test_snapshots_as_a_stream(spark, tmp_path):
    requests = bind.requests(Tables(spark, "/root/testdata/sf0.001"))
    requests.repartition(3).write.parquet(str(tmp_path / "in"))
    kinds = list(bind.KINDS.values())
    stream = telemetry.watermarked(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in")))
    run = telemetry.snapshots(stream, "1 day", kinds).writeStream.outputMode("complete").format("memory").queryName("snaps").trigger(availableNow=True).start()
    run.awaitTermination(120)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(spark.table("snaps")) == order(telemetry.snapshots(requests, "1 day", kinds))


def test_residency_and_flight(spark):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", at(0)), ("a", at(299)), ("a", at(600)), ("b", at(0))], "k string, ts timestamp")
    assert sorted((r.k, r.requests, r.hits) for r in telemetry.residency(df, "k", "300 seconds").collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]
    spans = spark.createDataFrame([("x", 0, 10), ("x", 5, 15), ("x", 10, 12)], "g string, a long, b long")
    assert {r["at"]: r.running for r in telemetry.in_flight(spans, ["g"], "a", "b").collect()} == {0: 1, 5: 2, 10: 2, 12: 1, 15: 0}


def test_bounded_cache(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    keys = [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 4), ("a", 5), ("a", 400)]
    spark.createDataFrame([(k, at(s)) for k, s in keys], "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    run = telemetry.bounded_cache(stream, 2, 300, 1).writeStream.outputMode("append").format("memory").queryName("cache").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = [(r.key, r.hit) for r in spark.table("cache").orderBy("ts").collect()]
    assert got == [("a", False), ("b", False), ("a", True), ("c", False), ("b", False), ("a", False), ("a", False)]


def test_arrays_captures_and_images(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    from tilewright.sources import manifests

    run = tmp_path / "runs" / "j40"
    run.mkdir(parents=True)
    (run / "manifest.json").write_text('{"encoder": "x", "quality": 40}')
    field = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(run / "residual.npy", field)
    np.save(run / "mask.npy", np.array([True, False]))
    row = manifests.read_captures(spark, str(tmp_path / "runs")).first()
    assert row.run == "j40" and row.quality == 40 and [(a.name, a.shape, a["values"]) for a in row.arrays] == [("mask", [2], [1.0, 0.0]), ("residual", [2, 3], [0, 1, 2, 3, 4, 5])]
    px = np.array([[[255, 0, 1], [2, 3, 4]]], np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + px.tobytes())) + chunk(b"IEND", b"")
    (tmp_path / "one.png").write_bytes(png)
    got = manifests.read_images(spark, str(tmp_path / "one.png")).first()
    assert (got.w, got.h, got.px) == (2, 1, [255, 0, 1, 2, 3, 4])


def test_size_summaries(spark):
    import json

    from tilewright.operators import aggregates
    from tilewright.sources import manifests

    sizes = aggregates.size_statistics(spark.createDataFrame([("l2", v) for v in range(1, 101)], "kind string, v int"), ["kind"], "v")
    found = json.loads(manifests.size_summary(sizes, "kind").first().stats)
    assert found == {"count": 100, "total_bytes": 5050, "total_mb": "0.00", "avg": "50", "min": 1, "p5": 6, "p25": 26, "median": 51, "p75": 76, "p95": 96, "p99": 100, "max": 100}
