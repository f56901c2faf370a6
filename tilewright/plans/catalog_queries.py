"""Queries over tiles, families, runs and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import aggregates as agg
from tilewright.operators import joins, runs, tiles, windows
from tilewright.plans import bind
from tilewright.plans.bind import BLOBS_SQL, TILES_SQL
from tilewright.plans.registry import Tables, query


@query(f"""WITH {BLOBS_SQL}, r AS (SELECT level, bytes, row_number() OVER (PARTITION BY level ORDER BY bytes) - 1 AS k, count(*) OVER (PARTITION BY level) AS n FROM blobs WHERE bytes IS NOT NULL)
SELECT level, count(*) AS count, sum(bytes)::BIGINT AS total_bytes, round(sum(bytes) / 1048576, 2) AS total_mb, round_even(sum(bytes) / count(*), 0)::BIGINT AS avg, min(bytes) AS min,
{", ".join(f"max(CASE WHEN k = least((n * {p}) // 100, n - 1) THEN bytes END) AS {a}" for p, a in ((5, "p5"), (25, "p25"), (50, "median"), (75, "p75"), (95, "p95"), (99, "p99")))}, max(bytes) AS max
FROM r GROUP BY level""")
def blob_size_stats(t: Tables) -> DataFrame:
    return agg.size_statistics(bind.blobs(t), ["level"], "bytes")


@query(f"""WITH {TILES_SQL} SELECT x2, y2, count(*) AS n_tiles, sum(bytes)::BIGINT AS bytes, min(bytes) AS least, max(bytes) AS most, round(avg(bytes), 6) AS mean FROM tiles GROUP BY x2, y2""")
def family_rollup(t: Tables) -> DataFrame:
    own = bind.tiles(t)
    return own.groupBy("x2", "y2").agg(F.count("*").alias("n_tiles"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.round(F.avg("bytes"), 6).alias("mean"))


@query(f"""WITH {TILES_SQL}, leveled AS (SELECT key, x, y, (key % 6)::INTEGER AS level FROM tiles)
SELECT key, level, CASE WHEN level <= 2 THEN 'baseline' WHEN level = 3 THEN 'L1' WHEN level = 4 THEN 'L0' ELSE 'error' END AS kind,
CASE level WHEN 3 THEN x >> 1 WHEN 4 THEN x >> 2 END AS fx, CASE level WHEN 3 THEN y >> 1 WHEN 4 THEN y >> 2 END AS fy FROM leveled""")
def level_routing(t: Tables) -> DataFrame:
    own = bind.tiles(t).withColumn("level", (F.col("key") % 6).cast("int"))
    kind, fx, fy = tiles.route(F.col("level"), F.col("x"), F.col("y"), 2)
    return own.select("key", "level", kind.alias("kind"), fx.alias("fx"), fy.alias("fy"))


@query(f"""WITH {TILES_SQL} SELECT p.x2, p.y2, (p.x2 * 4 + i % 4)::INTEGER AS x, (p.y2 * 4 + i // 4)::INTEGER AS y, i::INTEGER AS idx FROM (SELECT DISTINCT x2, y2 FROM tiles) p, range(0, 16) r(i)""")
def child_grid(t: Tables) -> DataFrame:
    return tiles.children(bind.tiles(t).select("x2", "y2").distinct(), 2)


@query(f"""WITH {TILES_SQL} SELECT key, x >> 1 AS x1, y >> 1 AS y1, (y % 2) * 2 + x % 2 AS idx1, (y % 4) * 4 + x % 4 AS idx2 FROM tiles""")
def child_index(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return bind.tiles(t).select("key", tiles.parent(x).alias("x1"), tiles.parent(y).alias("y1"), tiles.child_index(x, y, 1).alias("idx1"), tiles.child_index(x, y, 2).alias("idx2"))


@query(f"WITH {TILES_SQL} SELECT DISTINCT x2, y2 FROM tiles ORDER BY x2, y2 LIMIT 20")
def parent_limit_xy(t: Tables) -> DataFrame:
    return tiles.first_parents(bind.tiles(t), 20, row_major=False)


@query(f"WITH {TILES_SQL} SELECT DISTINCT x2, y2 FROM tiles ORDER BY y2, x2 LIMIT 20")
def parent_limit_rowmajor(t: Tables) -> DataFrame:
    return tiles.first_parents(bind.tiles(t), 20, row_major=True)


@query(f"WITH {TILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY x2, y2 ORDER BY md5('7:' || key), key) AS k FROM tiles) SELECT x2, y2, key FROM r WHERE k = 1")
def one_per_family(t: Tables) -> DataFrame:
    return tiles.one_per_family(bind.tiles(t), 7, ["key"])


@query(f"WITH {TILES_SQL} SELECT key, x, y FROM tiles ORDER BY md5('42:' || x || ':' || y), key LIMIT 50")
def seeded_sample(t: Tables) -> DataFrame:
    return bind.tiles(t).orderBy(F.md5(F.concat_ws(":", F.lit("42"), "x", "y")), "key").limit(50).select("key", "x", "y")


@query(f"WITH {TILES_SQL} SELECT x2, y2, count(*) AS tiles, count(*) FILTER (bytes < 25) AS empty_tiles, count(*) FILTER (bytes < 25) = count(*) AS all_empty, count(*) < 16 AS is_partial FROM tiles GROUP BY x2, y2")
def family_coverage(t: Tables) -> DataFrame:
    return tiles.family_coverage(bind.tiles(t), 16, F.col("bytes") < 25)


@query(f"WITH {TILES_SQL} SELECT x2, y2, count(*) AS n, string_agg(((y % 4) * 4 + x % 4) || ':' || bytes, ',' ORDER BY (y % 4) * 4 + x % 4) AS entries FROM tiles GROUP BY x2, y2")
def family_entries(t: Tables) -> DataFrame:
    own = bind.tiles(t).withColumn("idx", tiles.child_index(F.col("x"), F.col("y"), 2))
    listed = F.array_sort(F.collect_list(F.struct("idx", "bytes")))
    return own.groupBy("x2", "y2").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda e: F.concat_ws(":", e["idx"], e["bytes"])), ",").alias("entries"))


_SOLD = "SELECT l_partkey AS key, max(l_quantity)::INTEGER AS v FROM lineitem WHERE l_returnflag = '{}' AND l_linenumber = 1 GROUP BY l_partkey"


@query(f"""WITH {TILES_SQL}, pack AS ({_SOLD.format("R")}), loose AS ({_SOLD.format("A")}), base AS ({_SOLD.format("N")})
SELECT key, coalesce(pack.v, loose.v, base.v) AS value, CASE WHEN pack.v IS NOT NULL THEN 'pack' WHEN loose.v IS NOT NULL THEN 'loose' WHEN base.v IS NOT NULL THEN 'baseline' ELSE 'missing' END AS found_in
FROM tiles LEFT JOIN pack USING (key) LEFT JOIN loose USING (key) LEFT JOIN base USING (key)""")
def residual_lookup_fallback(t: Tables) -> DataFrame:
    """Each tile's residual from the first source that has one; first lines of orders, by their return flag, stand for the sources."""
    sold = lambda flag: t.lineitem.where((F.col("l_returnflag") == flag) & (F.col("l_linenumber") == 1)).groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").cast("int").alias("v"))
    return joins.first_available(bind.tiles(t).select("key"), ["key"], [("pack", sold("R"), "v"), ("loose", sold("A"), "v"), ("baseline", sold("N"), "v")])


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def exists_semi(t: Tables) -> DataFrame:
    return joins.present(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(t: Tables) -> DataFrame:
    return joins.missing(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query(f"""WITH {TILES_SQL}, parents AS (SELECT x2, y2, sum(bytes)::BIGINT AS parent_bytes FROM tiles GROUP BY x2, y2) SELECT key, x2, y2, bytes, parent_bytes FROM tiles JOIN parents USING (x2, y2)""")
def tile_parent_join(t: Tables) -> DataFrame:
    own = bind.tiles(t)
    return joins.to_parents(own, own.groupBy("x2", "y2").agg(F.sum("bytes").alias("parent_bytes")), ["x2", "y2"]).select("key", "x2", "y2", "bytes", "parent_bytes")


#: All qualities of the curves.
QUALITIES = list(range(1, 51))


def _curve(t: Tables) -> DataFrame:
    """(series, quality, size, gain): sizes in whole cents, so that sums are exact."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series"), F.col("l_quantity").cast("int").alias("quality")).agg(
        F.sum(price).alias("size"), F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("gain")
    )


CURVE_SQL = "curve AS (SELECT l_returnflag || l_linestatus AS series, l_quantity::INTEGER AS quality, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS size, count(*) AS n, sum(round(l_discount * 100)::BIGINT)::BIGINT AS gain FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {CURVE_SQL}, best AS (SELECT series, size, max(gain) AS gain FROM curve GROUP BY series, size)
SELECT series, size, gain FROM (SELECT *, max(gain) OVER (PARTITION BY series ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM best) WHERE gain > coalesce(b, -999)""")
def pareto_frontier(t: Tables) -> DataFrame:
    return windows.pareto_frontier(_curve(t), ["series"], "size", "gain")


@query(f"""WITH {CURVE_SQL}, s AS (SELECT series, quality, size, coalesce(size - lag(size) OVER (PARTITION BY series ORDER BY quality), 0) AS step FROM curve)
SELECT *, (sum(step) OVER (PARTITION BY series ORDER BY quality))::BIGINT AS cumulative FROM s""")
def marginal_cost(t: Tables) -> DataFrame:
    return windows.marginal_cost(_curve(t).select("series", "quality", "size"), ["series"], "quality", "size")


@query(f"WITH {CURVE_SQL}, p AS (SELECT series, (gain + lead(gain) OVER w) / 2 * (lead(quality) OVER w - quality) AS part FROM curve WINDOW w AS (PARTITION BY series ORDER BY quality)) SELECT series, coalesce(sum(part), 0)::DOUBLE AS area FROM p GROUP BY series")
def trapezoid_auc(t: Tables) -> DataFrame:
    return windows.trapezoid_area(_curve(t), ["series"], "quality", "gain")


@query(f"""WITH {CURVE_SQL}, n AS (SELECT series, quality, CASE WHEN max(gain) OVER w = min(gain) OVER w THEN 0 ELSE (gain - min(gain) OVER w) / (max(gain) OVER w - min(gain) OVER w) END AS g,
CASE WHEN max(size) OVER w = min(size) OVER w THEN 0 ELSE 1 - (size - min(size) OVER w) / (max(size) OVER w - min(size) OVER w) END AS s,
CASE WHEN max(1e6 / size) OVER w = min(1e6 / size) OVER w THEN 0 ELSE (1e6 / size - min(1e6 / size) OVER w) / (max(1e6 / size) OVER w - min(1e6 / size) OVER w) END AS r FROM (SELECT series, quality, gain, size::DOUBLE AS size FROM curve) WINDOW w AS (PARTITION BY series))
SELECT series, quality, round(0.6 * g + 0.4 * s, 9) AS balance, round(0.5 * g + 0.5 * r, 9) AS even FROM n""")
def balance_score(t: Tables) -> DataFrame:
    """Quality against size, and against the compression ratio (to a megabyte). A range of 0 scores 0 on either."""
    curve = _curve(t).select("series", "quality", "gain", "size", (1e6 / F.col("size").cast("double")).alias("ratio"))
    scored = windows.balance_scores(curve, ["series"], "gain", "size", "ratio")
    return scored.select("series", "quality", F.round("balance", 9).alias("balance"), F.round("even", 9).alias("even"))


@query(f"""WITH {CURVE_SQL}, r AS (SELECT series, quality, size, gain, row_number() OVER (PARTITION BY series ORDER BY gain DESC, quality) AS k FROM curve) SELECT series, quality, size, gain FROM r WHERE k = 1""")
def best_config(t: Tables) -> DataFrame:
    return agg.best_by(_curve(t), ["series"], F.col("gain"), ["quality"], ["quality", "size", "gain"])


@query(f"""WITH {CURVE_SQL}, r AS (SELECT series, quality, n, row_number() OVER (ORDER BY n DESC, series, quality) AS k FROM curve) SELECT series, quality, n FROM r WHERE k = 1""")
def peak_throughput(t: Tables) -> DataFrame:
    return agg.best_by(_curve(t).withColumn("all", F.lit(1)), ["all"], F.col("n"), ["series", "quality"], ["series", "quality", "n"]).drop("all")


@query(f"""WITH {CURVE_SQL}, j AS (SELECT series, quality, size FROM curve WHERE series LIKE '%O'), d AS (SELECT series, quality, size FROM curve WHERE series LIKE '%F'),
r AS (SELECT d.series, d.quality, d.size, j.size AS ref_size, j.quality AS ref_quality, row_number() OVER (PARTITION BY d.series, d.quality ORDER BY abs(d.size - j.size), j.size, j.quality) AS k FROM d, j)
SELECT series, quality, size, ref_size, ref_quality FROM r WHERE k = 1""")
def closest_size_match(t: Tables) -> DataFrame:
    curve = _curve(t).select("series", "quality", "size").withColumn("one", F.lit(1))  # one group; ranges of sizes are its tasks
    points, refs = curve.where("series LIKE '%F'"), curve.where("series LIKE '%O'")
    return joins.nearest_size(points, refs, ["one"], "size", ["quality"]).drop("one")


@query(f"""WITH {CURVE_SQL}, s AS (SELECT series, min(gain) AS a, max(gain) AS b FROM curve GROUP BY series), r AS (SELECT a AS ra, b AS rb FROM s WHERE series = 'NO')
SELECT series, CASE WHEN greatest(a, ra) < least(b, rb) THEN greatest(a, ra) END AS low, CASE WHEN greatest(a, ra) < least(b, rb) THEN least(b, rb) END AS high FROM s, r WHERE series <> 'NO'""")
def overlap_range(t: Tables) -> DataFrame:
    return joins.common_range(_curve(t), "series", "gain", "NO")


@query(f"""WITH {CURVE_SQL}, grid AS (SELECT s AS series, q::INTEGER AS quality FROM (VALUES ('AF'), ('NO'), ('XX')) a(s), (VALUES (10), (30), (70)) b(q)) SELECT series, quality, gain FROM grid LEFT JOIN curve USING (series, quality)""")
def run_grid_probe(t: Tables) -> DataFrame:
    return joins.grid_probe(_curve(t), {"series": ["AF", "NO", "XX"], "quality": [10, 30, 70]}, "gain")


@query(f"""WITH {CURVE_SQL} SELECT a.quality, a.gain AS value_a, b.gain AS value_b, b.gain - a.gain AS diff FROM curve a JOIN curve b USING (quality) WHERE a.series = 'AF' AND b.series = 'NO'""")
def run_compare(t: Tables) -> DataFrame:
    return joins.compare_runs(_curve(t), "series", "AF", "NO", ["quality"], "gain")


@query(f"""WITH {CURVE_SQL} SELECT series, {", ".join(f"max(CASE WHEN quality = {q} THEN gain END) AS q{q}" for q in QUALITIES)} FROM curve GROUP BY series""")
def metric_pivot(t: Tables) -> DataFrame:
    out = agg.pivot_metric(_curve(t), "series", "quality", QUALITIES, F.max("gain"))
    return out.withColumnsRenamed({str(q): f"q{q}" for q in QUALITIES})


@query(f"""WITH {CURVE_SQL} SELECT coalesce(series, 'all') AS series, count(*) AS points, sum(n)::BIGINT AS n, round(avg(gain), 6) AS mean_gain FROM curve GROUP BY ROLLUP (series)""")
def level_rollup_totals(t: Tables) -> DataFrame:
    return agg.with_totals(_curve(t), "series", {"points": F.count("*"), "n": F.sum("n"), "mean_gain": F.round(F.avg("gain"), 6)})


@query(f"""WITH {CURVE_SQL} SELECT quality, count(*) AS series, round(avg(size), 4) AS mean_size, round(avg(gain), 6) AS mean_gain FROM curve GROUP BY quality ORDER BY quality DESC""")
def method_quality_means(t: Tables) -> DataFrame:
    return _curve(t).groupBy("quality").agg(F.count("*").alias("series"), F.round(F.avg("size"), 4).alias("mean_size"), F.round(F.avg("gain"), 6).alias("mean_gain")).orderBy(F.desc("quality"))


@query(f"""WITH {CURVE_SQL} SELECT series, quality, round(CASE WHEN sum(n) OVER w = 0 THEN 0 ELSE 100.0 * n / sum(n) OVER w END, 9) AS share, max(n) OVER (PARTITION BY series ORDER BY quality) AS peak FROM curve WINDOW w AS (PARTITION BY series)""")
def stage_share_peak(t: Tables) -> DataFrame:
    out = agg.running_peak(agg.share_of_total(_curve(t), ["series"], "n"), ["series"], ["quality"], "n")
    return out.select("series", "quality", F.round("share", 9).alias("share"), "peak")


@query(f"""WITH {CURVE_SQL} SELECT series, least(min(gain), min(n)) AS bottleneck FROM curve GROUP BY series""")
def bottleneck(t: Tables) -> DataFrame:
    return _curve(t).groupBy("series").agg(F.least(F.min("gain"), F.min("n")).alias("bottleneck"))


@query(f"""WITH {BLOBS_SQL}, r AS (SELECT level, id, bytes, row_number() OVER (PARTITION BY level ORDER BY bytes, id) - 1 AS k, count(*) OVER (PARTITION BY level) AS n FROM blobs)
SELECT level, p::INTEGER AS percentile, id, bytes FROM r, (VALUES (5), (50), (95)) v(p) WHERE k = least((n * p) // 100, n - 1)""")
def size_representatives(t: Tables) -> DataFrame:
    return windows.representatives(bind.blobs(t), ["level"], "bytes", "id", [5, 50, 95])


@query(f"""WITH {TILES_SQL} SELECT y, key, bytes, (32 + coalesce(sum(bytes) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset FROM tiles""")
def pack_offsets(t: Tables) -> DataFrame:
    return windows.offsets(bind.tiles(t).select("y", "x", "key", "bytes"), ["y"], ["x"], "bytes", 32).drop("x")


@query(f"""WITH {BLOBS_SQL} SELECT level, count(*) AS blobs, sum(bytes)::BIGINT AS bytes, sum(CASE WHEN level <> 'en' THEN bytes ELSE 0 END)::BIGINT AS retained, round(sum(bytes) / 1048576, 6) AS mb, round(8 * sum(bytes) / count(*), 6) AS bits_each FROM blobs GROUP BY level""")
def doc_bytes_by_level(t: Tables) -> DataFrame:
    b = F.sum("bytes")
    return bind.blobs(t).groupBy("level").agg(F.count("*").alias("blobs"), b.alias("bytes"), F.sum(F.when(F.col("level") != "en", F.col("bytes")).otherwise(0)).alias("retained"), F.round(b / 1048576, 6).alias("mb"), F.round(8 * b / F.count("*"), 6).alias("bits_each"))


@query("""WITH f AS (SELECT doc_id, strlen(text) AS before, n_chars // 2 AS after FROM documents) SELECT doc_id, round(CASE WHEN after > 0 THEN before / after END, 9) AS ratio, round(CASE WHEN before > 0 THEN 100 * (1 - after / before) END, 9) AS savings FROM f""")
def ratio_savings(t: Tables) -> DataFrame:
    before, after = F.octet_length("text"), F.floor(F.col("n_chars") / 2)
    return t.documents.select("doc_id", F.round(scalar.ratio(before, after), 9).alias("ratio"), F.round(scalar.savings_percent(before, after), 9).alias("savings"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)/', 1) AS section, TRY_CAST(regexp_extract(url, '^[a-z]+://[^/?#]+/[a-z]+/([0-9]+)', 1) AS INTEGER) AS number FROM pages""")
def url_parse(t: Tables) -> DataFrame:
    u = F.col("url")
    part = lambda p: F.regexp_extract(u, p, 1)
    return t.pages.select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]+)").alias("host"), part("^[a-z]+://[^/?#]+/([a-z]+)/").alias("section"), part("^[a-z]+://[^/?#]+/[a-z]+/([0-9]+)").try_cast("int").alias("number"))


RUN_SQL = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'jpegli_jpeg_baseline_q' || p_size WHEN 1 THEN 'rs_444_optl2_d' || p_size || '_l1q60_l0q40' WHEN 2 THEN 'rs_420opt_b95_sharp' || p_size || '_l1q70_l0q' || p_size
WHEN 3 THEN 'debug_j' || p_size || '_s420_pac' WHEN 4 THEN 'gpu_420_b' || p_size || '_optl2_s0.5_l1q70_l0q60' ELSE 'other_' || p_size END AS name FROM part"""


@query(f"""WITH n AS ({RUN_SQL}), s AS (SELECT p_partkey, p_partkey % 6 AS k, p_size FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'jpeg_baseline' WHEN 1 THEN 'delta_sweep' WHEN 2 THEN 'sharpened' WHEN 3 THEN 'uniform' WHEN 4 THEN 'gpu' END AS run_kind, CASE k WHEN 0 THEN 'jpegli' WHEN 5 THEN NULL ELSE 'libjpeg-turbo' END AS encoder,
CASE WHEN k IN (0, 3) THEN p_size END AS quality, CASE k WHEN 1 THEN 60 WHEN 2 THEN 70 WHEN 4 THEN 70 END AS l1q, CASE k WHEN 1 THEN 40 WHEN 2 THEN p_size WHEN 4 THEN 60 END AS l0q, CASE k WHEN 1 THEN '444' WHEN 2 THEN '420opt' WHEN 3 THEN '420' WHEN 4 THEN '420' END AS sampling,
k IN (1, 4) AS optl2, CASE k WHEN 2 THEN 95 WHEN 4 THEN p_size END AS baseq, CASE WHEN k = 1 THEN p_size END AS delta, CASE WHEN k = 2 THEN p_size / 10.0::DOUBLE END AS sharp, CASE WHEN k = 4 THEN 0.5::DOUBLE END AS strength FROM s""")
def run_name_parse(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    name = (
        F.when(k == 0, F.concat(F.lit("jpegli_jpeg_baseline_q"), size)).when(k == 1, F.concat(F.lit("rs_444_optl2_d"), size, F.lit("_l1q60_l0q40"))).when(k == 2, F.concat(F.lit("rs_420opt_b95_sharp"), size, F.lit("_l1q70_l0q"), size))
        .when(k == 3, F.concat(F.lit("debug_j"), size, F.lit("_s420_pac"))).when(k == 4, F.concat(F.lit("gpu_420_b"), size, F.lit("_optl2_s0.5_l1q70_l0q60"))).otherwise(F.concat(F.lit("other_"), size))
    )
    named = t.part.select("p_partkey", name.alias("name"))
    return runs.with_run_fields(named, "name").select("p_partkey", "run_kind", *runs.FIELDS)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS q, CASE WHEN p_partkey % 3 > 0 THEN 60 + (p_partkey % 7)::INTEGER END AS j, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 64)::INTEGER END AS x, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 64)::INTEGER END AS y FROM part""")
def token_and_tile_names(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    folder = F.concat(F.lit("run"), F.lit("_q"), "p_size", F.when(key % 3 > 0, F.concat(F.lit("_j"), 60 + key % 7)).otherwise(""))
    tile = F.concat_ws("_", key % 64, F.floor(key / 64))
    q, j = runs.grid_tokens(folder)
    x, y = tiles.tile_coordinates(F.concat(tile, F.when(key % 2 == 0, ".jpg").otherwise(".png")))
    return t.part.select("p_partkey", q.alias("q"), j.alias("j"), x.alias("x"), y.alias("y"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'JPEG Q' || p_size WHEN 1 THEN 'Residual 95/' || p_size || '/40' WHEN 2 THEN 'Residual ' || p_size || '/0/0' WHEN 3 THEN 'Residual Q' || p_size ELSE p_name END AS label,
CASE p_partkey % 6 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 4096 + 77 WHEN 3 THEN p_size * 10 ELSE 0 END / 1048576 AS megabytes FROM part""")
def slide_labels(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    made = lambda text: F.replace(F.lit(text), F.lit("N"), size)
    summary = (
        F.when(k == 0, F.concat(F.lit('{"mode": "ingest-jpeg-only", "l1q": 7, "baseq": '), size, F.lit(', "total_bytes": '), (F.col("p_size") * 1024).cast("string"), F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"baseq": 95, "l0q": 40, "residual_bytes": 77, "l1q": '), size, F.lit(', "l2_bytes": '), (F.col("p_size") * 4096).cast("string"), F.lit("}")))
        .when(k == 2, made('{"baseq": N}')).when(k == 3, F.concat(made('{"residual_jpeg_q_L": N, "proposed_bytes": '), (F.col("p_size") * 10).cast("string"), F.lit("}"))).when(k == 4, "{}").otherwise("no json")
    )
    return t.part.select("p_partkey", runs.label(summary, F.col("p_name")).alias("label"), runs.disk_megabytes(summary).alias("megabytes"))


@query(f"""WITH {CURVE_SQL}, c AS (SELECT l_linestatus AS method, l_linenumber AS level, l_quantity::INTEGER AS quality, round(l_extendedprice * 100)::BIGINT AS size, l_discount FROM lineitem)
SELECT method, level, quality, count(*) AS tiles, round(avg(size), 4) AS mean_size, round(avg(round(l_discount * 100)::BIGINT), 6) AS mean_gain FROM c GROUP BY ALL""")
def method_level_quality_means(t: Tables) -> DataFrame:
    """Means by method, level and quality, each method's qualities in descending order."""
    own = t.lineitem.select(F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("level"), F.col("l_quantity").cast("int").alias("quality"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size"), F.round(F.col("l_discount") * 100).cast("bigint").alias("gain"))
    out = own.groupBy("method", "level", "quality").agg(F.count("*").alias("tiles"), F.round(F.avg("size"), 4).alias("mean_size"), F.round(F.avg("gain"), 6).alias("mean_gain"))
    return out.orderBy("method", "level", F.desc("quality"))


@query(f"""WITH {CURVE_SQL} SELECT series, count(*) AS points, string_agg(quality, ',' ORDER BY quality) AS qualities, string_agg(size, ',' ORDER BY quality) AS sizes, string_agg(gain, ',' ORDER BY quality) AS gains FROM curve GROUP BY series""")
def series_frames(t: Tables) -> DataFrame:
    """What a chart of each series needs: its qualities, sizes and gains in order."""
    points = F.array_sort(F.collect_list(F.struct("quality", "size", "gain")))
    held = _curve(t).groupBy("series").agg(F.count("*").alias("points"), points.alias("p"))
    return held.select("series", "points", *[F.array_join(F.col(f"p.{c}"), ",").alias(n) for c, n in (("quality", "qualities"), ("size", "sizes"), ("gain", "gains"))])


@query("""SELECT p_name AS label, p_partkey, p_size FROM part ORDER BY label, p_partkey LIMIT 30""")
def slides_by_label(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_name").alias("label"), "p_partkey", "p_size").orderBy("label", "p_partkey").limit(30)


@query(f"""WITH {TILES_SQL}, d AS (SELECT *, substr(md5('7:' || key), 1, 2) AS draw FROM tiles), l AS (SELECT key, x, y, CASE WHEN draw < 'b3' THEN 'L0' ELSE 'L1' END AS level, md5('8:' || key) AS o FROM d)
SELECT level, CASE level WHEN 'L0' THEN x ELSE x >> 1 END AS x, CASE level WHEN 'L0' THEN y ELSE y >> 1 END AS y FROM l ORDER BY o, key LIMIT 40""")
def level_preference_sample(t: Tables) -> DataFrame:
    return tiles.preferred_sample(bind.tiles(t), ["key"], 0.7, 40)


@query(f"""WITH {CURVE_SQL}, f AS (SELECT quality, {", ".join(f"max(CASE WHEN series = '{s}' THEN gain END) AS value_{k}" for k, s in enumerate(("AF", "NF", "NO", "RF")))} FROM curve GROUP BY quality) SELECT * FROM f WHERE value_0 IS NOT NULL AND value_1 IS NOT NULL AND value_2 IS NOT NULL AND value_3 IS NOT NULL""")
def run_compare_four(t: Tables) -> DataFrame:
    return joins.compare_many(_curve(t), "series", ["AF", "NF", "NO", "RF"], ["quality"], "gain")


@query("""WITH e AS (SELECT 'rs_444_j' || (page_id % 40) || '/images/' || page_id AS path FROM pages UNION ALL SELECT 'folder' || (page_id % 10) || CASE page_id % 3 WHEN 0 THEN '/compress/a' WHEN 1 THEN '/images' ELSE '/other' END FROM pages),
d AS (SELECT split_part(path, '/', 1) AS run, split_part(path, '/', 2) AS own FROM e), g AS (SELECT run, bool_or(own = 'images') AS has_images, bool_or(own = 'compress') AS has_compress, bool_or(own = 'decompress') AS has_decompress FROM d GROUP BY run)
SELECT run, CASE WHEN run LIKE 'rs%' THEN 'grid_uniform' ELSE 'unknown' END AS run_kind, CASE WHEN run LIKE 'rs%' THEN replace(run, 'rs_444_j', '')::INTEGER END AS quality, has_images, has_compress, has_decompress FROM g WHERE run LIKE 'rs%' OR has_images OR has_compress OR has_decompress""")
def run_directory_scan(t: Tables) -> DataFrame:
    k = F.col("page_id")
    one = t.pages.select(F.concat(F.lit("rs_444_j"), k % 40, F.lit("/images/"), k).alias("path"))
    two = t.pages.select(F.concat(F.lit("folder"), k % 10, F.when(k % 3 == 0, "/compress/a").when(k % 3 == 1, "/images").otherwise("/other")).alias("path"))
    return runs.scan_runs(one.unionByName(two)).select("run", "run_kind", "quality", "has_images", "has_compress", "has_decompress")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.label'), event_type) AS label FROM events""")
def json_props(t: Tables) -> DataFrame:
    get = lambda p: F.get_json_object("props", p)
    return t.events.select("event_id", get("$.k").try_cast("int").alias("k"), F.coalesce(get("$.label"), F.col("event_type")).alias("label"))


@query("""WITH s AS (SELECT p_partkey, p_size::BIGINT * 997 AS w, p_size::BIGINT * 331 AS h FROM part), m AS (SELECT *, CASE WHEN greatest(w, h) <= 1 THEN 0 ELSE ceil(log2(greatest(w, h)))::INTEGER END AS top FROM s)
SELECT p_partkey, top AS max_level, top AS l0, greatest(top - 1, 0) AS l1, greatest(top - 2, 0) AS l2, ((w + 1023) // 1024)::BIGINT AS cols, ((h + 1023) // 1024)::BIGINT AS rows FROM m""")
def pyramid_levels(t: Tables) -> DataFrame:
    w, h = F.col("p_size").cast("bigint") * 997, F.col("p_size").cast("bigint") * 331
    out = tiles.pyramid_levels(t.part.select("p_partkey", w.alias("w"), h.alias("h")), F.col("w"), F.col("h"))
    return out.select("p_partkey", "max_level", "l0", "l1", "l2", scalar.ceil_div(F.col("w"), 1024).alias("cols"), scalar.ceil_div(F.col("h"), 1024).alias("rows"))


@query("""WITH q AS (SELECT p_partkey, p_size * 2 AS q FROM part) SELECT p_partkey, q::INTEGER AS q, CASE WHEN q >= 100 THEN 1.0 WHEN q <= 1 THEN 100.0 ELSE greatest(1.0, round(105.0 * exp(-0.032 * q), 1)) END::DOUBLE AS rate_a, round(greatest(1.0, 500.0 * exp(-0.055 * q)), 9)::DOUBLE AS rate_b FROM q""")
def jp2_rate_maps(t: Tables) -> DataFrame:
    q = F.col("q")
    return t.part.select("p_partkey", (F.col("p_size") * 2).alias("q")).select("p_partkey", "q", scalar.jp2_rate_rounded(q).alias("rate_a"), F.round(scalar.jp2_rate_plain(q), 9).alias("rate_b"))


@query(f"""WITH q AS (SELECT DISTINCT p_size * 2 AS q FROM part), s AS (SELECT q, CASE WHEN least(q, 100) < 50 THEN 5000.0::DOUBLE / least(q, 100) ELSE 200.0::DOUBLE - 2 * least(q, 100) END AS s FROM q)
SELECT q::INTEGER AS q, array_to_string(list_transform({scalar.JPEG_LUMINANCE}, lambda v: greatest(1, least(255, floor((v * s + 50) / 100)))::INTEGER), ',') AS qtable FROM s""")
def jpeg_qtables(t: Tables) -> DataFrame:
    return t.part.select((F.col("p_size") * 2).alias("q")).distinct().select("q", F.array_join(scalar.jpeg_qtable(F.col("q")), ",").alias("qtable"))


@query(f"""WITH {TILES_SQL} SELECT DISTINCT x2, y2 FROM (SELECT x2, y2 FROM tiles WHERE bytes < 10 UNION ALL SELECT x2, y2 FROM tiles WHERE bytes > 45)""")
def parent_union(t: Tables) -> DataFrame:
    own = bind.tiles(t)
    return own.where("bytes < 10").select("x2", "y2").unionByName(own.where("bytes > 45").select("x2", "y2")).distinct()


@query("""SELECT l_orderkey, l_linenumber, l_quantity::INTEGER + 45 AS l1q, l_discount AS metric FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_quantity::INTEGER + 45 <= 90 AND l_discount IS NOT NULL AND starts_with(l_linestatus, 'F')""")
def metric_filters(t: Tables) -> DataFrame:
    """By method and least quality, a bound on a shifted quality, present metrics, and a prefix; all but the shifted bound reach the scan."""
    found = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30) & F.col("l_discount").isNotNull() & F.startswith("l_linestatus", F.lit("F")))
    return found.withColumn("l1q", F.col("l_quantity").cast("int") + 45).where("l1q <= 90").select("l_orderkey", "l_linenumber", "l1q", F.col("l_discount").alias("metric"))


@query(f"""WITH {TILES_SQL}, grid AS (SELECT x::INTEGER AS x, y::INTEGER AS y FROM range(0, 72) a(x), range(0, 8) b(y)) SELECT grid.x, grid.y, key, key IS NOT NULL AS found FROM grid LEFT JOIN tiles t ON t.x = grid.x AND t.y = grid.y""")
def tile_grid_flags(t: Tables) -> DataFrame:
    return joins.grid_probe(bind.tiles(t), {"x": list(range(72)), "y": list(range(8))}, "key").withColumn("found", F.col("key").isNotNull())


@query(f"""WITH {TILES_SQL}, l AS (SELECT y2, x2, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM tiles GROUP BY y2, x2) SELECT y2, count(*) AS levels, sum(bytes)::BIGINT AS bytes, string_agg(x2 || ':' || n || ':' || bytes, ',' ORDER BY x2) AS breakdown FROM l GROUP BY y2""")
def pyramid_breakdown(t: Tables) -> DataFrame:
    level = bind.tiles(t).groupBy("y2", "x2").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    listed = F.array_sort(F.collect_list(F.struct("x2", "n", "bytes")))
    return level.groupBy("y2").agg(F.count("*").alias("levels"), F.sum("bytes").alias("bytes"), F.array_join(F.transform(listed, lambda e: F.concat_ws(":", e["x2"], e["n"], e["bytes"])), ",").alias("breakdown"))


@query("""SELECT DISTINCT series, quality, source FROM (SELECT 'baseline' AS source, l_returnflag AS series, l_quantity::INTEGER AS quality FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT 'split', l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'O')""")
def series_union(t: Tables) -> DataFrame:
    own = lambda name, status, quality: t.lineitem.where(F.col("l_linestatus") == status).select(F.lit(name).alias("source"), F.col("l_returnflag").alias("series"), quality.cast("int").alias("quality"))
    return own("baseline", "F", F.col("l_quantity")).unionByName(own("split", "O", F.col("l_linenumber"))).distinct().select("series", "quality", "source")
