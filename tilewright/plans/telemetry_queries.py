"""Queries over requests: counters, quantiles, snapshots, cache sessions and load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import aggregates as agg
from tilewright.plans import bind
from tilewright.plans.bind import KINDS, REQUESTS_SQL
from tilewright.plans.registry import Tables, query
from tilewright.streaming import telemetry

_KINDS = list(KINDS.values())
_EACH = ", ".join(f"count(*) FILTER (kind = '{k}') AS tile_{k}" for k in _KINDS)
_COUNTERS = f"count(*) AS tile_total, {_EACH}, sum(ms)::BIGINT AS tile_ms_sum, max(ms)::BIGINT AS tile_ms_max, floor(sum(ms) / count(*))::BIGINT AS tile_ms_avg"


@query(f"WITH {REQUESTS_SQL} SELECT date_trunc('day', ts)::DATE AS day, {_COUNTERS} FROM requests GROUP BY 1")
def request_kind_counters(t: Tables) -> DataFrame:
    return agg.request_counters(bind.requests(t), [F.to_date("ts").alias("day")], _KINDS)


@query(f"""WITH {REQUESTS_SQL} SELECT user_id % 10 AS run, count(*) AS family_generated, sum(ms)::BIGINT AS family_ms_sum, max(ms)::BIGINT AS family_ms_max, floor(sum(ms) / count(*))::BIGINT AS family_ms_avg FROM requests WHERE kind = 'generated' GROUP BY 1""")
def family_kind_counters(t: Tables) -> DataFrame:
    return agg.family_counters(bind.requests(t).where("kind = 'generated'"), [(F.col("user_id") % 10).alias("run")])


@query(f"""WITH r AS (SELECT requests.*, value FROM (WITH {REQUESTS_SQL} SELECT * FROM requests) requests JOIN events USING (event_id)) SELECT user_id % 10 AS run, count(*) AS tile_total, {_EACH}, round(sum(floor(value * 1000))::BIGINT / count(*) / 1000.0::DOUBLE, 9) AS tile_avg_ms, max(floor(value * 1000))::BIGINT / 1000.0::DOUBLE AS tile_max_ms FROM r GROUP BY 1""")
def fractional_kind_counters(t: Tables) -> DataFrame:
    own = bind.requests(t).join(t.events.select("event_id", "value"), "event_id")
    out = agg.fractional_counters(own, [(F.col("user_id") % 10).alias("run")], _KINDS, ms="value")
    return out.withColumn("tile_avg_ms", F.round("tile_avg_ms", 9))


@query(f"WITH {REQUESTS_SQL} SELECT epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT AS start, {_COUNTERS} FROM requests GROUP BY 1")
def metrics_tumbling_30m(t: Tables) -> DataFrame:
    return telemetry.snapshots(bind.requests(t), "30 minutes", _KINDS).withColumn("start", F.unix_timestamp("start"))


@query(f"""WITH {REQUESTS_SQL}, m AS (SELECT user_id % 100 AS k, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 100 ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM requests),
s AS (SELECT *, sum(first) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT k, floor(epoch(min(ts)))::BIGINT AS "start", floor(epoch(max(ts)))::BIGINT + 21600 AS "end", count(*) AS requests, count(*) - 1 AS hits FROM s GROUP BY k, g""")
def cache_residency_sessions(t: Tables) -> DataFrame:
    out = telemetry.residency(bind.requests(t).withColumn("k", F.col("user_id") % 100), "k", "6 hours")
    return out.withColumns({"start": F.unix_timestamp("start"), "end": F.unix_timestamp("end")})


@query(f"""WITH {REQUESTS_SQL}, s AS (SELECT kind, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + ms * 60 AS b FROM requests WHERE ms >= 0), d AS (SELECT kind, a AS "at", 1 AS d FROM s UNION ALL SELECT kind, b, -1 FROM s),
n AS (SELECT kind, "at", sum(d)::BIGINT AS d FROM d GROUP BY kind, "at") SELECT kind, "at", d, (sum(d) OVER (PARTITION BY kind ORDER BY "at"))::BIGINT AS running FROM n""")
def inflight_sweep(t: Tables) -> DataFrame:
    at = F.unix_timestamp("ts")
    return telemetry.in_flight(bind.requests(t).where("ms >= 0").select("kind", at.alias("a"), (at + F.col("ms") * 60).alias("b")), ["kind"], "a", "b")


@query(f"""WITH {REQUESTS_SQL} SELECT kind, {", ".join(f"round(quantile_cont(ms, {p / 100}), 9) AS p{p}" for p in (50, 95, 99))} FROM requests GROUP BY kind""")
def latency_quantile_linear(t: Tables) -> DataFrame:
    counts = agg.value_counts(bind.requests(t), ["kind"], "ms")
    return counts.groupBy("kind").agg(*[F.round(agg.linear(p).cast("double"), 9).alias(f"p{p}") for p in (50, 95, 99)])


@query(f"""WITH {REQUESTS_SQL}, r AS (SELECT kind, ms, row_number() OVER (PARTITION BY kind ORDER BY ms) AS k, count(*) OVER (PARTITION BY kind) AS n FROM requests)
SELECT kind, {", ".join(f"round(CASE WHEN max(n) <= {20 if p <= 95 else 100} THEN max(ms) ELSE max(CASE WHEN k = greatest(1, least({p} * (n + 1) // 100, n - 1)) THEN ms END) + (max(CASE WHEN k = greatest(1, least({p} * (n + 1) // 100, n - 1)) + 1 THEN ms END) - max(CASE WHEN k = greatest(1, least({p} * (n + 1) // 100, n - 1)) THEN ms END)) * max(({p} * (n + 1)) % 100) / 100 END, 9)::DOUBLE AS p{p}" for p in (95, 99))} FROM r GROUP BY kind""")
def latency_quantile_exclusive(t: Tables) -> DataFrame:
    counts = agg.value_counts(bind.requests(t), ["kind"], "ms")
    return counts.groupBy("kind").agg(*[F.round(agg.exclusive(p).cast("double"), 9).alias(f"p{p}") for p in (95, 99)])


@query(f"""WITH {REQUESTS_SQL} SELECT user_id % 10 AS run, count(*) FILTER (kind <> 'fallback') AS ok, count(*) FILTER (kind = 'fallback') AS failed, round(avg(ms) FILTER (kind <> 'fallback'), 6) AS mean_ms, round(count(*) FILTER (kind <> 'fallback') / 2592000.0, 9)::DOUBLE AS per_second FROM requests GROUP BY 1""")
def load_summary(t: Tables) -> DataFrame:
    good = F.col("kind") != "fallback"
    return bind.requests(t).groupBy((F.col("user_id") % 10).alias("run")).agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.round(F.avg(F.when(good, F.col("ms"))), 6).alias("mean_ms"), F.round(F.count_if(good) / 2592000.0, 9).alias("per_second"))


@query(f"""WITH {REQUESTS_SQL} SELECT coalesce(kind, 'all') AS stage, count(*) AS samples, round(avg(ms), 6) AS mean, max(ms)::BIGINT AS peak FROM requests GROUP BY ROLLUP (kind)""")
def gauge_summary(t: Tables) -> DataFrame:
    """Samples of a gauge by stage, and over all."""
    return agg.with_totals(bind.requests(t).withColumnRenamed("kind", "stage"), "stage", {"samples": F.count("*"), "mean": F.round(F.avg("ms"), 6), "peak": F.max("ms")})


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') AS folder FROM events""")
def timestamp_labels(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("folder"))


@query("""SELECT conv_id, turn, role, strlen(text)::INTEGER AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations""")
def capture_event_log(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.conversations.select("conv_id", "turn", "role", F.octet_length("text").alias("bytes"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("ordinal"))


@query(f"""WITH {REQUESTS_SQL}, m AS (SELECT (user_id % 100) >> 2 AS family, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY (user_id % 100) >> 2 ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first FROM requests),
s AS (SELECT *, sum(first) OVER (PARTITION BY family ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT family, count(*) AS sessions, sum(n)::BIGINT AS requests, sum(n - 1)::BIGINT AS hits FROM (SELECT family, g, count(*) AS n FROM s GROUP BY family, g) GROUP BY family""")
def family_residency(t: Tables) -> DataFrame:
    """A miss fills a whole family, so sessions are kept by family."""
    keyed = bind.requests(t).withColumn("family", F.shiftright(F.col("user_id") % 100, 2))
    return telemetry.residency(keyed, "family", "1 hour").groupBy("family").agg(F.count("*").alias("sessions"), F.sum("requests").alias("requests"), F.sum("hits").alias("hits"))


@query(f"""WITH {REQUESTS_SQL} SELECT event_id, (user_id * 4 + i)::BIGINT AS child, i::INTEGER AS idx FROM requests, range(0, 4) r(i) WHERE kind = 'baseline'""")
def prewarm_events(t: Tables) -> DataFrame:
    """A baseline request announces the tiles under it."""
    own = bind.requests(t).where("kind = 'baseline'").select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    return own.select("event_id", (F.col("user_id") * 4 + F.col("idx")).cast("bigint").alias("child"), "idx")
