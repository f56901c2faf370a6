"""Serving telemetry: interval snapshots, cache residency and work in flight, each as a streaming plan and its batch twin.

Event times must be timestamps with a time zone for watermarks. Snapshots of intervals without requests don't exist, as windows are made by events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.operators.aggregates import request_counters


def snapshots(requests: DataFrame, every: str, kinds: list[str]) -> DataFrame:
    """Counters of each interval; the same plan serves batches and, after a watermark, streams."""
    out = request_counters(requests, [F.window("ts", every).alias("w")], kinds)
    return out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])


def watermarked(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def residency(requests: DataFrame, key: str, idle: str) -> DataFrame:
    """How long each key stays cached: sessions that end when more than `idle` passes without a request. The first request of a session misses."""
    out = requests.groupBy(F.session_window("ts", idle).alias("s"), key).agg(F.count("*").alias("requests"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "requests", (F.col("requests") - 1).alias("hits"))


#: Units of time (seconds, if instants are such) that one bucket of a running sum spans.
BUCKET = 3600


def in_flight(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Work in progress after each instant: starts and ends are netted per instant before the running sum.

    No group is one task: instants are cut into buckets of BUCKET units, whose sums are run first; within a bucket the sum goes on from there.
    """
    steps = spans.select(*by, F.col(start).alias("at"), F.lit(1).alias("d")).unionAll(spans.select(*by, F.col(end).alias("at"), F.lit(-1).alias("d")))
    net = steps.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    net = net.withColumn("bucket", F.floor(F.col("at").cast("double") / BUCKET))
    sums = net.groupBy(*by, "bucket").agg(F.sum("d").alias("total"))
    before = sums.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    own = F.sum("d").over(Window.partitionBy(*by, "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return net.withColumn("own", own).join(before, [*by, "bucket"]).select(*by, "at", "d", (F.col("before") + F.col("own")).alias("running"))


CACHE_OUT = "slot bigint, key string, ts timestamp, hit boolean, held bigint"
CACHE_STATE = "keys array<string>, seen array<double>"


def bounded_cache(requests: DataFrame, capacity: int, idle_seconds: float, slots: int) -> DataFrame:
    """Requests (key, ts) of a stream through caches with a bound and an idle time, least recently used out first; keys are dealt to slots by hash.

    State is one slot's keys, so it is bounded by capacity / slots. Rows of a micro-batch are taken in time order.
    """
    room = max(1, capacity // slots)

    def serve(slot: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "key"])
        out = []
        for key, ts in zip(rows["key"], rows["ts"], strict=True):
            now = ts.timestamp()
            while held and now - held[oldest := next(iter(held))] >= idle_seconds:  # in the order of their last requests
                del held[oldest]
            hit = key in held
            held.pop(key, None)
            held[key] = now
            if len(held) > room:
                held.pop(next(iter(held)))
            out.append((slot[0], key, ts, hit, len(held)))
        state.update((list(held), [float(t) for t in held.values()]))
        yield pd.DataFrame(out, columns=["slot", "key", "ts", "hit", "held"])

    dealt = requests.select(F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot"), "key", "ts")
    return dealt.groupBy("slot").applyInPandasWithState(serve, CACHE_OUT, CACHE_STATE, "append", GroupStateTimeout.NoTimeout)
