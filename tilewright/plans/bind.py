"""The engine's tables, bound to the driver's: planes, tiles, requests, blobs and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalar import clamp
from tilewright.operators.tiles import with_family
from tilewright.plans.registry import Tables

SIDE = 8
KINDS = {"view": "baseline", "click": "cache_hit", "purchase": "generated", "error": "fallback", "signup": "residual_view"}


def planes(t: Tables) -> DataFrame:
    """(vec_id, label, px): 8 by 8 planes of bytes."""
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: clamp(F.floor(v.cast("double") * 255 + 128.5)).cast("int")).alias("px"))


PLANES_SQL = "planes AS (SELECT vec_id, label, list_transform(embedding, lambda v: greatest(0, least(255, floor(v::DOUBLE * 255 + 128.5)))::INTEGER) AS px FROM embeddings)"


def tiles(t: Tables) -> DataFrame:
    """(key, x, y, x2, y2, bytes, brand): a grid 64 wide."""
    out = t.part.select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 64).cast("int").alias("x"), F.floor(F.col("p_partkey") / 64).cast("int").alias("y"), F.col("p_size").alias("bytes"), F.col("p_brand").alias("brand"))
    return with_family(out)


TILES_SQL = "tiles AS (SELECT p_partkey AS key, (p_partkey % 64)::INTEGER AS x, (p_partkey // 64)::INTEGER AS y, ((p_partkey % 64)::INTEGER >> 2) AS x2, ((p_partkey // 64)::INTEGER >> 2) AS y2, p_size AS bytes, p_brand AS brand FROM part)"


def requests(t: Tables) -> DataFrame:
    """(event_id, ts, user_id, kind, ms)."""
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("kind"), F.floor("value").cast("bigint").alias("ms"))


REQUESTS_SQL = "requests AS (SELECT event_id, ts, user_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END AS kind, floor(value)::BIGINT AS ms FROM events)"


def blobs(t: Tables) -> DataFrame:
    """(id, level, bytes)."""
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("level"), F.octet_length("text").alias("bytes"))


BLOBS_SQL = "blobs AS (SELECT doc_id AS id, lang AS level, strlen(text)::INTEGER AS bytes FROM documents)"
