"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the n-grams of 4, 6 and 8 code points of the lower-cased text (8 hold a space and the stem of a word), present or not, in 2^20 hash
buckets. Counts of each class give the log-count ratio r of every bucket; the buckets that tell the classes apart best are kept, and a logistic
regression over r * presence is fitted on the driver (accelerated gradient steps, L2 penalty, rows in blocks). It is learned from a bounded sample of
labelled rows: PER_CLASS ids of each class, of which the driver gets only the kept buckets, two bytes each. Scoring covers every whole text.

Cases: null text counts as empty and gets the score of a text without features; null or other label values are not learned from; without any
label of a class, or with no documents, every score is the share of toxic labels (0.5 without labels); of buckets that tell equally much the smaller
numbers are kept; repeated rows get equal scores; an empty table gives an empty result. Other columns of both tables are not read, whatever their names.
Long texts are worked through in pieces, so memory doesn't grow with them beyond their own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textbatch as tb
from tilewright.llm.labelled import SPLIT, labelled_sample
from tilewright.llm.shared import held_out

SIZES = (4, 6, 8)
BITS = 20
PER_CLASS = 4000
FEATURES = 1 << 14
LEAST_DOCS = 4
PENALTY = 1.0
STEPS = 400
THRESHOLD = 0.7
#: Features of the rows that are worked through at once.
BLOCK = 1 << 20


#: Lower case of the code points of the basic plane, where it is one code point.
LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(1 << 16))], np.uint32)


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points, offsets of the texts in them)."""
    if not len(data) or data.max() < 0x80:
        return LOWER[data], at
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(tb.LEAD[data], dtype=np.int64)))[at]
    return np.where(points < len(LOWER), LOWER[np.minimum(points, len(LOWER) - 1)], points), bounds


def grams(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct n-gram of each text, sorted; with wanted, only of buckets that it marks."""
    if len(data) > tb.PIECE:  # one long text
        found, step = [], tb.PIECE // 4
        for lo in range(0, len(data), step):
            hi = min(len(data), lo + step + 4 * max(SIZES))
            lead = np.flatnonzero(tb.LEAD[data[lo : lo + 4]])
            lo += int(lead[0]) if len(lead) else 0
            while hi < len(data) and not tb.LEAD[data[hi]]:
                hi += 1
            found.append(_grams(data[lo:hi], np.array([0, hi - lo]), wanted)[1])
            found = [np.unique(np.concatenate(found))]
        return np.zeros(len(found[0]), np.int64), found[0]
    return _grams(data, at, wanted)


def _grams(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    low, at = code_points(data, at)
    n = len(low)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # code points from here to the text's end
    own = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    found = []
    key = low.astype(np.uint64)
    for size in range(2, max(SIZES) + 1):
        key = key[:-1] if len(key) else key
        if not len(key):
            break
        key = key * np.uint64(0xD6E8FEB86659FD93) + low[size - 1 :]
        if size in SIZES:
            bucket = ((key ^ (key >> np.uint64(29))) + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
            use = left[: len(key)] >= size
            if wanted is not None:
                use &= wanted[bucket]
            use = np.flatnonzero(use)
            found.append((own[use] << np.uint64(BITS)) | bucket[use])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of all buckets; ratio times coefficient
    wanted: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        text, bucket = grams(data, at, self.wanted)
        total = np.bincount(text, self.weights[bucket], len(at) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _class_counts(sample: DataFrame) -> DataFrame:
    """(bucket, docs of class 0 and 1 that have it) over the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in tb.chunks(batch.column(0)):
                text, bucket = grams(data, at)
                np.add.at(sums.reshape(-1), label[lo:hi][text] * (1 << BITS) + bucket, 1)
        some = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["bucket", "n0", "n1"])

    return sample.select("text", "label").mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit_logistic(bounds: np.ndarray, index: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a weighted, L2-penalised logistic regression. Row k has the features index[bounds[k]:bounds[k + 1]], feature j with the
    value scale[j]. Rows are worked through in blocks of BLOCK features, so only index itself is held whole."""
    size, n = len(scale), len(y)
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], BLOCK), side="right") - 1, n))
    blocks = [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def look(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Loss and gradient."""
        loss, grad, of_b = PENALTY / 2 * float(w @ w), PENALTY * w, 0.0
        scaled = w * scale
        for lo, hi in blocks:
            own = index[bounds[lo] : bounds[hi]]
            rows = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
            z = np.bincount(rows, scaled[own], hi - lo) + b
            loss += float((weight[lo:hi] * (np.logaddexp(0, z) - y[lo:hi] * z)).sum())
            g = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[lo:hi])
            grad = grad + np.bincount(own, g[rows], size) * scale
            of_b += float(g.sum())
        return loss, grad, of_b

    # rows share few features, so a step well over the bound of the curvature mostly works; one that raises the loss is halved below
    norm = max((np.add.reduceat(np.append(scale[index[bounds[lo] : bounds[hi]]] ** 2, 0), bounds[lo:hi] - bounds[lo]).max() for lo, hi in blocks), default=0) + 1
    step = 1 / (0.0125 * norm * weight.sum() + PENALTY)
    w, b = np.zeros(size), float(np.log((weight[y == 1].sum()) / (weight[y == 0].sum())))
    look_w, look_b, before = w, b, np.inf
    momentum = 1.0
    for _ in range(STEPS):
        loss, grad, of_b = look(look_w, look_b)
        if loss > before:
            step, momentum = step / 2, 1.0
            look_w, look_b, before = w, b, np.inf
            continue
        before = loss
        new_w, new_b = look_w - step * grad, look_b - step * of_b
        new = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        look_w, look_b = new_w + (momentum - 1) / new * (new_w - w), new_b + (momentum - 1) / new * (new_b - b)
        w, b, momentum = new_w, new_b, new
    return w, b


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, target, per_class)
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", SPLIT))
    shares = {r.k: r.n for r in known.groupBy(F.col(target).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    flat = Model(np.zeros(1 << BITS), np.zeros(1 << BITS, bool), float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6)))))
    if not n0 or not n1:
        return flat
    drawn = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    d0, d1 = drawn.get(0, 0), drawn.get(1, 0)
    if not d0 or not d1:
        return flat
    # the kept buckets: those whose document shares differ most in log-likelihood ratio
    p, q = (F.col("n1") + 1) / (d1 + 2), (F.col("n0") + 1) / (d0 + 2)
    gain = (p - q) * F.log(p / q)
    kept = _class_counts(sample).where(F.col("n0") + F.col("n1") >= LEAST_DOCS).orderBy(gain.desc(), "bucket").limit(FEATURES).select("bucket", F.log(p / q).alias("r")).collect()
    buckets = np.array([r.bucket for r in kept], np.int64)
    ratio = np.array([r.r for r in kept])
    if not len(buckets):
        return flat
    wanted = np.zeros(1 << BITS, bool)
    wanted[buckets] = True
    position = np.zeros(1 << BITS, np.uint16)  # FEATURES are fewer than 2^16
    position[buckets] = np.arange(len(buckets))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(0)):
                text, bucket = grams(data, at, wanted)
                bounds = np.searchsorted(text, np.arange(hi - lo + 1))
                has = position[bucket].astype("<u2")
                yield pa.record_batch([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([has[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["label", "doc_id", "has"])

    rows = sample.select("text", "label", F.xxhash64("doc_id", "text").alias("doc_id")).mapInArrow(present, "label int, doc_id bigint, has binary").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    y = rows["label"].to_numpy().astype(float)[order]
    has = rows["has"].combine_chunks().take(pa.array(order))
    data, at = tb.raw(has)
    # both classes weigh alike: toxic texts are few, and a threshold of 0.7 would else miss those with few known words
    weight = np.where(y == 1, 0.5 / d1, 0.5 / d0) * (d0 + d1)
    w, b = fit_logistic((at - at[0]) // 2, data[at[0] : at[-1]].view("<u2"), ratio, y, weight)
    weights = np.zeros(1 << BITS)
    weights[buckets] = w * ratio
    return Model(weights, wanted, b)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, per_class=per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2^20 weights
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(2)):
                found = shared.value.scores(data, at)
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns[:2], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", held_out("doc_id", SPLIT).alias("held_out"), "text").mapInArrow(score, schema)
