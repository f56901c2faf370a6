"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for vectorised traversal.

The statistics of a text come from one numpy pass over all of it. Trees are grown level by level on the driver from 64-bin histograms of a bounded
sample of labelled rows (PER_CLASS ids of each class; only their statistics reach the driver). The forest is five arrays: feature, threshold, left,
right and value of every node, leaves pointing at themselves; scoring moves all rows of a batch down all trees at once, one level a step.

Cases: null text counts as empty; labels other than 0 and 1 are not learned from; without labels of both classes every score is the share of label 1
(0.5 without labels); repeated rows get equal scores; of splits with equal gain the first feature and bin is taken; an empty table gives an empty
result; other columns of both tables are not read, whatever their names. A text of many megabytes is read in one piece, some 20 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import docstats, quality_rules
from tilewright.llm import textbatch as tb
from tilewright.llm.labelled import SPLIT, labelled_sample
from tilewright.llm.shared import held_out

PER_CLASS = 8000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_ROWS = 10
PENALTY = 1.0
THRESHOLD = 0.5

#: Function words of some languages, as a fixed statistic.
COMMON = {
    "en": "the of and to in a is that it for was on as with be by at this are or from an have not but which they you",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au pas plus avec il ce ne se sont aux ou",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei",
    "es": "de la que el en y a los se del las un por con una para es lo al no su como más o sus le ha me si",
}
LEXICON = quality_rules.Lexicon(list({w for text in COMMON.values() for w in text.split()}))

FEATURES = (
    "words", "chars", "word_length", "longest_word", "symbols", "repeats", "dup_lines", "lines", "words_per_line", "distinct_words", "common_words", "common_kinds",
    *(f"class_{c}" for c in quality_rules.CLASSES), "capital_words", "sentence_ends", "single_chars", "class_entropy", "exclamations",
)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; shares lie in 0 to 1, sizes are logarithms."""
    words = tb.Words(data, at)
    hashes = words.hashes()
    base = docstats.base_counts(words, hashes)
    chars, common = quality_rules.histograms(words, words.hashes(lower=True), LEXICON)
    n = words.n_texts
    n_words, n_chars = np.maximum(base["n_words"], 1), np.maximum(chars.sum(1), 1)
    text_of = words.text_of
    lengths = words.ends - words.starts
    longest = np.zeros(n)
    np.maximum.at(longest, text_of, lengths)
    starts, ends, line_text = tb.line_spans(data, at)
    some = ends > starts
    lines = np.maximum(np.bincount(line_text[some], minlength=n), 1)
    closing = np.isin(data[ends[some] - 1], np.frombuffer(b".!?:\"'", np.uint8))
    salt = tb.mix(np.arange(1, n + 1, dtype=np.uint64))
    keys, kept = np.unique(hashes ^ salt[text_of], return_index=True)
    first, last = data[words.starts], data[words.ends - 1] if len(words.ends) else data[:0]
    capital = (first >= 65) & (first <= 90)
    shares = chars / n_chars[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(shares > 0, shares * np.log2(shares), 0).sum(1)
    per_word = lambda mask: np.bincount(text_of, mask, n) / n_words
    out = [
        np.log1p(base["n_words"]), np.log1p(chars.sum(1)), base["word_chars"] / n_words, np.log1p(longest), base["n_symbols"] / n_chars, base["n_repeat_words"] / n_words,
        base["n_dup_lines"] / lines, np.log1p(lines), np.log1p(base["n_words"] / lines), np.bincount(text_of[kept], minlength=n) / n_words,
        common[:, 1:].sum(1) / n_words, (common[:, 1:] > 0).sum(1) / np.minimum(n_words, len(LEXICON.words)),
        *shares.T, per_word(capital), np.bincount(line_text[some], closing, n) / lines, per_word(lengths == 1), entropy, per_word(last == 33),
    ]
    return np.column_stack(out)


@dataclass
class Forest:
    """Nodes of all trees in one row of arrays; a leaf's children are the leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            node = np.tile(self.roots, (len(x), 1))
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                down = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    codes = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)  # code <= b means x <= cuts[b]
    prior = float((weight * y).sum() / weight.sum())
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for column, v in ((feature, 0), (threshold, 0.0), (left, k), (right, k), (value, 0.0)):
            column.append(v)
        return k

    z = np.full(n, base)
    offsets = np.arange(width) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        root = node()
        roots.append(root)
        where = np.full(n, root)
        level = [root]
        for depth in range(DEPTH + 1):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            at = slot[where]
            live = np.flatnonzero(at >= 0)
            sums = [np.bincount(at[live], v[live], len(level)) for v in (g, h)]
            for k, name in enumerate(level):
                value[name] = -RATE * sums[0][k] / (sums[1][k] + PENALTY)
            if depth == DEPTH or not len(live):
                break
            flat = (at[live, None] * (width * BINS) + offsets + codes[live]).reshape(-1)
            size = len(level) * width * BINS
            hist = [np.bincount(flat, np.repeat(v[live], width), size).reshape(len(level), width, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            total = [s[:, 0, -1][:, None, None] for s in hist]
            gain = sum((a * a) / (b + PENALTY) for a, b in ((hist[0], hist[1]), (total[0] - hist[0], total[1] - hist[1]))) - total[0] ** 2 / (total[1] + PENALTY)
            gain[(hist[2] < LEAST_ROWS) | (total[2] - hist[2] < LEAST_ROWS)] = -1
            below = []
            for k, name in enumerate(level):
                j, b = divmod(int(np.argmax(gain[k])), BINS)
                if gain[k, j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                a, c = node(), node()
                feature[name], threshold[name], left[name], right[name] = j, float(cuts[j][b]), a, c
                mine = live[at[live] == k]
                down = codes[mine, j] <= b
                where[mine[down]], where[mine[~down]] = a, c
                below += [a, c]
            level = below
            if not level:
                break
        z += np.array(value)[where]
    arrays = (np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))
    leaf = arrays[2] == np.arange(len(feature))
    arrays[4][~leaf] = 0.0
    return Forest(*arrays, np.array(roots), base)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS) -> Forest:
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", SPLIT))
    shares = {r.k: r.n for r in known.groupBy(F.col(target).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    empty = np.zeros(0, np.int64)
    flat = Forest(empty, empty.astype(float), empty, empty, empty.astype(float), empty, float(np.log(prior / (1 - prior))))
    if not n0 or not n1:
        return flat

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(0)):
                x = statistics(data, at)
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column(1), part.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "k", "x"])

    rows = labelled_sample(docs, labels, target, per_class).select("text", "label", F.xxhash64("doc_id", "text").alias("k")).mapInArrow(features, "label int, k bigint, x array<double>").toArrow().sort_by("k")
    y = rows["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return flat
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    drawn = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, n1 / drawn[1], n0 / drawn[0])
    return grow(x, y, weight * len(y) / weight.sum())


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    forest = fit(docs, labels, per_class=per_class)  # of fixed size: at most TREES * 2^(DEPTH + 1) nodes
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(2)):
                found = forest.scores(statistics(data, at))
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns[:2], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=schema.names)

    return docs.select("doc_id", held_out("doc_id", SPLIT).alias("held_out"), "text").mapInArrow(score, schema)
