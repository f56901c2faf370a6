"""Language-model scores by subword lattices.

Every word has a lattice over a public piece vocabulary (see lattice.py). The pieces' weights start from the vocabulary's own scores and are
re-estimated by expectation maximisation over the distinct words of the training documents; the marginal over all segmentations is the probability of a
word that was never seen. Unigram pieces alone score known words badly (2.4 decimal orders a token worse than word counts at sf0.1), so the lattice of a
word has one arc more, for the whole word: (c - d) / N of its training count c, with the discount d = n1 / (n1 + 2 n2); the mass that the
discounts leave, d V / N, goes to the paths of pieces. There is one such model for all training documents, and one for each language that `lang`
names, which gives half of that mass to the model of all; a document's probability is the sum over these models of their share times the product over its words and its end.
`lattice_score` is its log10 probability by paths of pieces alone, under the model of all documents.

Counts cover all training documents and stay distributed. The most frequent words, at most HEAD, are sent to the tasks; all other tokens meet
their counts in a join by word, and only words without a count need a lattice then. What a task holds is divided by the number of models, so
languages cost columns and time, but little memory: a row of piece weights each.

Cases: null text counts as empty (only its end); documents with a null id are training documents, those with a null language belong to the model of
all documents alone; without training documents N and V are 0 and scores come from the vocabulary's first weights; repeated rows count and are
scored each; counts that tie at the bound of the most frequent words are all in or all out; an empty table gives an empty result. Other columns are not
read, whatever their names. A text of many megabytes is read in one piece, some 20 bytes of memory a byte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import lattice
from tilewright.llm import textbatch as tb
from tilewright.llm.shared import held_out, stage_table

SPLIT = 5
ROUNDS = 3
HEAD = 1 << 18
FLUSH = 1 << 18
CHUNK = (2 << 20) - 1
#: Numbers of the frequent words that are sent to the tasks, at most.
HEAD_TERMS = 1 << 21
#: Numbers of a merged batch, at most.
BATCH_TERMS = 1 << 20
#: The share of the model of all documents.
POOLED = 0.1
#: Added to the expected count of every piece, so that none gets the probability 0.
FLOOR = 0.05
LN10 = math.log(10)


def word_counts(texts: DataFrame, models: int) -> DataFrame:
    """(word, c0, c1 ...) over columns text and model (null: none but the last): the lower-cased words and their counts in each model, the last of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int | None, Counter[bytes]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for model, found in seen.items():
                yield pa.record_batch([pa.array(found.keys(), pa.binary()), pa.array([model] * len(found), pa.int32()), pa.array(found.values(), pa.int64())], names=["word", "model", "n"])

        for batch in batches:
            for text, model in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lo, size = 0, len(text or b"")
                while lo < size:  # long texts in pieces that end in white space
                    hi = lo + CHUNK
                    while hi < size and text[hi] not in b" \t\n\r\x0b\x0c":
                        hi += 1
                    seen.setdefault(model, Counter()).update(text[lo:hi].lower().split())
                    lo = hi
                    if sum(map(len, seen.values())) > FLUSH:
                        yield from rows()
                        seen.clear()
        yield from rows()

    parts = texts.select("text", "model").mapInArrow(count, "word binary, model int, n bigint")
    each = [F.coalesce(F.sum(F.when(F.col("model") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(models - 1)]
    return parts.groupBy("word").agg(*each, F.sum("n").alias(f"c{models - 1}"))


def _merged(batches: Iterator[pa.RecordBatch], models: int) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, fewer for more models: words of one length are computed together, and small batches have few of each."""
    rows = min(1 << 17, BATCH_TERMS // models)
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _counts(batch: pa.RecordBatch, models: int) -> np.ndarray:
    return np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(models)])


def fit_pieces(words: DataFrame, models: int, folder: str | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Natural log weights, models by pieces, and of a word's end by model: EM over the distinct words of each."""
    vocab = lattice.vocabulary(folder)
    weights = np.tile(lattice.first_weights(vocab) + math.log(0.7), (models, 1))
    stop = np.full(models, math.log(0.3))
    size = weights.shape[1] + 1
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            own = lattice.vocabulary(folder)
            total = np.zeros((models, size))
            for batch in _merged(batches, models):
                seen = _counts(batch, models) > 0
                data, at = tb.raw(batch.column(0))
                for k in range(models):
                    use = np.flatnonzero(seen[k])
                    total[k, :-1] += lattice.expected_counts(own, weights[k], data, at[use], at[use + 1], np.ones(len(use)))
                    total[k, -1] += len(use)
            flat = total.reshape(-1)
            some = np.flatnonzero(flat)
            yield pa.record_batch([pa.array(some), pa.array(flat[some])], names=["piece", "e"])

        found = words.mapInArrow(expect, "piece bigint, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        total = np.zeros(models * size)
        total[found["piece"].to_numpy()] = found["e"].to_numpy()
        total = total.reshape(models, size)
        live = total[:, -1] > 0
        total[:, :-1] += FLOOR
        share = np.log(np.maximum(total, 1e-300) / total.sum(1, keepdims=True))
        weights, stop = np.where(live[:, None], share[:, :-1], weights), np.where(live, share[:, -1], stop)
    return weights, stop


class Mixture:
    """The numbers of all models but the counts of words."""

    def __init__(self, n: np.ndarray, v: np.ndarray, ends: np.ndarray, n1: np.ndarray, n2: np.ndarray, weights: np.ndarray, stop: np.ndarray):
        self.n, self.bottom = np.maximum(n, 1).astype(float), n[-1] + 0.5 * (v[-1] + 1)
        self.discount = np.clip(np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5), 0.05, 0.95)
        self.left = np.where(n > 0, self.discount * v / self.n, 1.0)
        self.weights, self.stop = weights, stop
        self.end_base = math.log10((ends[-1] + 0.5) / self.bottom)
        self.end = np.log10(np.where(ends > 0, (ends - self.discount) / self.n, 0.5))
        with np.errstate(divide="ignore"):
            share = np.append(ends[:-1] / max(ends[-1], 1) * (1 - POOLED), 0)
            share[-1] = 1 - share.sum()
            self.share = np.log10(share)

    def paths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folder: str | None) -> np.ndarray:
        """Natural log probabilities by paths of pieces, models by words."""
        return lattice.log_probabilities(lattice.vocabulary(folder), self.weights, data, starts, ends) + self.stop[:, None]

    def terms(self, counts: np.ndarray, paths: np.ndarray) -> np.ndarray:
        """log10 terms of words: of the base, of each model, and by paths alone."""
        add = lambda a, b: np.maximum(a, b) + np.log10(1 + 10 ** (np.minimum(a, b) - np.maximum(a, b)))
        path = paths / LN10
        with np.errstate(divide="ignore"):
            by_word = np.maximum(np.log10(np.maximum(counts - self.discount[:, None], 0) / self.n[:, None]), -1e300)
        pooled = add(by_word[-1], math.log10(self.left[-1]) + path[-1])
        rest = add(path[:-1], pooled) + math.log10(0.5) + np.log10(self.left[:-1])[:, None]
        both = np.vstack((add(by_word[:-1], rest), pooled))
        return np.vstack((np.log10((counts[-1:] + 0.5) / self.bottom), both, path[-1:]))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary_folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id), held_out(doc_id, SPLIT).alias("held_out"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    training = docs.where(~F.col("held_out"))
    names = [r.lang for r in training.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    models = len(names) + 1
    number = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names)), strict=True) for x in pair])[F.col("lang")] if names else F.expr("CAST(NULL AS INT)")
    training = training.withColumn("model", number)
    words = stage_table(word_counts(training, models), "words")
    every = range(models)
    ends = training.agg(*[F.count_if(F.col("model") == k) for k in every[:-1]], F.count("*")).first()
    sums = words.agg(*[f(F.col(f"c{k}")) for f in (lambda c: F.coalesce(F.sum(c), F.lit(0)), lambda c: F.count_if(c > 0), lambda c: F.count_if(c == 1), lambda c: F.count_if(c == 2)) for k in every]).first()
    ends = np.array(ends, np.int64)
    tokens, kinds, once, twice = np.array(sums, np.int64).reshape(4, models)
    n_all = int(tokens[-1] + ends[-1])
    mixture = Mixture(tokens + ends, kinds + (ends > 0), ends, once, twice, *fit_pieces(words, models, vocabulary_folder))

    # the smallest count that at most so many words reach
    most = min(HEAD, HEAD_TERMS // (models + 2))
    whole = f"c{models - 1}"
    histogram = words.where(F.col(whole) > 1).groupBy(whole).agg(F.count("*").alias("words")).orderBy(F.desc(whole)).limit(most).toArrow()
    held = np.cumsum(histogram["words"].to_numpy())
    inside = histogram[whole].to_numpy()[held <= most]
    least = int(inside.min()) if len(inside) else (1 << 62)
    top = words.where(F.col(whole) >= least).toArrow().combine_chunks()
    data, at = tb.raw(top["word"])
    hashes = tb.span_hashes(data, at[:-1], at[1:]).view(np.int64)
    order = np.argsort(hashes)
    counts = np.stack([top[f"c{k}"].to_numpy() for k in every])
    head_terms = mixture.terms(counts, mixture.paths(data, at[:-1], at[1:], vocabulary_folder))
    shared = spark.sparkContext.broadcast((hashes[order], head_terms[:, order], mixture))
    width = models + 2
    term_columns = [f"t{k}" for k in range(width)]

    schema = T.StructType(
        [T.StructField("row", T.LongType()), docs.schema[doc_id], docs.schema["held_out"], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")], *[T.StructField(c, T.DoubleType()) for c in term_columns], T.StructField("tail", T.ArrayType(T.BinaryType()))]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, own = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(2), CHUNK):
                found = tb.Words(data, at)
                n, text_of = hi - lo, found.text_of
                lower = tb.LOWER[data]
                mine = tb.span_hashes(lower, found.starts, found.ends).view(np.int64)
                distinct, of = np.unique(mine, return_inverse=True)
                place = np.minimum(np.searchsorted(hashes, distinct), max(len(hashes) - 1, 0))
                head = hashes[place] == distinct if len(hashes) else np.zeros(len(distinct), bool)
                tail = np.flatnonzero(~head[of])
                terms = []
                for k in range(width):
                    value = np.zeros(len(distinct))
                    value[head] = known[k, place[head]]
                    terms.append(pa.array(np.bincount(text_of, value[of], n) + (own.end_base, *own.end, own.end[-1])[k]))
                bounds = np.concatenate(([0], np.cumsum(np.bincount(text_of[tail], minlength=n)))).astype(np.int32)
                spans = _cut(lower, found.starts[tail], found.ends[tail])
                part = batch.slice(lo, n)
                yield pa.record_batch(
                    [pa.array(row + np.arange(n)), part.column(0), part.column(1), pa.array(found.counts + 1), pa.array(found.counts - np.diff(bounds) + int(ends[-1] > 0)), *terms, pa.ListArray.from_arrays(bounds, spans)], names=schema.names
                )
                row += n

    rows = stage_table(docs.mapInArrow(score, schema), "scored")
    tails = rows.select("row", F.explode("tail").alias("word"))
    term_schema = ", ".join(f"{c} double" for c in term_columns)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[2]
        for batch in _merged(batches, models):
            data, at = tb.raw(batch.column(0))
            terms = own.terms(_counts(batch, models), own.paths(data, at[:-1], at[1:], vocabulary_folder))
            yield pa.record_batch([batch.column(0), *map(pa.array, terms)], names=["word", *term_columns])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[2]
        for batch in _merged(batches, models):
            data, at = tb.raw(batch.column(1))
            terms = own.terms(np.zeros((models, len(at) - 1)), own.paths(data, at[:-1], at[1:], vocabulary_folder))
            yield pa.record_batch([batch.column(0), *map(pa.array, terms)], names=["row", *term_columns])

    met = stage_table(tails.join(words.where(F.col(whole) < least).mapInArrow(rare, f"word binary, {term_schema}"), "word", "left").withColumn("word", F.when(F.col("t0").isNull(), F.col("word"))), "tails")
    both = met.where(F.col("t0").isNotNull()).select("row", F.lit(1).alias("known"), *term_columns).unionByName(
        met.where(F.col("t0").isNull()).select("row", "word").mapInArrow(unseen, f"row bigint, {term_schema}").select("row", F.lit(0).alias("known"), *term_columns)
    )
    sums = both.groupBy("row").agg(F.sum("known").alias("more_known"), *[F.sum(c).alias(f"more_{c}") for c in term_columns])
    joined = rows.drop("tail").join(sums, "row", "left")
    whole_term = lambda k: F.col(f"t{k}") + F.coalesce(F.col(f"more_t{k}"), F.lit(0.0))
    used = [k for k in every if np.isfinite(mixture.share[k])]
    joined = joined.withColumns({f"m{k}": whole_term(1 + k) + float(mixture.share[k]) for k in used})
    best = F.greatest(*[F.col(f"m{k}") for k in used]) if len(used) > 1 else F.col(f"m{used[0]}")
    joined = joined.withColumn("best", best)
    return joined.select(
        doc_id, "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), whole_term(0).alias("base_score"),
        (F.col("best") + F.log10(sum((F.pow(F.lit(10.0), F.col(f"m{k}") - F.col("best")) for k in used), F.lit(0.0)))).alias("score"), whole_term(width - 1).alias("lattice_score"),
    )


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary array."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])
