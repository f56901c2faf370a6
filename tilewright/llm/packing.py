"""Lexical retrieval packing: documents into windows of tokens, neighbours chosen by BM25.

1. Every text is tokenised once; its ids are a table in the shared folder.
2. Document frequencies, the number of documents and their mean length are counted over all documents, so the weights of BM25 are those of the whole
   corpus. The driver gets one row per id of the vocabulary. Terms in more than half of all documents weigh nothing (the inverse document frequency of
   Robertson and Sparck Jones, which is negative there, ends at 0).
3. Documents are routed to the shards of the index by their rarest term that another document has too, wherever they are stored, so likely neighbours
   meet. A shard holds about SHARD_TOKENS tokens: terms of few documents share one, those of many are dealt over several (by row, not by content, so copies
   spread).
4. Each shard is an inverted index in memory: postings by token id with weights. A window starts with a seed document (the rest of a cut one, or the next
   unused one of the shard); all its terms are the query, and the best unused neighbours fill the window. One that fits whole is preferred, else the
   best is cut, and its rest seeds the next window. If nothing unused shares a weighing term with the seed, the next document of the shard is taken.
   A window that is open at a shard's end asks the next shard with the same query. Windows are full, so nothing is padded; what is left at the end of
   a partition goes into sequences whose lengths are powers of two.

Memory is bounded by a shard (a longer text is a shard of its own, as ids). Sequence ids hold the partition in the bits over 40.

Cases: null text counts as empty (one closing token); repeated rows are packed one by one, each with its own pieces; null ids pass through; an empty table
gives an empty result; ties in BM25 go to the earlier row of the shard. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textbatch as tb
from tilewright.llm.shared import free_name, stage_table

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CLOSING = 1
WINDOW = 2048
SHARD_TOKENS = 1 << 21
#: Best neighbours that one look into the index returns; when they are used up, it is asked again.
NEIGHBOURS = 8
#: Partitions that the shards are dealt to, at most.
MOST_PARTITIONS = 20_000
K1, B = 1.2, 0.75
#: Ids as they are stored; the vocabulary has fewer than 2^16.
STORED = np.dtype("<u2")


def _place(folder: str | None, name: str) -> str:
    import public_tokenizers

    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


@functools.cache
def _full(folder: str | None):
    """The vocabulary for its own library. Loaded only where it is needed, as each Python worker holds it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_place(folder, VOCABULARY))


@functools.cache
def _fast(folder: str | None):
    """(special tokens, the vocabulary as ranks). Both libraries give the same ids (tests hold them against each other); this one is some four times as fast."""
    import public_tokenizers
    import tiktoken

    with open(_place(folder, VOCABULARY), encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(_place(folder, RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return special, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, folder: str | None = None) -> np.ndarray:
    """The ids that the vocabulary's own library gives without special tokens added, then the closing id."""
    special, fast = _fast(folder)
    text = text or ""
    ids = _full(folder).encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
    ids.append(CLOSING)
    return np.array(ids, np.uint32)


class Corpus:
    """What BM25 needs of the whole corpus: documents, their mean length, and the frequency of each term."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0).astype(np.float32)

    @classmethod
    def of(cls, ids: list[np.ndarray]) -> Corpus:
        found = np.concatenate([np.unique(x) for x in ids])
        return cls(len(ids), float(np.mean([len(x) for x in ids])), np.bincount(found, minlength=1))


class Shard:
    """A BM25 inverted index over the documents of a shard, with the weights of the whole corpus."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus):
        n = self.n = len(ids)
        self.lengths = np.array([len(x) for x in ids], np.int64)
        wide = np.uint32 if n <= 1 << 16 else np.uint64  # a document's number over an id of 16 bits
        keys = np.repeat(np.arange(n, dtype=wide) << wide(16), self.lengths)
        keys |= np.concatenate(ids).astype(STORED)
        useful = (corpus.idf > 0) & (corpus.df > 1)
        keys = keys[useful[keys & wide(0xFFFF)]]
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(keys))).astype(np.int32)
        keys = keys[first]
        doc, term = (keys >> wide(16)).astype(np.int32), (keys & wide(0xFFFF)).astype(np.int32)
        del keys, first
        norm = K1 * (1 - B + B * self.lengths / corpus.mean)
        weight = (corpus.idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.doc_bounds, self.doc_terms = np.searchsorted(doc, np.arange(n + 1)), term
        order = np.argsort(term, kind="stable")
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(corpus.df)))))
        self.docs, self.weights = doc[order], weight[order]

    def terms(self, seed: int) -> np.ndarray:
        """The seed's terms that weigh something."""
        return self.doc_terms[self.doc_bounds[seed] : self.doc_bounds[seed + 1]]

    def neighbours(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """The NEIGHBOURS best unused documents for a query of terms, best first; only such that share a term."""
        spans = [slice(a, b) for a, b in zip(self.bounds[terms], self.bounds[terms + 1], strict=True) if b > a]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n) * unused
        if self.n > NEIGHBOURS:
            best = np.argpartition(-score, NEIGHBOURS - 1)[:NEIGHBOURS]
            best = np.flatnonzero(score >= score[best].min()) if score[best].min() > 0 else best  # ties go to the earlier row
            best.sort()
        else:
            best = np.arange(self.n)
        best = best[np.argsort(-score[best], kind="stable")][:NEIGHBOURS]
        return best[score[best] > 0]


class Packer:
    """Windows of one partition. take() gets shards; finish() closes what is open. Pieces: (row, start, ids, sequence, offset)."""

    def __init__(self, corpus: Corpus, window: int = WINDOW):
        self.corpus, self.window, self.sequence, self.used = corpus, window, 0, 0
        self.open: list[tuple[int, int, np.ndarray]] = []
        self.rest: tuple[int, int, np.ndarray] | None = None
        self.query: np.ndarray | None = None

    def _add(self, row: int, start: int, ids: np.ndarray, out: list) -> None:
        room = self.window - self.used
        piece = ids[:room]
        self.open.append((row, start, piece))
        self.used += len(piece)
        self.rest = (row, start + room, ids[room:]) if len(ids) > room else None
        if self.used == self.window:
            self._close(out)

    def _close(self, out: list) -> None:
        offset = 0
        for row, start, ids in self.open:
            out.append((row, start, ids, self.sequence, offset))
            offset += len(ids)
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def take(self, first_row: int, ids: list[np.ndarray], out: list) -> None:
        shard = Shard(ids, self.corpus)
        unused = np.ones(len(ids), np.float32)
        after = 0
        while True:
            if self.rest:  # its document seeds the window in which it ends
                self.query = shard.terms(self.rest[0] - first_row)
                while self.rest:
                    self._add(*self.rest, out)
            while after < len(ids) and not unused[after]:
                after += 1
            if after == len(ids):
                return
            if not self.used or self.query is None:
                self.query = shard.terms(after)
                unused[after] = 0
                self._add(first_row + after, 0, ids[after], out)
                continue
            near = shard.neighbours(self.query, unused)
            if not len(near):
                near = np.array([after])
            while len(near) and self.used and not self.rest:
                fits = near[shard.lengths[near] <= self.window - self.used]
                pick = int(fits[0]) if len(fits) else int(near[0])
                near = near[near != pick]
                unused[pick] = 0
                self._add(first_row + pick, 0, ids[pick], out)

    def finish(self, out: list) -> None:
        """The open window's ids in sequences of power-of-two lengths, the largest first."""
        pieces, left = self.open, self.used
        self.open, self.used = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while size:
                row, start, ids = pieces[0]
                part = ids[:size]
                self.open.append((row, start, part))
                size -= len(part)
                pieces = ([(row, start + len(part), ids[len(part) :])] if len(part) < len(ids) else []) + pieces[1:]
            self._close(out)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the stored ids of a batch's documents in a row, and where each begins and the last ends."""
    data, at = tb.raw(column)
    return data[at[0] : at[-1]].view(STORED), (at - at[0]) // STORED.itemsize


def _terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, id) of each document's distinct ids."""
    keys = ids.astype(np.uint64) | (np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds)) << np.uint64(16))
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(np.int64)


def tokenized(docs: DataFrame, doc_id: str, text: str, folder: str | None) -> DataFrame:
    """A table in the shared folder: (id, ids) of every document, ids as stored bytes; and rows with only (term, n), how many documents of a batch have a
    term, or as terms -1 and -2 how many documents and ids there are."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("ids", T.BinaryType()), T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi, _, _ in tb.chunks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = [token_ids(x, folder).astype(STORED).tobytes() for x in part.column(1).to_pylist()]
                found = pa.array(found, pa.binary())
                ids, bounds = _tokens(found)
                df += np.bincount(_terms(ids, bounds)[1], minlength=1 << 16)
                n, total = n + hi - lo, total + len(ids)
                yield pa.record_batch([part.column(0), found, pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.int64())], names=schema.names)
        if n:
            some = np.flatnonzero(df)
            rows = len(some) + 2
            yield pa.record_batch([pa.nulls(rows, kind), pa.nulls(rows, pa.binary()), pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, total]))], names=schema.names)

    return stage_table(docs.select(doc_id, text).mapInArrow(encode, schema), "tokens")


def corpus_of(tokens: DataFrame) -> Corpus:
    """Counted over all documents; the driver gets a row for each id of the vocabulary that occurs, and two more."""
    rows = tokens.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    df = np.zeros(1 << 16, np.int64)
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df[list(found)] = list(found.values())
    return Corpus(n, total / max(n, 1), df)


def routes(ids: np.ndarray, bounds: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Each document's rarest term that another document has too, the smallest of equals; the closing token if there is none."""
    doc, term = _terms(ids, bounds)
    rank = np.where(corpus.df[term] > 1, (corpus.df[term] << 16) | term, np.iinfo(np.int64).max)
    least = np.minimum.reduceat(rank, np.searchsorted(doc, np.arange(len(bounds) - 1))) if len(doc) else rank
    return np.where(least == np.iinfo(np.int64).max, CLOSING, least & 0xFFFF)


def shard_plan(sizes: dict[int, int], target: int = SHARD_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of each route, from the tokens that take it: routes in order fill shards up to the target, a larger one gets several."""
    first, wide = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    shard, held = 0, 0
    for term in sorted(sizes):
        size = sizes[term]
        if held and held + size > target:
            shard, held = shard + 1, 0
        first[term], wide[term] = shard, max(1, math.ceil(size / target))
        held += size
        if wide[term] > 1:
            shard, held = shard + int(wide[term]), 0
    return first, wide


def routed(tokens: DataFrame, corpus: Corpus) -> DataFrame:
    """(shard, id, ids), the rows of a shard together in one partition."""
    shared = tokens.sparkSession.sparkContext.broadcast(corpus)  # a number for each id of the vocabulary

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids, bounds = _tokens(batch.column(0))
            np.add.at(total, routes(ids, bounds, shared.value), np.diff(bounds))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["route", "n"])

    rows = tokens.select("ids").mapInArrow(sizes, "route bigint, n bigint").groupBy("route").agg(F.sum("n").alias("n")).toArrow()
    first, wide = shard_plan(dict(zip(rows["route"].to_pylist(), rows["n"].to_pylist(), strict=True)))
    shards = int((first + wide).max())
    plan = tokens.sparkSession.sparkContext.broadcast((first, wide))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, wide = plan.value
        row = TaskContext.get().partitionId()
        for batch in batches:
            route = routes(*_tokens(batch.column(1)), shared.value)
            shard = first[route] + (row + np.arange(len(route))) % wide[route]
            row += len(route)
            yield pa.record_batch([pa.array(shard), *batch.columns], names=["shard", "id", "ids"])

    dealt = tokens.select("id", "ids").mapInArrow(deal, T.StructType([T.StructField("shard", T.LongType()), *tokens.schema.fields[:2]]))
    return dealt.repartition(min(shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False, vocabulary_folder: str | None = None) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids themselves."""
    fields = [docs.schema[doc_id], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    schema = T.StructType(fields + [T.StructField(free_name([doc_id], "ids"), T.ArrayType(T.LongType()))] * with_ids)
    tokens = tokenized(docs, doc_id, text, vocabulary_folder)
    corpus = corpus_of(tokens)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shared.value, window)
        base = TaskContext.get().partitionId() << 40
        keys: dict[int, tuple[object, int]] = {}  # of rows with pieces to come
        kind = None

        def rows(out: list) -> pa.RecordBatch:
            columns = [
                pa.array([keys[r][0] for r, *_ in out], kind),
                pa.array([s for _, s, *_ in out], pa.int64()),
                pa.array([len(x) for _, _, x, *_ in out], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, _, x, *_ in out], pa.int64()),
                pa.array([keys[r][1] for r, *_ in out], pa.int64()),
                pa.array([base + q for *_, q, _ in out], pa.int64()),
                pa.array([o for *_, o in out], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([x.tolist() for _, _, x, *_ in out], pa.list_(pa.int64())))
            return pa.record_batch(columns, names=schema.names)

        row, size, now = 0, 0, None
        block: list[np.ndarray] = []
        for batch in batches:
            kind = batch.column(1).type
            every, bounds = _tokens(batch.column(2))
            for k, (shard, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids = every[bounds[k] : bounds[k + 1]]
                if block and (shard != now or size + len(ids) > 2 * SHARD_TOKENS):
                    packer.take(row - len(block), block, out := [])
                    yield rows(out)
                    tb.release_memory()
                    keep = {r for r, *_ in packer.open}
                    keys = {r: v for r, v in keys.items() if r in keep}
                    block, size = [], 0
                keys[row], now = (key, len(ids)), shard
                block.append(ids.copy())
                row, size = row + 1, size + len(ids)
        if row:
            out = []
            if block:
                packer.take(row - len(block), block, out)
            packer.finish(out)
            yield rows(out)
        tb.release_memory()

    if not corpus.n:
        return docs.sparkSession.createDataFrame([], schema)
    return routed(tokens.where(F.col("ids").isNotNull()), corpus).mapInArrow(pack, schema)
