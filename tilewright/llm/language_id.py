"""Language identification by prediction by partial matching.

For each language a context tree over bytes is kept as counts of the (k + 1)-byte strings for k up to ORDER: a node is a context of k bytes, its
symbols are the next bytes. Escape probabilities follow method C (distinct symbols over distinct symbols plus occurrences); below order 0 all 256
bytes are equally likely. The statistics are frozen after training, so the code length of a byte is a function of its last ORDER + 1 bytes, and every
length that training can tell apart is tabulated. A text's code length is the exact sum over all its bytes; the shortest wins.

Trees are trained for every language that `lang` names, on a bounded sample: about PER_LANGUAGE documents of each and LANGUAGE_BYTES of text, drawn by a
hash of id and text. Only the counts of distinct strings reach the driver. Languages are kept in shards of SHARD_LANGUAGES, as a shard's tables have a column of each of its languages
for each string; a language's lengths don't depend on the others of its shard. ASCII letters and those of Latin-1 are lower-cased.

Cases: null text, and text without any letter, is `und` with score 0; a null `lang` is not learned from; with no learned language every text is
`und`; ties go to the language that sorts first; repeated rows get equal results, and are learned from together or not at all; documents with a null id are
learned from; an empty table gives an empty result. Other columns are not read, whatever their names. Long texts are worked through in pieces, so
memory doesn't grow with them beyond their own size.
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
from tilewright.llm.shared import held_out

SPLIT = 3
ORDER = 4
PER_LANGUAGE = 300
LANGUAGE_BYTES = 4 << 20
#: Bytes of a long text that are worked through at once.
PIECE = 1 << 20
SHARD_LANGUAGES = 8
#: Code lengths are integers in units of 1/UNIT bit, so that sums don't depend on their order.
UNIT = 1 << 16
SLOT_BITS = 21
#: Of a counted string; the language is in the bits above.
STRING_BITS = 8 * (ORDER + 1)

LEAD = tb.LEAD
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def folded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with ORDER line feeds before each text, position of each text's bytes): lower-cased in ASCII and in Latin-1's letters."""
    low = tb.LOWER[data]
    if len(data) > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][pair] += 0x20
    n = len(at) - 1
    where = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(at)) + 1)
    out = np.full(len(data) + ORDER * n, 10, np.uint8)
    out[where] = low
    return out, where


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with their contexts, position of each byte, offsets of texts): the texts at once, or one long text piece by piece."""
    if len(at) != 2 or len(data) <= PIECE:
        yield *folded(data, at), at
        return
    for lo in range(0, len(data), PIECE):
        before, part = min(lo, ORDER + 1), data[max(0, lo - ORDER - 1) : lo + PIECE]
        wide, where = folded(part, np.array([0, len(part)]))
        yield wide, where[before:], np.array([0, len(part) - before])


def strings(data: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes at each position as a number."""
    key = np.zeros(len(where), np.uint64)
    for back in range(size - 1, -1, -1):
        key = (key << np.uint64(8)) | data[where - back]
    return key


@dataclass
class Trees:
    """Per order k: sorted (k + 1)-byte strings and their lengths by language; sorted contexts and the length of an escape from each."""

    languages: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    base: np.ndarray

    def index(self) -> None:
        """Slots for the strings of the highest order; where several share one, all but the first are found by binary search."""
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        keys = self.keys[ORDER]
        h = self._hash(keys)
        self.slot[h[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        counts = np.bincount(h, minlength=1 << SLOT_BITS)
        self.shared = counts > 1

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def lower(self, key: np.ndarray, order: int) -> np.ndarray:
        """Lengths by language of strings of this order, most of which are not in the table of the order above."""
        if order < 0:
            return np.broadcast_to(self.base, (len(key), len(self.languages)))
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        out = self.cost[order][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = self.lower(key[miss] & np.uint64((1 << (8 * order)) - 1), order - 1) + self._escapes(key[miss] >> np.uint64(8), order)
        return out

    def _escapes(self, context: np.ndarray, order: int) -> np.ndarray:
        known = self.contexts[order]
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where((known[at] == context)[:, None], self.escape[order][at], 0)

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths, texts by languages, in units of 1/UNIT bit."""
        out = np.zeros((len(at) - 1, len(self.languages)), np.int64)
        if len(data):
            for wide, where, bounds in pieces(data, at):
                self._add(strings(wide, where, ORDER + 1), bounds, out)
        return out

    def _add(self, key: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        """Adds the lengths of the texts' strings, which at bounds, to out."""
        h = self._hash(key)
        entry = self.slot[h]
        hit = entry >= 0
        hit &= self.keys[ORDER][np.maximum(entry, 0)] == key
        again = np.flatnonzero(~hit & self.shared[h])
        if len(again):
            found = np.minimum(np.searchsorted(self.keys[ORDER], key[again]), len(self.keys[ORDER]) - 1)
            good = self.keys[ORDER][found] == key[again]
            entry[again[good]], hit[again[good]] = found[good], True
        some = np.flatnonzero(np.diff(at))
        starts = at[:-1][some]
        cost = self.cost[ORDER]
        miss = np.flatnonzero(~hit)
        entry[miss] = 0
        seldom = self.lower(key[miss] & np.uint64((1 << (8 * ORDER)) - 1), ORDER - 1) + self._escapes(key[miss] >> np.uint64(8), ORDER) if len(miss) else None
        for k in range(len(self.languages)):
            each = cost[:, k][entry]
            if seldom is not None:
                each[miss] = seldom[:, k]
            out[some, k] += np.add.reduceat(each, starts, dtype=np.int64)


@dataclass
class Forest:
    """Trees in shards of languages, in the order of `languages`."""

    shards: list[Trees]

    @property
    def languages(self) -> list[str]:
        return [name for t in self.shards for name in t.languages]

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([t.lengths(data, at) for t in self.shards], 1)


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trees:
    """counts, by order: (string, language, occurrences) of each that was seen."""
    wide = len(languages)
    trees = Trees(languages, [], [], [], [], np.full(wide, 8 * UNIT, np.int64))
    units = lambda p: np.rint(-np.log2(p) * UNIT).astype(np.int64)
    for order in range(ORDER + 1):
        string, lang, n = counts[order]
        keys, row = np.unique(string, return_inverse=True)
        table = np.zeros((len(keys), wide), np.int64)
        table[row, lang] = n
        contexts, parent = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), wide), np.int64), np.zeros((len(contexts), wide), np.int64)
        np.add.at(total, parent, table)
        np.add.at(kinds, parent, table > 0)
        escape = np.where(total > 0, units(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
        below = trees.lower(keys & np.uint64((1 << (8 * order)) - 1), order - 1)
        here = units(np.maximum(table, 1) / np.maximum((total + kinds)[parent], 1))
        trees.keys.append(keys)
        trees.cost.append(np.where(table > 0, here, below + escape[parent]))
        trees.contexts.append(contexts)
        trees.escape.append(escape)
    trees.cost[ORDER] = np.asfortranarray(trees.cost[ORDER].astype(np.int32))
    trees.index()
    return trees


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Forest | None:
    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id", SPLIT))
    seen = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not seen:
        return None
    languages = sorted(r.lang for r in seen)
    below = {r.lang: min(1.0, per_language / r.n, LANGUAGE_BYTES / max(r.bytes, 1)) if r.n > 1 else 1.0 for r in seen}
    draw = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])[F.col("lang")]
    sample = known.where(draw < share)
    number = {name: k for k, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, data, at in tb.chunks(batch.column(0)):
                for wide, where, bounds in pieces(data, at):
                    code = np.repeat(codes[lo:hi], np.diff(bounds)).astype(np.uint64) << np.uint64(STRING_BITS)
                    for order in range(ORDER + 1):
                        keys, n = np.unique(strings(wide, where, order + 1) | code, return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["k", "string", "n"])

    found = sample.select("text", "lang").mapInArrow(count, "k int, string bigint, n bigint").groupBy("k", "string").agg(F.sum("n").alias("n")).toArrow()
    order, string, n = (found[c].to_numpy() for c in ("k", "string", "n"))
    if not len(order):
        return None
    code, string = string >> STRING_BITS, (string & ((1 << STRING_BITS) - 1)).astype(np.uint64)
    shards = []
    for low in range(0, len(languages), SHARD_LANGUAGES):
        own = (code >= low) & (code < low + SHARD_LANGUAGES)
        parts = [(string[mine], code[mine] - low, n[mine].astype(np.int64)) for mine in (own & (order == k) for k in range(ORDER + 1))]
        if len(parts[0][0]):
            shards.append(build(languages[low : low + SHARD_LANGUAGES], parts))
    return Forest(shards)


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(np.diff(at))

    def has(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1, bool)
        out[some] = np.logical_or.reduceat(mask, at[:-1][some]) if len(some) else out[some]
        return out

    out = has(ASCII_LETTER[data])
    for k in np.flatnonzero(~out & has(data >= 0x80)):
        own = data[at[k] : at[k + 1]]
        cuts = np.flatnonzero(LEAD[own])[:: PIECE // 4]
        out[k] = any(any(map(str.isalpha, own[a:b].tobytes().decode("utf-8", "replace"))) for a, b in zip(cuts, np.append(cuts[1:], len(own)), strict=True))
    return out


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the score is the posterior of the shortest code under equal priors."""
    trees = fit(docs, per_language=per_language)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample of each language
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(2)):
                names, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if found is not None:
                    some = has_letter(data, at)
                    bits = found.lengths(data, at) / UNIT
                    best = bits.argmin(1)
                    gap = bits - bits.min(1, keepdims=True)
                    names[some] = np.array(found.languages, object)[best[some]]
                    score = np.where(some, 1 / np.exp2(-np.minimum(gap, 1000)).sum(1), 0.0)
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns[:2], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return docs.select("doc_id", held_out("doc_id", SPLIT).alias("held_out"), "text").mapInArrow(predict, schema)
