"""Quality rules by distribution divergence.

Each document gets two histograms: code points by character class, and words by the common words of all languages (one bin more for all other words).
The common words of a language are the COMMON_WORDS most frequent of all its documents. Both histograms are compared with references, one for
each value of `lang`, by Jensen-Shannon distance (base 2, square root: 0 equal, 1 disjoint). The references are the summed histograms of every
document of that language, so they follow the corpus. A document is judged against the reference nearest to it (the sum of both distances), whatever its own
`lang` says, and rejected if the class distance or the sum is over its threshold. Texts below the minimum lengths are too short for a stable
histogram, and the rule passes them.

The driver gets the common words and a reference of some hundred numbers for each language; words are counted in a shuffle.

Cases: null text counts as empty (no words, fails the base rule); a null `lang` joins no reference but is judged against all; of equally near references
the one that sorts first is taken; equally frequent words rank by their bytes; an empty table gives an empty result; repeated rows are judged one by one and
equally; without any reference the divergence columns are null and the rule passes. Columns of the input that clash with a computed one are
replaced by it. A text of many megabytes is read in one piece, some 20 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import docstats
from tilewright.llm import textbatch as tb

CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "wide")
SENTENCE = ".,;:!?'\"()-"
#: Production parameters.
MIN_WORDS_BASE = 10
MAX_REPEAT_PERCENT = 20
MIN_CHARS = 200
MIN_WORDS = 40
MAX_CLASS_DISTANCE = 0.24
#: For the sum of both distances.
MAX_TOTAL_DISTANCE = 0.55
#: Of each language.
COMMON_WORDS = 24
#: Distinct words that a task holds before it passes their counts on.
FLUSH = 1 << 15


def _class_table() -> np.ndarray:
    """The class of each byte; continuation bytes have the class after the last, which is dropped."""
    table = np.full(256, CLASSES.index("symbol"))
    table[0x80:] = CLASSES.index("wide")
    table[0x80:0xC0] = len(CLASSES)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[tb.SPACE] = 3
    table[list(SENTENCE.encode())] = 4
    return table


CLASS_OF = _class_table().astype(np.int8)


class Lexicon:
    """Bins of words: 1 and up in the order of the words, 0 for all others."""

    def __init__(self, words: list[str]):
        self.words = sorted(words, key=str.encode)
        listed = tb.Words(*tb.raw(pa.array(self.words, pa.string())))
        found = listed.hashes()
        order = np.argsort(found)
        self.hashes, self.bin = found[order], order + 1

    def bins(self, lowered: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(len(lowered), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, lowered), len(self.hashes) - 1)
        return np.where(self.hashes[at] == lowered, self.bin[at], 0)


def histograms(words: tb.Words, lowered: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text by character class, and by the lexicon's bins."""
    n = words.n_texts
    wide = len(CLASSES) + 1
    chars = np.zeros(n * wide, np.int64)
    for lo in range(0, len(words.data), tb.PIECE):
        part = words.data[lo : lo + tb.PIECE]
        byte_text = np.repeat(np.arange(n), np.diff(np.clip(words.at, lo, lo + len(part))))
        chars += np.bincount(byte_text * wide + CLASS_OF[part], minlength=n * wide)
    size = len(lexicon.words) + 1
    return chars.reshape(n, wide)[:, :-1], np.bincount(words.text_of * size + lexicon.bins(lowered), minlength=n * size).reshape(n, size)


def distances(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, texts by references. A text without counts is at distance 1."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    out = np.empty((len(counts), len(references)))
    for k, ref in enumerate(references):
        q = ref / max(ref.sum(), 1)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
            right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(1)
        out[:, k] = np.sqrt(np.clip((left + right) / 2, 0, 1))
    out[total[:, 0] == 0] = 1.0
    return out


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[str]:
    """The COMMON_WORDS most frequent lower-cased words of each language over all documents, as one list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, list]] = {}  # by language, then by hash: a word's bytes and its count
        held = 0

        def rows() -> pa.RecordBatch:
            flat = [(name, word, n) for name, own in seen.items() for word, n in own.values()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            names = batch.column(1)
            for lo, hi, data, at in tb.chunks(batch.column(0)):
                words = tb.Words(data, at)
                low = tb.LOWER[data]
                hashes = tb.span_hashes(low, words.starts, words.ends)
                codes = names.slice(lo, hi - lo).dictionary_encode()
                index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)[words.text_of]
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    mine = np.flatnonzero(index == k)
                    if name is None or not len(mine):
                        continue
                    own = seen.setdefault(name, {})
                    found, first, times = np.unique(hashes[mine], return_index=True, return_counts=True)
                    at_word = mine[first]
                    for h, start, end, n in zip(found.tolist(), words.starts[at_word].tolist(), words.ends[at_word].tolist(), times.tolist(), strict=True):
                        entry = own.get(h)
                        if entry is None:
                            own[h] = [low[start:end].tobytes().decode("utf-8", "replace"), n]
                            held += 1
                        else:
                            entry[1] += n
                if held > FLUSH:
                    yield rows()
                    seen, held = {}, 0
        yield rows()
        tb.release_memory()

    counted = docs.select(F.col(text), F.col(lang).cast("string")).where(F.col(lang).isNotNull()).mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # a word that is among the most frequent is so within its share of the words
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counted.withColumn("r", F.row_number().over(share)).where(F.col("r") <= COMMON_WORDS).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= COMMON_WORDS)
    return [r.word for r in best.select("word").distinct().collect()]


def language_references(docs: DataFrame, lexicon: Lexicon, text: str = "text", lang: str = "lang") -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, class counts, word counts) over all documents, by language."""
    size = len(CLASSES) + len(lexicon.words) + 1
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1)
            for lo, hi, data, at in tb.chunks(batch.column(0)):
                words = tb.Words(data, at)
                row = np.hstack(histograms(words, words.hashes(lower=True), shared.value))
                codes = names.slice(lo, hi - lo).dictionary_encode()
                index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    if name is not None:
                        sums[name] = sums.get(name, np.zeros(size, np.int64)) + row[index == k].sum(0)
        names = list(sums)
        flat = np.concatenate([sums[n] for n in names]) if names else np.zeros(0, np.int64)
        yield pa.record_batch(
            [pa.array(np.repeat(np.array(names, object), size) if names else [], pa.string()), pa.array(np.tile(np.arange(size, dtype=np.int32), len(names)), pa.int32()), pa.array(flat, pa.int64())], names=["ref", "bin", "n"]
        )

    sums = docs.select(F.col(text), F.col(lang).cast("string")).where(F.col(lang).isNotNull()).mapInArrow(partial, "ref string, bin int, n bigint").groupBy("ref", "bin").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("ref").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins")).orderBy("ref").collect()
    out = []
    for row in rows:
        counts = np.array([row.bins[k] for k in range(len(row.bins))], np.int64)
        out.append((row.ref, counts[: len(CLASSES)], counts[len(CLASSES) :]))
    return out


COLUMNS = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("class_distance", T.DoubleType()),
        T.StructField("word_distance", T.DoubleType()),
        T.StructField("nearest", T.StringType()),
    ]
)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of docs, then the counts, base_failed, kept, both distances and the nearest reference's language."""
    lexicon = Lexicon(common_words(docs, text, lang))
    references = language_references(docs, lexicon, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = np.array([r[0] for r in references], object)
    by_class, by_word = (np.array([r[k] for r in references]) for k in (1, 2))
    own = {f.name.lower() for f in COLUMNS}
    kept_columns = [c for c in docs.columns if c.lower() not in own]
    schema = T.StructType([*docs.select(*kept_columns).schema.fields, *COLUMNS.fields])
    at_text = kept_columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tb.chunks(batch.column(at_text)):
                words = tb.Words(data, at)
                base = docstats.base_counts(words, words.hashes())
                chars, common = histograms(words, words.hashes(lower=True), shared.value)
                failed = (base["n_words"] < MIN_WORDS_BASE) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                long_enough = (chars.sum(1) >= MIN_CHARS, base["n_words"] >= MIN_WORDS)
                if len(names):
                    near_class, near_word = distances(chars, by_class), distances(common, by_word)
                    best = np.argmin(near_class + near_word, 1)
                    rows = np.arange(hi - lo)
                    class_d, word_d = near_class[rows, best], near_word[rows, best]
                    far = long_enough[0] & (class_d > MAX_CLASS_DISTANCE) | long_enough[0] & long_enough[1] & (class_d + word_d > MAX_TOTAL_DISTANCE)
                    extra = [pa.array(class_d), pa.array(word_d), pa.array(names[best], pa.string())]
                else:
                    far = np.zeros(hi - lo, bool)
                    extra = [pa.nulls(hi - lo, pa.float64()), pa.nulls(hi - lo, pa.float64()), pa.nulls(hi - lo, pa.string())]
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*part.columns, *[pa.array(base[f.name]) for f in COLUMNS.fields[:5]], pa.array(failed), pa.array(~failed & ~far), *extra], names=schema.names)

    return docs.select(*kept_columns).mapInArrow(judge, schema)
