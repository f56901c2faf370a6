"""Exact self-join of documents by the Jaccard similarity of their word shingles, with vertical partitioning.

Shingles are 58-bit hashes of WIDTH words. Their global order puts those that recur within blocks of the corpus last (by the logarithm of how
often), and orders equals by hash; any order that all documents share keeps the join exact, and this one keeps shared passages out of prefixes. Documents with equal
sets are one class and go through the join once.

1. Prefixes: two sets with Jaccard similarity t share LEAST of the first n - ceil(t n) + LEAST shingles in the order, or all they share if those are
   fewer. The order is cut into fragments, ranges of about equally many shingles; prefixes go to them, and each fragment lists the shingles that two
   classes or more have in their prefixes.
2. Counting: the order is cut into SEGMENTS; each class's set is cut likewise, the overlap of a pair is counted in each segment apart, and summed by pair.
   Of tokens up to the smaller of two prefixes' ends all common ones are in both prefixes; so a pair can only link if its prefixes share
   o - max(n - p) shingles, where o is the overlap that a link needs and n - p what a prefix leaves out: some 40 percent of a prefix for equal sizes.
3. First each class is compared with the leaders of its lists that fit, the best first, in ROUNDS; a list's leader is the class that shares most with
   others, as the origin of copies does. This joins near copies to few components. Then every pair of classes of different components whose shared
   prefix shingles, counted by fragment and summed by pair, are enough is compared. Pairs within a component need no comparison: the components are
   what is asked for. No link between components is lost, and a group of near copies costs no square of its size.

Hot keys: copies are one class from the first aggregate on; documents meet their class's component in a join that sends the classes, or the hot ones if
there are too many, to the documents. Pairs are sought among classes of like size only, and a list of over LONG_LIST classes is cut into bands, each
pair of bands being a task's work.

Identity of sets rests on 64-bit keys: among 10^9 different sets 0.03 pairs are expected to share a key, among 10^10 some 3. Of shingles' 58 bits a
collision changes a count by one.

Cases: null or empty text, or text of white space, has an empty set and links with nothing; texts of fewer words than a shingle have one shingle of all
their words; equal sets link; repeated rows share their class; an empty table gives an empty result; ties in size and order fall by hash; documents with
a null id link like others, and a component of such alone has a null component_id; other columns are not read, whatever their names. A text of many
megabytes is read in one piece, some 20 bytes of memory a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textbatch as tb
from tilewright.llm.components import connected_components
from tilewright.llm.shared import drop_table, row_key, stage_table

WIDTH = 5
PERCENT = 75
#: Shingles that prefixes of linked sets must share.
LEAST = 4
ROUNDS = 2
BLOCK_BYTES = (2 << 20) - 1
SEGMENTS = 4
#: Prefix postings for each fragment, about.
FRAGMENT_ROWS = 1 << 17
#: Postings for each fragment of the lists in which pairs are counted, about.
PAIR_ROWS = 1 << 17
#: Pairs of rows that are made at once, about.
PAIRS = 1 << 19
#: Classes of a list in one band, at most.
LONG_LIST = 1024
#: Bits of a sketch, at most.
SKETCH_BITS = 1 << 20
#: Sizes of classes that may link lie in the same bin or the next.
SIZE_STEP = 100 / PERCENT * 1.005
#: Documents of a class from which it is hot; there are at most 1 / HOT_CLASS as many of such classes as documents.
HOT_CLASS = 1000
#: Recurring shingles kept for the order, the most frequent; the table is sent to the tasks. The order need not be by exact counts.
ORDER_ROWS = 1 << 19
#: Ids that are broadcast to pick out documents; beyond that the join shuffles.
BROADCAST_NODES = 1 << 20
#: Spark's setting that removes the shuffle files of a query when it ends; else they stay until the driver collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HASH_BITS = 58
_LOW = np.uint64((1 << HASH_BITS) - 1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each text's distinct shingles, sorted by text and shingle."""
    words = tb.Words(data, at)
    hashes = words.hashes(lower=True)
    found, first = tb.windows(hashes, words.bounds, WIDTH)
    text_of = words.text_of
    parts, texts = [found], [text_of[first]]
    for k in range(1, WIDTH):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            starts = words.bounds[short]
            whole = np.zeros(len(short), np.uint64)
            for j in range(k):
                whole = tb.mix(whole + hashes[starts + j] + np.uint64(k))
            parts.append(whole)
            texts.append(short)
    shingle, text = np.concatenate(parts) & _LOW, np.concatenate(texts)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    return text[new], shingle[new]


def set_keys(text: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 64-bit key of the set) of each of n texts: the key mixes the sums of two mixes of the shingles."""
    bounds = np.searchsorted(text, np.arange(n + 1))
    total = np.zeros((2, len(shingle) + 1), np.uint64)
    np.cumsum(tb.mix(shingle), out=total[0, 1:])
    np.cumsum(tb.mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
    size = np.diff(bounds)
    one, two = (t[bounds[1:]] - t[bounds[:-1]] for t in total)
    return size, tb.mix(tb.mix(one) + two + size.astype(np.uint64)).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for lo, hi, data, at in tb.chunks(batch.column(column), BLOCK_BYTES):
            yield batch.slice(lo, hi - lo), data, at


def _blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column: the bytes of each run of values between edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of all rows of such a column."""
    data, at = tb.raw(column)
    return data[at[0] : at[-1]].view(kind), (at - at[0]) // np.dtype(kind).itemsize


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - (PERCENT * n + 99) // 100 + LEAST)


class Order:
    """The global order of shingles: (rarity class, hash)."""

    def __init__(self, shingle: np.ndarray, n: np.ndarray):
        order = np.argsort(shingle)
        self.shingle = shingle[order]
        self.rank = np.minimum(1 + np.log2(np.maximum(n[order], 1)).astype(np.uint64), np.uint64(63))

    def keys(self, shingle: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(shingle), np.uint64)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            hit = self.shingle[at] == shingle
            rank[hit] = self.rank[at[hit]]
        return (rank << np.uint64(HASH_BITS)) | shingle


class Cut:
    """Ranges of the order of about equally many shingles: a growing function of (rarity class, hash). weights: shingles of each rarity class."""

    def __init__(self, weights: np.ndarray, pieces: int):
        share = (weights + 1.0) / (weights + 1.0).sum()
        self.start, self.share, self.pieces = np.concatenate(([0.0], np.cumsum(share)[:-1])), share, pieces

    def of(self, key: np.ndarray) -> np.ndarray:
        rank = (key >> np.uint64(HASH_BITS)).astype(np.int64)
        at = self.start[rank] + self.share[rank] * ((key & _LOW).astype(np.float64) / float(1 << HASH_BITS))
        return np.minimum((at * self.pieces).astype(np.int64), self.pieces - 1)

    def column(self, h: str):
        rank = F.shiftrightunsigned(h, HASH_BITS).cast("int") + 1
        start, share = (F.element_at(F.array(*[F.lit(float(x)) for x in v]), rank) for v in (self.start, self.share))
        at = start + share * (F.col(h).bitwiseAND((1 << HASH_BITS) - 1) / float(1 << HASH_BITS))
        return F.least(F.floor(at * self.pieces), F.lit(self.pieces - 1))


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row (id, n, node, row) for each document, row being the key of its id and text; and rows with only (seen, times): shingles that a block has in two
    or more of its distinct sets."""
    schema = T.StructType([docs.schema[doc_id], *[T.StructField(c, T.LongType()) for c in ("n", "node", "row", "seen", "times")]])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in _blocks(batches, 1):
            rows = len(at) - 1
            owner, shingle = shingle_sets(data, at)
            size, key = set_keys(owner, shingle, rows)
            first = np.zeros(rows, bool)
            first[np.unique(key, return_index=True)[1]] = True
            shingles, times = np.unique(shingle[first[owner]], return_counts=True)
            some = times > 1
            yield pa.record_batch([part.column(0), pa.array(size), pa.array(key), part.column(2), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=schema.names)
            more = int(some.sum())
            if more:
                yield pa.record_batch([pa.nulls(more, part.column(0).type), pa.nulls(more, pa.int64()), pa.nulls(more, pa.int64()), pa.nulls(more, pa.int64()), pa.array(shingles[some].view(np.int64)), pa.array(times[some])], names=schema.names)

    return docs.select(doc_id, text, row_key(doc_id, text)).mapInArrow(sets, schema)


def prefix_lists(docs: DataFrame, text: str, order, cut: Cut) -> DataFrame:
    """(fragment, h, node, n, pos, others): postings of prefixes, of shingles that two classes or more have, and how many others have each."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in _blocks(batches, 0):
            owner, shingle = shingle_sets(data, at)
            n, node = set_keys(owner, shingle, len(at) - 1)
            first = np.zeros(len(n), bool)
            first[np.unique(node, return_index=True)[1]] = True
            use = first[owner]
            owner, key = owner[use], order.value.keys(shingle[use])
            ranked = np.lexsort((key, owner))
            owner, key = owner[ranked], key[ranked]
            bounds = np.searchsorted(owner, np.arange(len(n) + 1))
            pos = np.arange(len(owner)) - bounds[owner]
            use = pos < prefix_size(n)[owner]
            owner, key, pos = owner[use], key[use], pos[use]
            fragment = cut.of(key)
            ranked = np.argsort(fragment, kind="stable")  # owners stay in order within a fragment
            owner, key, pos, fragment = owner[ranked], key[ranked], pos[ranked], fragment[ranked]
            if len(key):
                edges = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
                new = np.ones(len(key), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
                local = np.cumsum(new) - 1
                nodes = np.append(local[edges], local[-1] + 1)
                local -= np.repeat(local[edges], np.diff(np.append(edges, len(key))))
                edges, own = np.append(edges, len(key)), owner[new]
                columns = [_blobs(x, edges) for x in (key, local.astype(np.uint32), np.minimum(pos, 0xFFFF).astype(np.uint16))] + [_blobs(x, nodes) for x in (node[own], n[own].astype(np.int32))]
                yield pa.record_batch([pa.array(fragment[edges[:-1]].astype(np.int32)), *columns], names=["fragment", "key", "local", "pos", "nodes", "sizes"])

    def lists(table: pa.Table) -> pa.Table:
        (key, at), (nodes, nodes_at) = _values(table["key"], np.uint64), _values(table["nodes"], np.int64)
        own = _values(table["local"], np.uint32)[0] + np.repeat(nodes_at[:-1], np.diff(at))
        node, n, pos = nodes[own], _values(table["sizes"], np.int32)[0][own], _values(table["pos"], np.uint16)[0]
        ranked = np.lexsort((node, key))
        key, node, n, pos = key[ranked], node[ranked], n[ranked], pos[ranked]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, pos = key[new], node[new], n[new], pos[new]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(head, len(key)))
        keep = np.repeat(length > 1, length)
        others = np.repeat(length - 1, length)
        fragment = np.full(int(keep.sum()), table["fragment"][0].as_py(), np.int32)
        return pa.table([pa.array(fragment), pa.array(key[keep].view(np.int64)), pa.array(node[keep]), pa.array(n[keep].astype(np.int64)), pa.array(pos[keep].astype(np.int64)), pa.array(others[keep])], names=["fragment", "h", "node", "n", "pos", "others"])

    parts = docs.select(text).mapInArrow(postings, "fragment int, key binary, local binary, pos binary, nodes binary, sizes binary")
    return parts.groupBy("fragment").applyInArrow(lists, "fragment int, h bigint, node bigint, n bigint, pos bigint, others bigint")


def sketches(owner: np.ndarray, shingle: np.ndarray, n: np.ndarray, some: np.ndarray) -> pa.Array:
    """The sketch of each of some sets: a power of two of bits, 4 to 8 a shingle (at least 64, at most SKETCH_BITS), each the parity of the shingles that fall on it. Two
    sets differ in as many shingles as their sketches do in bits, or more."""
    bits = np.zeros(len(n), np.int64)
    bits[some] = np.clip(1 << (np.ceil(np.log2(n[some])).astype(np.int64) + 2), 64, SKETCH_BITS)
    at = np.concatenate(([0], np.cumsum(bits)))
    odd = np.bincount(at[owner] + (shingle.astype(np.int64) & (bits[owner] - 1)), minlength=at[-1]).astype(np.uint8) & 1
    return _blobs(np.packbits(odd, bitorder="little"), np.append(at[some], at[-1]) // 8)


def class_segments(docs: DataFrame, text: str, order, cut: Cut) -> DataFrame:
    """(node, n, segment, shingles): the shingles of each class of the documents by segment of the order, sorted in it; as segment SEGMENTS its sketch."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in _blocks(batches, 0):
            owner, shingle = shingle_sets(data, at)
            n, node = set_keys(owner, shingle, len(at) - 1)
            first = np.zeros(len(n), bool)
            first[np.unique(node, return_index=True)[1]] = True
            use = first[owner]
            owner, shingle = owner[use], shingle[use]
            some = np.flatnonzero(first & (n > 0))
            yield pa.record_batch([pa.array(node[some]), pa.array(n[some]), pa.array(np.full(len(some), SEGMENTS, np.int32)), sketches(owner, shingle, n, some)], names=["node", "n", "segment", "shingles"])
            key = order.value.keys(shingle)
            segment = cut.of(key)
            ranked = np.lexsort((key, segment, owner))
            owner, key, segment = owner[ranked], key[ranked], segment[ranked]
            edges = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])))) if len(key) else np.zeros(0, np.int64)
            blobs = [key[lo:hi].tobytes() for lo, hi in zip(edges, np.append(edges[1:], len(key)), strict=True)]
            yield pa.record_batch([pa.array(node[owner[edges]]), pa.array(n[owner[edges]]), pa.array(segment[edges].astype(np.int32)), pa.array(blobs, pa.binary())], names=["node", "n", "segment", "shingles"])

    return docs.select(text).mapInArrow(parts, "node bigint, n bigint, segment int, shingles binary").dropDuplicates(["node", "segment"])


def may_link(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Those pairs of classes (u, v) that by their sketches may link; they take an eighth of what counting reads at most. All that link are among them."""
    found = segments.where(F.col("segment") == SEGMENTS)
    left = pairs.join(found.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("shingles").alias("a")), "u")
    both = left.join(found.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("shingles").alias("b")), "v")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = n - 2 * -(-PERCENT * n // (100 + PERCENT))
            keep = np.empty(len(n), bool)
            for k, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                size = min(len(one), len(two))
                one, two = (x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size)) for x in (one, two))
                keep[k] = np.bitwise_count(one ^ two).sum(dtype=np.int64) <= most[k]
            yield pa.record_batch([x.filter(pa.array(keep)) for x in batch.columns[:2]], names=["u", "v"])

    return both.select("u", "v", "n_u", "n_v", "a", "b").mapInArrow(near, "u bigint, v bigint")


def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(u, v) of those pairs of classes (u, v) that link: overlaps are counted by segment, then summed by pair."""
    segments = segments.where(F.col("segment") < SEGMENTS)
    left = pairs.join(segments.select(F.col("node").alias("u"), "segment", F.col("n").alias("n_u"), F.col("shingles").alias("a")), "u")
    both = left.join(segments.select(F.col("node").alias("v"), "segment", F.col("n").alias("n_v"), F.col("shingles").alias("b")), ["v", "segment"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            total = np.empty(len(one), np.int64)
            for k, (a, b) in enumerate(zip(one, two, strict=True)):
                merged = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
                merged.sort()
                total[k] = (merged[1:] == merged[:-1]).sum()
            yield pa.record_batch([*batch.columns[:4], pa.array(total)], names=["u", "v", "n_u", "n_v", "common"])

    counted = both.select("u", "v", "n_u", "n_v", "a", "b").mapInArrow(count, "u bigint, v bigint, n_u bigint, n_v bigint, common bigint")
    common = F.col("common")
    return counted.groupBy("u", "v", "n_u", "n_v").agg(F.sum("common").alias("common")).where(100 * common >= PERCENT * (F.col("n_u") + F.col("n_v") - common)).select("u", "v")


def least_common(n_u, n_v):
    """The smallest overlap of linked sets of these sizes: ceil(PERCENT (n_u + n_v) / (100 + PERCENT))."""
    return F.ceil(PERCENT * (n_u + n_v) / (100 + PERCENT))


def can_link(n_u, n_v, k):
    """Whether sets of these sizes, whose prefixes share k shingles, may link."""
    rest = lambda n: F.ceil(PERCENT * n / 100) - LEAST  # noqa: E731  what a prefix leaves out; of a short set, nothing
    left = F.greatest(rest(n_u), rest(n_v), F.lit(0))
    return (100 * F.least(n_u, n_v) >= PERCENT * F.greatest(n_u, n_v)) & (k >= least_common(n_u, n_v) - left)


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(u, v, k): classes and leaders of their lists that may link, and how many lists the one leads for the other."""
    weights = lists.groupBy("node").agg(F.sum("others").alias("weight"))
    led = lists.select("h", "node", "n").join(weights, "node").groupBy("h").agg(F.max_by(F.struct("node", "n"), F.struct("weight", F.negate("node"))).alias("l"))
    own = lists.select("h", "node", "n").join(led.select("h", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n")), "h").where("node <> leader")
    each = own.groupBy("node", "leader", "n", "leader_n").agg(F.count("*").alias("k"))
    size = (100 * F.least("n", "leader_n") >= PERCENT * F.greatest("n", "leader_n")) & (F.col("k") >= F.least(F.lit(LEAST), least_common(F.col("n"), F.col("leader_n"))))
    return each.where(size).select("node", "leader", "k")


def best_partners(candidates: DataFrame, labels: DataFrame | None, tested: DataFrame | None) -> DataFrame:
    """(u, v): each class and the best of its candidates that isn't tested nor in its component."""
    left = candidates
    if labels is not None:
        left = left.join(tested, (F.least("node", "leader") == F.col("u")) & (F.greatest("node", "leader") == F.col("v")), "left_anti")
        for c in ("node", "leader"):
            left = left.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
        left = left.where(F.coalesce("node_label", "node") != F.coalesce("leader_label", "leader"))
    best = left.groupBy("node").agg(F.max_by("leader", F.struct("k", F.negate("leader"))).alias("leader"))
    return best.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()


def cross_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v) of classes of different components whose sizes, positions and shared prefix shingles allow a link.

    The lists that are left are those with several components, without the classes that have too few places in them to link at all. They are dealt to
    fragments of the order anew, of about PAIR_ROWS postings, and in these by size: a class is at home in its bin of sizes and visits the bin below, so
    that it meets all that are not too small for it. Lists that are long are dealt by pairs of bands as well, and as many fragments go together as there
    are bands, so that a pair of classes is counted in few tasks and not list by list.
    """
    known = lists.select("h", "node", "n", "pos").join(labels, "node", "left").select("h", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("h").agg((F.min("label") != F.max("label")).alias("mixed"), F.count("*").alias("length")).where("mixed").select("h", "length")
    rows = stage_table(known.join(mixed, "h"), "mixed")
    listed = rows.groupBy("node", "n").agg(F.count("*").alias("listed")).where(F.col("listed") >= F.least(F.lit(LEAST), F.ceil(PERCENT * F.col("n") / 100))).select("node", "listed")
    weights = np.zeros(64)
    for r in rows.groupBy(F.shiftrightunsigned("h", HASH_BITS).cast("int").alias("rank")).count().collect():
        weights[r["rank"]] = r["count"]
    found = stage_table(counted_pairs(rows.join(listed, "node"), Cut(weights, max(1, math.ceil(weights.sum() / PAIR_ROWS)))).groupBy("u", "v", "n_u", "n_v").agg(F.sum("k").alias("k")).where(can_link(F.col("n_u"), F.col("n_v"), F.col("k"))).select("u", "v"), "pairs")
    drop_table(rows)
    return found


def counted_pairs(rows: DataFrame, cut: Cut) -> DataFrame:
    """(u, v, n_u, n_v, k): pairs of classes and the lists that they share in a task, from rows (h, node, n, pos, label, length, listed)."""
    size_bin = F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).cast("int")
    bands = F.when(F.col("length") > LONG_LIST, F.pow(2.0, F.ceil(F.log2(F.col("length") / LONG_LIST)))).otherwise(1.0).cast("int")
    dealt = rows.withColumn("bands", bands).withColumn("band", F.pmod("node", "bands").cast("int")).withColumn("place", F.floor(cut.column("h") / F.col("bands")))
    dealt = dealt.select("*", F.explode(F.array(F.struct(size_bin.alias("bin"), F.lit(True).alias("home")), F.struct((size_bin - 1).alias("bin"), F.lit(False).alias("home")))).alias("s")).select("*", "s.bin", "s.home")
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("other")).withColumn("low", F.least("band", "other")).withColumn("high", F.greatest("band", "other"))

    def pairs(table: pa.Table) -> pa.Table:
        found = [np.zeros((0, 5), np.int64), *list_pairs(*(table[c].to_numpy(zero_copy_only=False) if c == "home" else table[c].to_numpy() for c in ("h", "node", "n", "pos", "label", "listed", "band", "home")), table["low"][0].as_py() == table["high"][0].as_py())]
        return pa.table([pa.array(c) for c in np.concatenate(found).T], names=["u", "v", "n_u", "n_v", "k"])

    return dealt.select("h", "node", "n", "pos", "label", "listed", "band", "home", "bands", "place", "bin", "low", "high").groupBy("bands", "place", "bin", "low", "high").applyInArrow(pairs, "u bigint, v bigint, n_u bigint, n_v bigint, k bigint")


def list_pairs(h, node, n, pos, label, listed, band, home, one_band: bool) -> Iterator[np.ndarray]:
    """Rows (u, v, n_u, n_v, k) of the pairs that could still reach the bound with what both have in other tasks.

    All lists go at once: with a list's rows by component, the larger first, a row's partners are the rows before its component. Pairs are taken by the
    class of the later row, about PAIRS at once, so all of a pair come together.
    """
    _, of, sizes = np.unique(label, return_inverse=True, return_counts=True)
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
    rank = rank[of]
    ranked = np.lexsort((rank, h))
    h, node, n, pos, listed, band, home, rank = (x[ranked] for x in (h, node, n, pos, listed, band, home, rank))
    keys, own, own_rows = np.unique(node, return_inverse=True, return_counts=True)
    more = listed - own_rows[own]
    place = np.arange(len(h))
    new_list = np.concatenate(([True], h[1:] != h[:-1]))
    start = np.maximum.accumulate(np.where(new_list, place, 0))
    stop = np.maximum.accumulate(np.where(new_list | np.concatenate(([True], rank[1:] != rank[:-1])), place, 0))
    partners = stop - start
    by_class = np.argsort(own, kind="stable")
    by_class = by_class[partners[by_class] > 0]
    if not len(by_class):
        return
    work = np.cumsum(np.bincount(own, partners, len(keys)).astype(np.int64))
    step = (work // PAIRS)[own[by_class]]
    edges = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1], [True])))
    left_out = np.maximum(-(-PERCENT * n // 100) - LEAST, 0)
    size = np.zeros(len(keys), np.int64)
    size[own] = n
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        keys_found, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.cumsum(partners[by_class[lo:hi]]) // PAIRS
        for part in np.split(by_class[lo:hi], np.flatnonzero(np.diff(cuts)) + 1):  # several parts only for a class of more than PAIRS
            count = partners[part]
            i = np.repeat(part, count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count - start[part], count)
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            fit = np.where(n[i] <= n[j], home[i], home[j]) & (PERCENT * large <= 100 * small)
            if not one_band:
                fit &= band[i] != band[j]
            i, j = i[fit], j[fit]
            both = n[i] + n[j]
            overlap = -(-PERCENT * both // (100 + PERCENT))
            fit = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= overlap
            fit &= np.minimum(listed[i], listed[j]) >= overlap - np.maximum(left_out[i], left_out[j])
            new, k = np.unique(own[i[fit]] * len(keys) + own[j[fit]], return_counts=True)
            if len(keys_found):
                new, at = np.unique(np.concatenate((keys_found, new)), return_inverse=True)
                k = np.bincount(at, np.concatenate((times, k)), len(new)).astype(np.int64)
            keys_found, times = new, k
        u, v = np.divmod(keys_found, len(keys))
        n_u, n_v = size[u], size[v]
        need = -(-PERCENT * (n_u + n_v) // (100 + PERCENT)) - np.maximum(np.maximum(-(-PERCENT * n_u // 100), -(-PERCENT * n_v // 100)) - LEAST, 0)
        rest = np.zeros(len(keys), np.int64)
        rest[own] = more
        fit = times + np.minimum(rest[u], rest[v]) >= need
        u, v, n_u, n_v, times = u[fit], v[fit], n_u[fit], n_v[fit], times[fit]
        swap = keys[v] < keys[u]
        yield np.column_stack((np.where(swap, keys[v], keys[u]), np.where(swap, keys[u], keys[v]), np.where(swap, n_v, n_u), np.where(swap, n_u, n_v), times))


def segments_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, order, cut: Cut) -> DataFrame:
    """The segments of the given classes: one document of each is read again. Their ids are broadcast if they are counted and few, else joined."""
    ids = stage_table(classes.join(nodes, "node", "left_semi").select(F.col("least").alias("id")).distinct(), "ids")
    n = ids.count()
    picked = docs.join(F.broadcast(ids) if n <= BROADCAST_NODES else ids, docs[doc_id].eqNullSafe(ids["id"]), "left_semi")
    return stage_table(class_segments(picked, text, order, cut), "segments")


def nodes_of(pairs: DataFrame, u: str, v: str) -> DataFrame:
    return pairs.select(F.explode(F.array(u, v)).alias("node")).distinct()


def with_components(own: DataFrame, known: DataFrame) -> DataFrame:
    """own with the columns of known, which has one row for each class of several documents or with links. Documents aren't dealt by class: known is
    sent to them if it is counted and small; else its hot classes are, and only the documents of the others are shuffled."""
    if known.count() <= BROADCAST_NODES:
        return own.join(F.broadcast(known), "node", "left")
    hot = known.where(F.col("documents") >= HOT_CLASS).withColumn("hot", F.lit(True))
    marked = own.join(F.broadcast(hot) if hot.count() <= BROADCAST_NODES else hot, "node", "left")
    return marked.where("hot").drop("hot").unionByName(own.join(marked.where("hot IS NULL").select("row", "node"), ["row", "node"], "left_semi").join(known, "node", "left"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), node, the key of the document's set, label, that of its component (null for
    empty sets), and row, the key of id and text."""
    spark = docs.sparkSession
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")  # each table is written once, and what was shuffled for it isn't read again
    try:
        return _components(docs, doc_id, text)
    finally:
        spark.conf.set(TIDY, before)


def _components(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    sets = stage_table(document_sets(docs, doc_id, text), "sets")
    own = sets.where(F.col("node").isNotNull()).select(doc_id, "n", "node", "row")
    classes = stage_table(own.where("n > 0").groupBy("node").agg(F.min(doc_id).alias("least"), F.count("*").alias("documents"), F.first("n").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = sets.where(F.col("seen").isNotNull()).groupBy("seen").agg(F.sum("times").alias("times"))
    # the least times that at most ORDER_ROWS shingles reach
    histogram = counted.groupBy("times").agg(F.count("*").alias("k")).orderBy(F.desc("times")).limit(ORDER_ROWS).toArrow()
    inside = histogram["times"].to_numpy()[np.cumsum(histogram["k"].to_numpy()) <= ORDER_ROWS]
    top = counted.where(F.col("times") >= int(inside.min())).toArrow() if len(inside) else counted.where("false").toArrow()
    times = top["times"].to_numpy()
    ranking = Order(top["seen"].to_numpy().view(np.uint64), times)
    weights = np.bincount(np.minimum(1 + np.log2(np.maximum(times, 1)).astype(np.int64), 63), times, 64)
    weights[0] = max(total - weights.sum(), 0)
    order = spark.sparkContext.broadcast(ranking)
    segment_cut = Cut(weights, SEGMENTS)
    # what prefixes hold of each rarity class isn't known; at most the first class has all of it, and fragments are cut for that
    postings = weights * (100 - PERCENT) / 100
    postings[0] = total * (100 - PERCENT) / 100
    lists = stage_table(prefix_lists(docs, text, order, Cut(postings, max(8, math.ceil(postings.sum() / FRAGMENT_ROWS)))), "lists")
    candidates = stage_table(leader_pairs(lists), "candidates")
    segments = segments_of(nodes_of(candidates, "node", "leader"), classes, docs, doc_id, text, order, segment_cut)
    links = labels = tested = None
    for _ in range(ROUNDS):
        asked = stage_table(best_partners(candidates, labels, tested), "partners")
        if asked.isEmpty():
            break
        tested = asked if tested is None else tested.unionByName(asked)
        found = stage_table(linked(asked, segments), "links")
        links = found if links is None else links.unionByName(found)
        labels = stage_table(connected_components(links), "labels")
    drop_table(segments)
    if labels is None:
        labels, links = (spark.createDataFrame([], t) for t in ("node bigint, label bigint", "u bigint, v bigint"))
    drop_table(candidates)
    pairs = cross_pairs(lists, labels)
    drop_table(lists)
    segments = segments_of(nodes_of(pairs, "u", "v"), classes, docs, doc_id, text, order, segment_cut)
    near = stage_table(may_link(pairs, segments), "near")  # few, and counted before the join with segments is planned
    links = links.unionByName(stage_table(linked(near, segments), "links"))
    drop_table(segments)
    labels = connected_components(links)

    labelled = classes.join(labels, "node", "left").select("node", "documents", "least", F.col("label").isNotNull().alias("linked"), F.coalesce("label", "node").alias("label"))
    roots = labelled.where("linked").groupBy("label").agg(F.min("least").alias("root"))
    some = labelled.where("linked OR documents > 1").join(roots, "label", "left")
    known = stage_table(some.select("node", "documents", "label", F.when(F.col("linked"), F.col("root")).otherwise(F.col("least")).alias("component_id")), "components")
    alone = F.col("component_id").isNull() & F.col("documents").isNull()
    return with_components(own, known).select(
        doc_id, F.col("n").alias("n_shingles"), F.when(alone, F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"), "node", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"), "row"
    )
