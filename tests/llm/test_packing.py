import collections
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import packing


def reference(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)).encode(text, add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_vocabularys_own(text):
    assert packing.token_ids(text).tolist() == packing._full(None).encode(text, add_special_tokens=False).ids + [1]


def test_ids_of_odd_texts():
    for text in ("", "a <|endoftext|> b", "x\n\n  y\t\tz ", "don't WE'LL 123456", "\x00é日本\U0001f600" * 20, " " * 300 + "a"):
        assert packing.token_ids(text).tolist() == reference(text)
    assert packing.token_ids(None).tolist() == [1]


def check(rows, ids_of):
    """Pieces cover each document once, sequences have no gaps, and only sequences of power-of-two lengths aren't full."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end == packing.WINDOW or (end < packing.WINDOW and end & (end - 1) == 0)
    for doc, pieces in by_doc.items():
        ids = ids_of[doc]
        copies = collections.Counter((r.start, r.length) for r in pieces)
        del copies
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
        covered = collections.Counter(k for r in pieces for k in range(r.start, r.start + r.length))
        assert set(covered) == set(range(len(ids))) and len(set(covered.values())) == 1


def test_edges(edge, empty):
    rows = packing.pack_documents(edge).collect()
    texts = {r.doc_id: r.text or "" for r in edge.collect()}
    check(rows, {k: reference(t) for k, t in texts.items()})
    assert packing.pack_documents(empty).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = packing.pack_documents(docs, with_ids=True).collect()
    ids = {r.doc_id: reference(r.text or "") for r in docs.collect()}
    check(rows, ids)
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length] for r in rows)


def plain_scores(ids, seed, corpus_ids=None):
    """BM25 of every document for the whole seed as the query, by the formula; frequencies over corpus_ids."""
    corpus_ids = corpus_ids or ids
    n, mean = len(corpus_ids), np.mean([len(x) for x in corpus_ids])
    df = collections.Counter(t for x in corpus_ids for t in set(x.tolist()))
    idf = {t: max(0.0, np.log((n - d + 0.5) / (d + 0.5))) for t, d in df.items()}
    sets = [collections.Counter(x.tolist()) for x in ids]
    return np.array([sum(idf[t] * s[t] * 2.2 / (s[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in sets[seed] if df[t] > 1) for s, x in zip(sets, ids, strict=True)])


def test_neighbours_match_the_plain_formula():
    """The best unused documents, in order, for seeds of few and of many terms, with frequencies of a corpus larger than the shard."""
    rng = np.random.default_rng(0)
    corpus_ids = [np.append(rng.zipf(1.3, rng.integers(5, 400)) % 500 + 2, 1).astype(np.uint32) for _ in range(120)]
    ids = corpus_ids[:60]
    shard = packing.Shard(ids, packing.Corpus.of(corpus_ids))
    for seed in range(0, 60, 7):
        unused = (rng.random(60) < 0.7).astype(np.float32)
        unused[seed] = 0
        want = plain_scores(ids, seed, corpus_ids) * unused
        got = shard.neighbours(shard.terms(seed), unused)
        assert len(got) == min(packing.NEIGHBOURS, int((want > 1e-6).sum())) and seed not in got and unused[got].all()
        assert np.allclose(want[got], np.sort(want)[::-1][: len(got)], rtol=1e-4)


def plain_pack(ids, window):
    """The greedy packing of one shard by plain BM25: pieces (row, start, length, sequence)."""
    left, out, sequence, room, seed = list(range(len(ids))), [], 0, window, None

    def put(row):
        nonlocal sequence, room, seed
        start = 0
        while start < len(ids[row]):
            if room == window:
                seed = row
            part = min(room, len(ids[row]) - start)
            out.append((row, start, part, sequence))
            start, room = start + part, room - part
            if not room:
                sequence, room = sequence + 1, window

    while left:
        if room == window:
            put(left.pop(0))
            continue
        score = plain_scores(ids, seed)
        near = sorted((r for r in left if score[r] > 1e-6), key=lambda r: (-round(score[r], 4), r))[: packing.NEIGHBOURS] or left[:1]
        was = sequence
        while near and room < window and sequence == was:
            pick = next((r for r in near if len(ids[r]) <= room), near[0])
            near.remove(pick)
            left.remove(pick)
            put(pick)
    return out


def test_fill_matches_plain_packing():
    rng = np.random.default_rng(3)
    ids = [np.append(rng.integers(2, 90, rng.integers(3, 60)), 1).astype(np.uint32) for _ in range(50)]
    packer, out = packing.Packer(packing.Corpus.of(ids), 64), []
    packer.take(0, ids, out)
    assert [(r, s, len(x), q) for r, s, x, q, _ in out] == [p for p in plain_pack(ids, 64) if p[3] < packer.sequence]


def test_neighbours_are_alike():
    topic = lambda k: np.concatenate((np.full(6, 100 * k) + np.arange(6) % 6, [1])).astype(np.uint32)
    ids = [topic(k % 3) for k in range(27)]
    packer, out = packing.Packer(packing.Corpus.of(ids), 63), []
    packer.take(0, ids, out)
    packer.finish(out)
    by = collections.defaultdict(set)
    for row, _, _, sequence, _ in out:
        by[sequence].add(row % 3)
    assert len(by[0]) == 1


def test_neighbours_meet_across_partitions(spark):
    """Documents of one subject, stored in different partitions, share windows; a hot route is dealt over several shards."""
    words = [[f"{c}{k}zq{c}" for k in range(12)] for c in "abcdefghij"]
    rows = [(k, " ".join(words[k % 10] * 14)) for k in range(100)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(20)).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append(r.doc_id % 10)
    assert np.mean([len(set(s)) for s in by.values()]) < 2.5
    first, wide = packing.shard_plan({5: 10, 7: 35, 9: 4, 11: 5, 12: 3}, 10)
    assert (first[[5, 7, 9, 11, 12]].tolist(), wide[[5, 7, 9, 11, 12]].tolist()) == ([0, 1, 5, 5, 6], [1, 4, 1, 1, 1])
