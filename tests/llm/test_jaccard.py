import random
import re

import numpy as np
import pytest

from tilewright.llm import components, jaccard_join


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    own = [(k, sets(t)) for k, t in docs]
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(own):
        for j in range(i):
            b = own[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(own):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(own))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for family in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else rng.choice(vocab) for w in base]
            if rng.random() < 0.3:
                copy = copy + passage if family % 2 else passage + copy[:10]
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(docs)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "two one")]
    assert got(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_other_ways_agree(spark, monkeypatch):
    """With the filters as joins, many small fragments and no first rounds, the components are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = got(jaccard_join.jaccard_components(docs))
    for name, value in (("BROADCAST_NODES", 0), ("FRAGMENT_ROWS", 500), ("PAIR_ROWS", 50), ("ROUNDS", 0), ("LONG_LIST", 3), ("HOT_CLASS", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert got(jaccard_join.jaccard_components(docs)) == want == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_sizes_at_the_bound(spark):
    """Sets that link with exactly three quarters, of all sizes: bins of sizes lose none."""
    rng = random.Random(4)
    rows = []
    for n in range(3, 90, 3):
        words = [f"x{rng.random()}" for _ in range(4 * n + 4)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[: 3 * n + 4]))]
    found = got(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert found == brute(rows) and all(c == k - k % 2 for k, _, c in found)


def test_long_lists_in_bands(spark, monkeypatch):
    """Documents that share a passage of half their words, some of them near copies: one list has them all."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 7)
    monkeypatch.setattr(jaccard_join, "ORDER_ROWS", 0)
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    own = [" ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 40))) for _ in range(25)]
    rows = [(k, f"{passage} {own[k % 25]}{' more' * (k // 25)}") for k in range(60)]
    assert got(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_the_cut_follows_the_order():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = np.sort((rng.integers(0, 64, 5000).astype(np.uint64) << np.uint64(58)) | rng.integers(0, 1 << 58, 5000).astype(np.uint64))
    piece = jaccard_join.Cut(np.arange(64.0), 13).of(keys)
    assert (np.diff(piece) >= 0).all() and set(piece) == set(range(13))


def test_edges(edge, empty):
    rows = jaccard_join.jaccard_components(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[7].component_id == 7 and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1
    assert by[2].component_id == 2
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 9), (9, 20)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    out = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 4: 4, 5: 4, 9: 4, 20: 4} | {100 + k: 100 for k in range(41)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_lists_count_a_pair_in_few_tasks(spark, monkeypatch):
    """Pairs of classes that share many long lists leave the tasks once, not once a list."""
    from pyspark.sql.group import GroupedData

    rows = [(h, node, 100, 0, 39) for h in range(40) for node in range(24)]
    lists = spark.createDataFrame(rows, "h long, node long, n long, pos long, others long")
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, label long")
    made = []
    plain = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: made.append(plain(self, *a)) or made[-1])
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 4)
    monkeypatch.setattr(jaccard_join, "drop_table", lambda df: None)
    found = {(r.u, r.v) for r in jaccard_join.cross_pairs(lists, labels).collect()}
    assert found == {(u, v) for v in range(24) for u in range(v)} - {(0, 1)}
    assert made[-1].count() == len(found)


def test_pairs_far_apart_are_not_counted(spark, monkeypatch):
    """Copies of one text that don't link are told apart by their sketches, before their shingles are read for each pair."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    docs = [" ".join(f"x{rng.random()}" if k % 50 == j else w for k, w in enumerate(base)) for j in range(0, 50, 6)]  # they share 0.66 with each other
    docs += [" ".join(base[:380] + ["y"] * 5), " ".join(base[:380] + ["z"] * 5)]
    rows = list(enumerate(docs))
    asked = []
    plain = jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, segments: asked.append(pairs.count()) or plain(pairs, segments))
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    assert got(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    near = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for j, (_, a) in enumerate(rows) for _, b in rows[:j]]
    assert sum(x >= 0.75 for x in near) <= asked[-1] <= sum(x >= 0.7 for x in near) < len(near)


@pytest.mark.parametrize("pairs", [1, 50, 1 << 19])
def test_pairs_of_lists(monkeypatch, pairs):
    """Against plain counting: components of many classes and of one, sizes of two bins, passes of any size."""
    monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
    rng = random.Random(pairs)
    size = {k: rng.randint(20, 34) for k in range(60)}
    label = {k: rng.choice([0, 0, 1, k + 100]) for k in size}
    rows = [(h, k) for h in range(50) for k in rng.sample(range(60), rng.choice([2, 3, 40]))]
    listed = {k: sum(r[1] == k for r in rows) for k in size}
    own = [np.array(x) for x in zip(*[(h, k, size[k], 0, label[k], listed[k], 0, size[k] < 28) for h, k in rows], strict=True)]
    got_pairs = sorted(tuple(int(x) for x in r) for part in jaccard_join.list_pairs(*own, True) for r in part)
    want = []
    for u in size:
        for v in range(u + 1, 60):
            common = len({h for h, k in rows if k == u} & {h for h, k in rows if k == v})
            small, large = sorted((size[u], size[v]))
            need = -(-75 * (small + large) // 175) - (-(-75 * large // 100) - 4)
            if label[u] != label[v] and small < 28 and 75 * large <= 100 * small and common >= need:
                want.append((u, v, size[u], size[v], common))
    assert got_pairs == sorted(want) and want


def test_sketches():
    """They differ in no more bits than the sets in shingles, folded or not."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 58, 300).astype(np.uint64)
    own = [np.unique(np.concatenate((common[:a], rng.integers(0, 1 << 58, b).astype(np.uint64)))) for a, b in ((300, 0), (300, 20), (250, 200), (300, 600), (3, 0), (0, 0), (0, 1))]
    n = np.array([len(x) for x in own])
    some = np.flatnonzero(n)
    column = jaccard_join.sketches(np.repeat(np.arange(len(n)), n), np.concatenate(own), n, some)
    assert len(column) == len(some)
    bits = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), bitorder="little") for x in column]
    for a, x in zip(some, bits, strict=True):
        assert len(x) >= min(4 * n[a], jaccard_join.SKETCH_BITS)
        for b, y in zip(some, bits, strict=True):
            least = min(len(x), len(y))
            differ = (x.reshape(-1, least).sum(0) + y.reshape(-1, least).sum(0)) % 2
            assert differ.sum() <= len(np.setxor1d(own[a], own[b]))
