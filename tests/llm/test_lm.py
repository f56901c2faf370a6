import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tilewright.llm import lattice, lm_scoring, textbatch


def paths(vocab, weights, word):
    """Every way to cut a word into pieces: (pieces, log weight)."""
    if not word:
        return [((), 0.0)]
    out = []
    for n in range(1, min(len(word), vocab.longest) + 1):
        k = vocab.numbers.get(word[:n])
        if k is not None:
            out += [((k, *rest), weights[k] + w) for rest, w in paths(vocab, weights, word[n:])]
    return out


def test_marginals_and_expectations_by_enumeration(monkeypatch):
    vocab = lattice.vocabulary()
    weights = lattice.first_weights(vocab)
    words = [b"the", b"thtion", "é".encode(), b"a", b"thting", b"zq#"] * 5
    data, at = textbatch.raw(pa.array(words, pa.binary()))
    for few in (0, 1000):
        monkeypatch.setattr(lattice, "FEW", few)
        got = lattice.log_probabilities(vocab, weights[None], data, at[:-1], at[1:])[0]
        times = np.arange(1.0, len(words) + 1)
        expected = lattice.expected_counts(vocab, weights, data, at[:-1], at[1:], times)
        want = np.zeros(len(weights))
        for k, word in enumerate(words):
            found = paths(vocab, weights, b" " + word)
            total = math.log(sum(math.exp(w) for _, w in found))
            assert got[k] == pytest.approx(total, abs=1e-9)
            for pieces, w in found:
                for piece in pieces:
                    want[piece] += times[k] * math.exp(w - total)
        assert np.allclose(expected, want, atol=1e-9)


def base(docs):
    train = [t for k, t in docs if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    split = lambda t: (t or "").encode().lower().split()
    c = collections.Counter(w for t in train for w in split(t))
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    bottom = n + 0.5 * (v + 1)
    out = []
    for k, t in docs:
        w = split(t)
        score = sum(math.log10((c[x] + 0.5) / bottom) for x in w) + math.log10((len(train) + 0.5) / bottom)
        out.append((str(k), len(w) + 1, sum(x in c for x in w) + bool(train), n, round(score, 6)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


@pytest.mark.parametrize("head", [1 << 18, 3, 0])
def test_base_scores(edge, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", max(head, 1))
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    out = lm_scoring.lm_scores(edge)
    assert got(out) == base(docs)
    rows = out.collect()
    assert all(math.isfinite(r.score) and r.score < 0 and r.lattice_score < 0 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)


def test_scores_do_not_depend_on_the_head_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    score = lambda: {r.doc_id: r.score for r in lm_scoring.lm_scores(docs).collect()}
    want = score()
    monkeypatch.setattr(lm_scoring, "HEAD", 5)
    few = score()
    assert all(few[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())


def test_words_are_a_distribution():
    """Over a vocabulary with all its words, the models' probabilities of words and the end sum to at most 1."""
    vocab = lattice.vocabulary()
    weights = np.tile(lattice.first_weights(vocab) + math.log(0.7), (2, 1))
    counts = np.array([[3, 1, 0], [5, 1, 2]], float)
    mixture = lm_scoring.Mixture(np.array([6, 12]), np.array([3, 4]), np.array([2, 4]), np.array([1, 1]), np.array([0, 1]), weights, np.log([0.3, 0.3]))
    data, at = textbatch.raw(pa.array([b"the", b"of", b"thtion"], pa.binary()))
    terms = mixture.terms(counts, mixture.paths(data, at[:-1], at[1:], None))
    assert ((10 ** terms[1:3]).sum(1) + 10**mixture.end <= 1 + 1e-9).all()
    assert (10**mixture.share).sum() == pytest.approx(1)


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = lm_scoring.lm_scores(docs).where("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert r.a > r.b


def plain_scores(docs, weights, stop):
    """score by the definition: docs (id, text, lang); the pieces' weights and the end's, by model, as fitted."""
    vocab = lattice.vocabulary()
    train = [(t or "", lang) for k, t, lang in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    langs = [lang for lang, _ in sorted(collections.Counter(lang for _, lang in train).items(), key=lambda x: (-x[1], x[0]))]
    models = []
    for k, lang in enumerate([*langs, None]):
        own = [t for t, other in train if lang in (None, other)]
        c = collections.Counter(w for t in own for w in t.lower().split())
        once, twice = (sum(n == m for n in c.values()) for m in (1, 2))
        d = min(max(once / max(once + 2 * twice, 1) if once else 0.5, 0.05), 0.95)
        models.append((c, sum(c.values()) + len(own), len(c) + 1, len(own), d, weights[k], stop[k]))

    def word(k, w):
        c, n, v, _, d, weight, stop = models[k]
        path = math.exp(lattice.one(vocab, weight, b" " + w.encode())[-1] + stop)
        rest = d * v / n * path
        if k < len(langs):
            rest = d * v / n * 0.5 * (path + word(len(langs), w))
        return max(c[w] - d, 0) / n + rest

    shares = [0.9 * m[3] / len(train) for m in models[:-1]] + [0.1]
    out = {}
    for key, text, _ in docs:
        each = [math.log10(s) + sum(math.log10(word(k, w)) for w in (text or "").lower().split()) + math.log10((models[k][3] - models[k][4]) / models[k][1]) for k, s in enumerate(shares)]
        out[key] = max(each) + math.log10(sum(10 ** (e - max(each)) for e in each))
    return out


def made_docs(languages, each):
    rng = np.random.default_rng(2)
    return [(k * languages + j, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}{'xyz'[rng.integers(0, 3)] * rng.integers(1, 4)}" for _ in range(rng.integers(0, 12))), f"l{j:02}") for k in range(each) for j in range(languages)]


@pytest.mark.parametrize("languages,each", [(3, 9), (70, 4)])
def test_scores_by_the_definition(spark, monkeypatch, languages, each):
    """Every language has a model of its own, 70 as well as three."""
    docs = made_docs(languages, each)
    kept = []
    fit = lm_scoring.fit_pieces
    monkeypatch.setattr(lm_scoring, "fit_pieces", lambda *a, **b: kept.append(fit(*a, **b)) or kept[-1])
    monkeypatch.setattr(lm_scoring, "HEAD_TERMS", 20 * languages)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(kept[0][0]) == languages + 1
    want = plain_scores(docs, *kept[0])
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_no_training_rows_and_no_rows(spark, empty):
    assert lm_scoring.lm_scores(empty).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = lm_scoring.lm_scores(spark.createDataFrame([(held, "never seen", "en")], "doc_id long, text string, lang string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0 and math.isfinite(row.score)
