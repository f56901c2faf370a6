import collections
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import docstats, quality_classifier, quality_rules, textbatch
from tilewright.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.text(st.sampled_from("ab cé\n\t#| "), max_size=40), max_size=6)


def brute(text):
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def counts(found):
    words = textbatch.Words(*textbatch.raw(pa.array(found, pa.string())))
    base = docstats.base_counts(words, words.hashes())
    return list(zip(*(base[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))


@settings(max_examples=200, deadline=None)
@given(texts)
def test_counts(found):
    assert counts(found) == [brute(t) for t in found]


def test_edges(edge, empty):
    out = quality_rules.quality_rules(edge)
    rows = out.collect()
    assert len(rows) == edge.count()
    for r in rows:
        n = brute(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty).count() == 0


def test_distances_are_symmetric_and_bounded():
    p, q = np.array([[3, 1, 0]]), np.array([[0, 1, 3]])
    d = quality_rules.distances(p, q)[0, 0]
    assert d == quality_rules.distances(q, p)[0, 0] and 0 < d < 1
    assert quality_rules.distances(p, p)[0, 0] == 0 and quality_rules.distances(np.array([[1, 0]]), np.array([[0, 1]]))[0, 0] == 1


def test_rules_follow_labels(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op1_distribution_divergence"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.96
    assert n.get((0, False), 0) / (n.get((0, False), 0) + n.get((0, True), 0)) > 0.9


def test_forest_matches_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + (x[:, 1] > 0.3) > 0.5).astype(float)
    forest = quality_classifier.grow(x, y, np.ones(400))

    def walk(row):
        total = forest.base
        for k in forest.roots:
            while forest.left[k] != k:
                k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            total += forest.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x), [walk(r) for r in x])
    assert ((forest.scores(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op6_boosted_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").selectExpr("avg(int(predicted = quality)) a").first()
    assert found.a > 0.97


def test_classifier_edges(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, None, 1), (7, 1, 0), (9, 0, 0), (10, 1, 5)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.quality(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    none = quality_classifier.quality(edge, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.quality(empty, labels).count() == 0


def test_every_language_has_a_reference(spark):
    """Seventy languages with words of their own: each text is nearest to its language, and a text of foreign words is far from all."""
    rng = np.random.default_rng(6)
    word = lambda k: f"{chr(97 + k % 26)}{chr(97 + k // 26)}{'xyzuvw'[rng.integers(0, 6)]}"
    rows = [(70 * i + k, " ".join(word(k) for _ in range(80)), f"l{k:02}") for k in range(70) for i in range(3)] + [(999, " ".join(f"{j}##{j}" for j in range(80)), None)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert all(out[k].nearest == lang and out[k].kept != out[k].base_failed for k, _, lang in rows[:-1]) and not out[999].kept


def test_common_words_by_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "COMMON_WORDS", 3)
    monkeypatch.setattr(quality_rules, "FLUSH", 4)
    rng = np.random.default_rng(7)
    rows = [(k, " ".join(rng.choice(["The", "the", "a", "B", "né", "zz", "ÉÉ"], 9)), ["en", "fr", None][k % 3]) for k in range(60)]
    want = set()
    for lang in ("en", "fr"):
        n = collections.Counter(w for _, t, own in rows if own == lang for w in re.sub("[A-Z]", lambda m: m[0].lower(), t).split())
        want |= {w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:3]}
    got = quality_rules.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert set(got) == want and len(got) == len(want)


def test_counts_do_not_depend_on_pieces(monkeypatch):
    found = ["a b c d e\n" * 30 + "é" * 50, "", "# x\n" * 20]
    lexicon = quality_rules.Lexicon(["a", "x"])

    def both():
        words = textbatch.Words(*textbatch.raw(pa.array(found)))
        return counts(found), [x.tolist() for x in quality_rules.histograms(words, words.hashes(lower=True), lexicon)]

    want = both()
    for size in (16, 100):
        monkeypatch.setattr(textbatch, "PIECE", size)
        assert both() == want


def plain_statistics(text):
    """FEATURES of one text by plain Python."""
    words = WORD.findall(text)
    n, repeats = max(len(words), 1), brute(text)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    lines = [x for x in text.split("\n") if x]
    rows = max(len(lines), 1)
    classes = collections.Counter()
    for c in text:
        name = "wide" if ord(c) >= 128 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "space" if c in " \t\n\r\x0b\x0c" else "sentence" if c in quality_rules.SENTENCE else "symbol"
        classes[name] += 1
    shares = [classes[c] / max(len(text), 1) for c in quality_rules.CLASSES]
    common = [w for w in lower if w in quality_classifier.LEXICON.words]
    log = lambda x: float(np.log1p(x))
    return [
        log(len(words)), log(len(text)), repeats[1] / n, log(max((len(w.encode()) for w in words), default=0)), repeats[2] / max(len(text), 1), repeats[4] / n, repeats[3] / rows, log(rows), log(len(words) / rows), len(set(words)) / n,
        len(common) / n, len(set(common)) / min(n, len(quality_classifier.LEXICON.words)), *shares, sum("A" <= w[0] <= "Z" for w in words) / n, sum(x[-1] in ".!?:\"'" for x in lines) / rows,
        sum(len(w.encode()) == 1 for w in words) / n, -sum(s * np.log2(s) for s in shares if s), sum(w[-1] == "!" for w in words) / n,
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Theof cé\n\t#|!.\"9Z"), max_size=60), min_size=1, max_size=5))
def test_statistics_by_plain_python(found):
    got = quality_classifier.statistics(*textbatch.raw(pa.array(found, pa.string())))
    assert got.shape == (len(found), len(quality_classifier.FEATURES))
    assert np.allclose(got, [plain_statistics(t) for t in found])


def test_first_split_is_the_best(monkeypatch):
    """A tree's root by trying every feature and cut."""
    monkeypatch.setattr(quality_classifier, "TREES", 1)
    monkeypatch.setattr(quality_classifier, "DEPTH", 1)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (150, 4)).astype(float)
    y = (x[:, 2] + rng.normal(0, 4, 150) > 11).astype(float)
    forest = quality_classifier.grow(x, y, np.ones(150))
    p = y.mean()
    g, h = p - y, np.full(150, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_classifier.PENALTY)
    gains = {(j, c): score(x[:, j] <= c) + score(x[:, j] > c) for j in range(4) for c in np.unique(x[:, j]) if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= quality_classifier.LEAST_ROWS}
    root = forest.roots[0]
    assert gains[forest.feature[root], np.floor(forest.threshold[root])] >= max(gains.values()) - 1e-9
    for side, mask in ((forest.left[root], x[:, forest.feature[root]] <= forest.threshold[root]), (forest.right[root], x[:, forest.feature[root]] > forest.threshold[root])):
        assert np.isclose(forest.value[side], -quality_classifier.RATE * g[mask].sum() / (h[mask].sum() + quality_classifier.PENALTY))
