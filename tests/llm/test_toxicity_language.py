import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilewright.llm import language_id, queries, textbatch, toxicity


def test_grams_are_those_of_plain_loops():
    found = ["Abcab", "", "né", "xx", "Ünïcode ÉÀ\U0001f600\U0001f601 日本語です Ωμέγα ЖЩ", "plain text again"]
    data, at = textbatch.raw(pa.array(found))
    text, bucket = toxicity.grams(data, at)
    for k, t in enumerate(found):
        one = toxicity.grams(*textbatch.raw(pa.array([t.lower()])))[1]
        assert bucket[text == k].tolist() == one.tolist()
        raw = t.lower()
        assert (text == k).sum() == len({raw[i : i + n] for n in toxicity.SIZES for i in range(len(raw) - n + 1)})


def test_long_texts_in_pieces(monkeypatch):
    """Whatever the size of pieces, n-grams, code lengths and letters are those of the whole text."""
    text = "Ünïcode ÉÀ\U0001f600 日本語です some plain words follow, ΩΜΈΓΑ " * 40
    data, at = textbatch.raw(pa.array([text]))
    whole = toxicity.grams(data, at)[1].tolist()
    counts = []
    for order in range(language_id.ORDER + 1):
        wide, where = language_id.folded(data[:300], np.array([0, 300]))
        keys, n = np.unique(language_id.strings(wide, where, order + 1), return_counts=True)
        counts.append((keys, np.zeros(len(keys), np.int64), n))
    trees = language_id.build(["x"], counts)
    bits = trees.lengths(data, at).tolist()
    letters = language_id.has_letter(*textbatch.raw(pa.array(["€" * 500 + "日"]))).tolist()
    for size in (7, 64, 1001):
        monkeypatch.setattr(language_id, "PIECE", size)
        assert trees.lengths(data, at).tolist() == bits and language_id.has_letter(*textbatch.raw(pa.array(["€" * 500 + "日"]))).tolist() == letters == [True]
    for size in (40, 200, 1001):
        monkeypatch.setattr(textbatch, "PIECE", size)
        assert toxicity.grams(data, at)[1].tolist() == whole


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = ["a bb " + "c" * 500 + " dd\nee " * 30, "", "x" * 100]
    words = textbatch.Words(*textbatch.raw(pa.array(texts)))
    want = words.hashes().tolist()
    for size in (16, 90, 450):
        monkeypatch.setattr(textbatch, "PIECE", size)
        assert words.hashes().tolist() == want


def test_regression_reaches_the_optimum(monkeypatch):
    """The gradient vanishes at the result, and blocks of rows don't change it."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(200)]
    index, bounds = np.concatenate(rows).astype(np.uint16), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    scale, y = rng.normal(size=30), (rng.random(200) < 0.4).astype(float)
    weight = np.where(y == 1, 1.3, 0.8)
    w, b = toxicity.fit_logistic(bounds, index, scale, y, weight)
    x = np.array([[scale[j] if j in r else 0 for j in range(30)] for r in map(set, rows)])
    g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(x.T @ g + toxicity.PENALTY * w).max() < 1e-2 and abs(g.sum()) < 1e-2
    monkeypatch.setattr(toxicity, "BLOCK", 40)
    again = toxicity.fit_logistic(bounds, index, scale, y, weight)
    assert np.allclose(again[0], w) and np.isclose(again[1], b)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op4_char_ngram_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.75 and n.get((0, 1), 0) <= 0.01 * n[0, 0]  # 280 toxic rows to learn from


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, None), (7, 0), (9, 3), (4, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in toxicity.toxicity(edge, labels.where("false")).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).count() == 0


def _brute_bits(counts, data, order):
    """Code length of a byte string by the definition, with contexts looked up in plain dictionaries."""
    total = 0.0
    padded = b"\n" * order + data
    for i in range(order, len(padded)):
        for k in range(order, -2, -1):
            if k < 0:
                total += 8
                break
            seen = counts.get(padded[i - k : i])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if padded[i] in seen:
                total -= math.log2(seen[padded[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
    return total


def test_code_lengths_are_exact(spark):
    train = [("en", "the cat sat on the mat. The hat"), ("fr", "le chat est sur le tapis. à côté"), ("en", "that is it")]
    docs = spark.createDataFrame([(3 * k, t, l) for k, (l, t) in enumerate(train)], "doc_id long, text string, lang string").withColumn("doc_id", F.expr("CASE doc_id WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 9 END"))
    docs = docs.where(~language_id.held_out("doc_id", 3))
    trees = language_id.fit(docs, per_language=1000)
    used = {r.lang for r in docs.collect()}
    assert trees.languages == sorted(used)
    probe = ["the chat", "côté mat zz", "", "q"]
    data, at = textbatch.raw(pa.array(probe))
    got = trees.lengths(data, at) / language_id.UNIT
    for j, lang in enumerate(trees.languages):
        counts = {}
        for r in docs.collect():
            if r.lang == lang:
                padded = b"\n" * 4 + r.text.lower().encode()
                for i in range(4, len(padded)):
                    for k in range(5):
                        counts.setdefault(padded[i - k : i], {}).setdefault(padded[i], 0)
                        counts[padded[i - k : i]][padded[i]] += 1
        for k, t in enumerate(probe):
            assert abs(got[k, j] - _brute_bits(counts, t.encode(), 4)) < 1e-3


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op7_ppm_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.selectExpr("avg(int(lang = lang_pred)) a").first().a > 0.97


def test_language_edges(edge, empty):
    rows = language_id.identify_language(edge).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert {by[k].lang_pred for k in (1, 2, 3, 10)} == {"und"} and by[8].lang_pred != "und"
    assert language_id.identify_language(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Forty languages with words of their own, the later ones less frequent."""
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "xyzuvw")
    rows = [(i, words(k), f"l{k:02}") for i, k in enumerate(k for k in range(40) for _ in range(50 - k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == len(rows) and all(r.lang == r.lang_pred for r in out)


def test_letters():
    data, at = textbatch.raw(pa.array(["12 é", "12 €", "ABC", "", "日本"]))
    assert language_id.has_letter(data, at).tolist() == [True, False, True, False, True]


def test_case_folding_covers_latin_one():
    data, at = textbatch.raw(pa.array(["ÉAß×Ü"]))
    wide, where = language_id.folded(data, at)
    assert wide[where].tobytes().decode() == "éaß×ü"
    assert np.all(np.diff(where) == 1)


def test_model_by_plain_counting(spark):
    """Ratios from counts of documents, and coefficients at which the penalised loss is least."""
    rng = np.random.default_rng(2)
    good, bad = ["apple", "berry", "cherry", "daisy"], ["grumble", "scowl", "berry"]
    rows = [(k, " ".join(rng.choice(bad if k % 3 == 0 else good, 6)), int(k % 3 == 0)) for k in range(150)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    train = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    has = [set(toxicity.grams(*textbatch.raw(pa.array([t])))[1].tolist()) for t, _ in train]
    y = np.array([y for _, y in train])
    d0, d1 = (y == 0).sum(), (y == 1).sum()
    kept = np.flatnonzero(model.wanted)
    x = np.array([[b in h for b in kept] for h in has], float)
    n0, n1 = x[y == 0].sum(0), x[y == 1].sum(0)
    assert set(kept) == {b for h in has for b in h if sum(b in g for g in has) >= toxicity.LEAST_DOCS}
    ratio = np.log((n1 + 1) / (d1 + 2) / ((n0 + 1) / (d0 + 2)))
    w = np.divide(model.weights[kept], ratio, out=np.zeros(len(kept)), where=np.abs(ratio) > 1e-9)
    weight = np.where(y == 1, 0.5 / d1, 0.5 / d0) * len(y)
    g = weight * (1 / (1 + np.exp(-(x @ model.weights[kept] + model.intercept))) - y)
    assert np.abs((x * ratio).T @ g + toxicity.PENALTY * w).max() < 0.05 and abs(g.sum()) < 0.05
    scores = model.scores(*textbatch.raw(pa.array([t for t, _ in train])))
    assert ((scores >= 0.5) == (y == 1)).all()
