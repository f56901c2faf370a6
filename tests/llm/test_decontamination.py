import hashlib
import random
import re

from tilewright.llm import decontamination as d


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, content in items:
        w = words(content)
        size = min(13, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if size and tuple(own[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item))
    listed = ",".join(sorted(found))
    return len(own), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)


def got(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_random_texts(spark):
    rng = random.Random(3)
    vocab = ["a", "the", "É", "é", "ß", "x1", "qu", "Of"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "-", "\n", ", "]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 13, 14, 30]))) for k in range(12)] + [(50, None), (7, "shared id of another text"), (60, "the the the")]
    docs = []
    for k in range(60):
        body = text(rng.randint(0, 30))
        if rng.random() < 0.6:
            source = rng.choice(items)[1] or ""
            body += " " + (source.upper() if source.isascii() else source) + " " + text(rng.randint(0, 200))
        docs.append((k, body))
    docs += [(60, None), (61, "THE the"), (61, "THE the"), (61, "other"), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench)
    assert got(out) == sorted((str(k), *brute(t, items)) for k, t in docs)


def test_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "one two three four"), (2, ""), (3, None)], "item_id long, text string")
    items = [(1, "one two three four")]
    assert got(d.decontaminate(edge, bench)) == sorted((str(r.doc_id), *brute(r.text, items)) for r in edge.collect())
    assert d.decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in d.decontaminate(edge, bench.where("false")).collect()} == {0}


def test_shuffled_joins_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = got(d.decontaminate(docs, bench))
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert got(d.decontaminate(docs, bench)) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x alpha"), (2, "beta alpha"), (3, "alpha x x x x beta")], "doc_id long, text string")
    index = d.positional_index(docs, spark.createDataFrame([("alpha",), ("beta",)], "term string"))
    pairs = spark.createDataFrame([("p", "alpha", "beta")], "pair string, a string, b string")
    for distance in (1, 2, 3, 4, 9):
        plain = 0
        for text in ("alpha x x beta x alpha", "beta alpha", "alpha x x x x beta"):
            w = text.split()
            plain += sum(1 for i, p in enumerate(w) for j, q in enumerate(w) if p == "alpha" and q == "beta" and abs(i - j) <= distance)
        assert d.proximity_matches(index, pairs, distance).count() == plain


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = d.decontaminate(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
