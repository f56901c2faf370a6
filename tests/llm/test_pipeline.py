import collections
import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from test_decontamination import brute as contamination
from test_jaccard import brute as near
from tilewright.llm import packing, quality_rules, surrogates

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    """The survivors are those of brute-force stages, and the pieces hold exactly their surrogate texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in quality_rules.quality_rules(docs).where("kept").collect()]
    first = {k: c for k, _, c in near(kept)}
    kept = [(k, t) for k, t in kept if first[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(k, t) for k, t in kept if not contamination(t, items)[4]]
    new = {r.doc_id: r.text for r in surrogates.pseudonymize(spark.createDataFrame(kept, "doc_id long, text string"), surrogates.TEST_KEY).collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(new)
    covered = collections.Counter()
    for r in pieces:
        ids = packing.token_ids(new[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
    assert all(covered[k] == len(packing.token_ids(t)) for k, t in new.items())


def test_no_text_is_lost(spark):
    """Rows that share an id, or have none, are judged by their texts; unknown columns pass."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (None, c, 4), (None, c, 5), (7, d, 6), (None, d, 7), (8, None, 8), (9, "", 9), (9, "", 9), (None, a + " z", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert out.columns == docs.columns and got == sorted([("1", a), ("5", b), ("None", c), ("7", d), ("8", "None"), ("9", "")])


def test_unknown_columns_pass(spark):
    text = " ".join("the cat and dog of that house went to see it with more friends".split() * 1) + " " + " ".join(f"word{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, 5, "x", 2), (2, "short", 6, "y", 3)], "doc_id long, text string, n_words int, kept string, row_key int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [tuple(r)[2:] for r in out.where("doc_id = 1").collect()] == [(5, "x", 2)]


def test_stage_tables_go(spark):
    from tilewright.llm import shared

    before = list(shared.tables(spark))
    corpus_pipeline.run(spark, SF)
    assert len(shared.tables(spark)) == len(before) + 1


def test_stages_keep_the_columns_and_bear_edges(spark, edge, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge.select(columns), empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == columns and out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_every_query_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_inputs_by_spark_only_paths(spark):
    """Queries read their tables through Spark alone."""
    out = entry.queries()["op1_distribution_divergence"](spark, f"file://{SF}")
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
