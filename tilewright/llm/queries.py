"""The queries of this subpackage, by the names that the entry file registers, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontamination, html_extraction, jaccard_join, language_id, lm_scoring, packing, quality_classifier, surrogates, toxicity
from tilewright.llm import quality_rules as rules
from tilewright.llm import sql
from tilewright.plans.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(_table(spark, sf_dir, "pages"))


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_char_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(_table(spark, sf_dir, "documents"))


def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row")


def op9_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents")).drop("node", "label", "row")


def op5_surrogate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.session_key(spark), count="n_entities")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_distribution_divergence": op1_distribution_divergence,
    "op2_host_suffix_array": op2_host_suffix_array,
    "op3_lexical_packing": op3_lexical_packing,
    "op4_char_ngram_toxicity": op4_char_ngram_toxicity,
    "op5_surrogate_generation": op5_surrogate_generation,
    "op6_boosted_quality": op6_boosted_quality,
    "op7_ppm_language": op7_ppm_language,
    "op8_positional_index": op8_positional_index,
    "op9_vertical_jaccard": op9_vertical_jaccard,
    "op10_subword_lattice": op10_subword_lattice,
}

ORACLES: dict[str, str] = {
    "op1_distribution_divergence": sql.quality_rules(),
    "op8_positional_index": sql.decontamination(),
    "op9_vertical_jaccard": sql.jaccard_join(),
}
