"""The corpus pipeline: documents in, packed token sequences out. Each stage's result is written as Parquet and read again by the next.

All stages take an empty table, nulls in any column, empty and long texts, repeated rows, and columns beyond doc_id and text, which pass through
whatever their names; what each does with them is said at the stage. Rows are known by id and text together (row_key), so rows that share an id, or have none,
are judged apart. A text is held whole by the tasks that read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontamination, jaccard_join, packing, quality_rules, surrogates
from tilewright.llm.shared import drop_tables, free_name, row_key, stage_table, tables
from tilewright.plans.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text has no words and goes; rows with a null id or lang are judged like others; without a column lang no document is too far from
    any language. Repeated rows fare alike.
    """
    ship(spark)
    row = free_name(docs.columns, "row_key")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    named = docs.withColumnsRenamed({c: f"{row}_{k}" for k, c in enumerate(docs.columns) if c != "text"}).withColumn("lang", lang if "lang" not in docs.columns else F.col(f"{row}_{docs.columns.index('lang')}"))
    kept = quality_rules.quality_rules(named).where("kept")
    return kept.select(*[F.col("text" if c == "text" else f"{row}_{k}").alias(c) for k, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect one row stays: that with the smallest id, null ids last, and of those the smallest row key.

    So of rows with one id and different texts all stay that aren't linked; of equal rows one stays. Texts without words link with nothing.
    """
    ship(spark)
    row = free_name(docs.columns, "row_key")
    linked = stage_table(jaccard_join.jaccard_components(docs.select("doc_id", "text")).select("doc_id", "label", "row"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = linked.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first.row <> last.row OR first.doc_id <> last.doc_id")
    gone = linked.join(_small(first.select("label", F.col("first.row").alias("stays"))), "label").where("row <> stays").select(F.col("row").alias(row)).distinct()
    again = _small(linked.groupBy(F.col("row").alias(row)).count().where("count > 1").select(row))
    kept = docs.withColumn(row, row_key("doc_id", "text")).join(_small(gone), row, "left_anti")
    repeated = kept.join(again, row, "left_semi").dropDuplicates([row])
    return kept.join(again, row, "left_anti").unionByName(repeated).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a share of words lies in benchmark passages go.

    A null or empty text has no words and stays; repeated rows fare alike; an empty benchmark contaminates nothing.
    """
    ship(spark)
    judged = decontamination.decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    row = free_name(docs.columns, "row_key")
    gone = judged.where("contaminated").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key("doc_id", "text")).join(_small(gone), row, "left_anti").select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates under the session's key; no document goes. n_chars, where there is one, follows the new text.

    A null text stays null; texts without entities stay as they are, to the byte; equal texts get equal surrogates.
    """
    ship(spark)
    new = surrogates.pseudonymize(docs, surrogates.session_key(spark))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids.

    A null text counts as empty: one closing token. Every row is packed, repeated ones and such without an id too.
    """
    ship(spark)
    return packing.pack_documents(docs)


def _small(rows: DataFrame) -> DataFrame:
    """A stage table of the rows, broadcast if their counted number is within a bound."""
    rows = stage_table(rows, "removed")
    return decontamination.checked_broadcast(rows, rows.count())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("private_data", private_data),
    ("packing", packed),
]

#: SQL can express neither the surrogates nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table. When a stage's result is written, the tables it made and the result before it are removed."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = list(tables(spark))
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
        drop_tables(spark, [t for t in tables(spark)[:-1] if t not in before])
    return docs
