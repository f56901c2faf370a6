"""Bounded samples of labelled training rows for the classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import held_out

#: Labels are learned only from rows whose crc32 remainder by SPLIT is not 1.
SPLIT = 3


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most per_class labelled ids for each class, the first by a hash of the id.

    Ids held out are left out. Of several labels for an id, the largest counts; of several texts, that with the smallest hash. The ids are bounded by
    2 * per_class, so they are broadcast.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id, SPLIT)).groupBy(doc_id).agg(F.max(target).cast("int").alias("label"))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64(doc_id), doc_id).limit(per_class) for k in (0, 1)]
    ids = reduce(DataFrame.union, parts)
    found = docs.select(doc_id, text).join(F.broadcast(ids), doc_id)
    return found.groupBy(doc_id).agg(F.min_by(text, F.xxhash64(text)).alias(text), F.first("label").alias("label"))
