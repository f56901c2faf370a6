"""Helpers that every operator of this subpackage uses: stage tables, the train/held-out split, row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one, kept with the
    context; on a cluster that is an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(context, "_tilewright_shared", None)
        if not found:
            found = context._tilewright_shared = tempfile.mkdtemp(prefix="tilewright-stages-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    tables(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> list[str]:
    """The folders of the stage tables of this context that weren't removed, in the order of their making."""
    context = spark.sparkContext
    if not hasattr(context, "_tilewright_tables"):
        context._tilewright_tables = []
    return context._tilewright_tables


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove stage tables that nothing reads any more."""
    for path in paths:
        tables(spark).remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Remove the stage table that df is."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        drop_tables(spark, [t for t in tables(spark) if t.rsplit("/", 1)[-1] == name.rsplit("/", 2)[-2]])


def crc_mod(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(doc_id.cast("string").cast("binary")) % mod).cast("int")


def held_out(doc_id: Column | str, mod: int) -> Column:
    """True where the remainder is 1. A null id has no crc32 and counts as training."""
    return F.coalesce(crc_mod(doc_id, mod) == 1, F.lit(False))


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's id and text: equal rows share it, rows with one id and different texts don't."""
    return F.xxhash64(*[F.col(c) for c in cols])


def free_name(taken: list[str], base: str) -> str:
    """A column name that no column of the input has."""
    name = base
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name
