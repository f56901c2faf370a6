"""Sessions: local defaults, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of texts and planes are wide: Spark's default of 10,000 a batch would hold tens of megabytes, several times over, in each executor and worker. A session's own setting stays.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
PACKAGE = Path(__file__).resolve().parents[1]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution; on a cluster, sessions come configured."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each context, so that Python workers can import it; and keep Arrow batches small."""
    if BATCH_ROWS[0] not in spark.conf.getAll:  # only what was set on purpose is there
        spark.conf.set(*BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_tilewright_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="tilewright-"), "tilewright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    context._tilewright_shipped = True
    return spark
