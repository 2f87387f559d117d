"""Batches written between the stages of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str | None = None) -> str:
    """The checkpoint folder the cluster names, or a new one in it. One is made only where none is named and all of Spark
    runs in this process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quillstream-"))
    top = sc.getCheckpointDir()
    return f"{top}/{name}-{uuid.uuid4().hex}" if name else top


#: Rows and bytes of an Arrow batch of pages.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Batches for Python steps whose rows are pages: a worker holds all pages of a batch, and what it read of them, at once,
    so that batches of Spark's 10,000 rows grow with a task's input. Shorter settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def cut(rows: DataFrame) -> DataFrame:
    """rows as they are now, in the checkpoint folder: what follows neither copies their expressions nor computes them
    again."""
    folder(rows.sparkSession)
    return rows.checkpoint()
