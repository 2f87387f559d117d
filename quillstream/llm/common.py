"""Session set-up, tables in the shared folder, row keys: what the operators here have in common."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Rows of an Arrow batch. Texts may be very long, so batches stay short.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Short Arrow batches, a package that Python workers can import, and a checkpoint folder.

    The folder is the one the cluster names in spark.checkpoint.dir; a local one is made only
    where that is unset and all of Spark runs in this process, as in tests."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column) -> Column:
    """A 64-bit key of a text. With the document's id it names a row; rows that agree in both
    are copies of one row and get the same answer."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df and the new columns; these replace columns of the same name in any case."""
    names = {k.lower() for k in new}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names), *(v.alias(k) for k, v in new.items()))
