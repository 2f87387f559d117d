"""A training corpus from documents in five stages, each on all that the one before kept.

All stages take any rows: null ids, texts, languages and sources, empty texts and tables, repeated rows, texts of any
length and further columns, also ones with names that operators use, which stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, language, lines, mixing, neardup
from quillstream.llm.common import prepare, stored, table, with_columns


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    if "n_chars" in columns:
        docs = with_columns(docs, {"n_chars": F.length("text").cast("long")})
    return docs.select(columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) and those that the calibrated model can't place go;
    repeated rows share one fate. A table without labelled rows teaches no language, so that nothing is placed."""
    prepare(spark)
    found = language.identify(docs, language.learn(docs), prefix="__qs_")
    return found.where(~F.col("__qs_rejected")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; near copies, of which the next stage keeps one, count as one page.

    All rows stay. A null text stays null; a null source is a source of its own; repeated rows count as one page."""
    return _measured(lines.dedup_lines(docs, prefix="__qs_", near_copies=True), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id; of equal rows one. Null and
    empty texts, and others without a word, all stay; null ids come last."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that mostly consist of them. A document without a hit stays as it
    is, null and empty ones too; repeated rows share one fate; an empty benchmark changes nothing."""
    return _measured(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, the words that the mix takes of each document, and its slots.

    A null or empty text has size 0, of which nothing is taken; a null source is the last; repeated rows each count."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The language model, signatures and shuffles can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
