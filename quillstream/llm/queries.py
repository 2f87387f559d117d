"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import conversations, copies, decontaminate, htmltext, language, lines, mixing, neardup, neighbours, runs, secrets, suffixes, tokens
from quillstream.llm.common import prepare, table


def vocabulary() -> str:
    """The queries' byte-level vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_report(table(prepare(spark), sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents")).drop("source")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, vocabulary()).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(table(prepare(spark), sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_report(table(prepare(spark), sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "source", "text")
    out = lines.dedup_lines(docs)
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(prepare(spark), sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(prepare(spark), sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(table(prepare(spark), sf_dir, "documents"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_report(table(prepare(spark), sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(prepare(spark), sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontaminate.LEAK_SQL, "op3_source_mixing": mixing.MIX_SQL, "op8_line_dedup": lines.LINES_SQL, "op11_periodic_runs": runs.RUNS_SQL, "op12_exact_copies": copies.COPIES_SQL, "op13_conversation_repair": conversations.REPAIR_SQL}
