"""Schemas of the engine's tables, and the articles view over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWS = """id bigint, source_id string, source_name string, category string, title string, summary string, author string,
publish_date string, link string, relevance_status string, llm_relevance_explanation string, relevance_aspect string,
inconsistency_status int, inconsistency_note string, group_id string, scraped_at string, veri_kaynagi string,
ilgili_mi int, ilgi_kategorisi string, guven_skoru double, gerekce string"""

RAW_ARTICLE = """ord bigint, source_id string, source_name string, category string, title string, summary string,
author string, publish_date string, link string, scraped_at string, veri_kaynagi string"""

#: Values that columns added later take where a stored table lacks them.
LATER_COLUMNS = {"veri_kaynagi": "Scraping", "ilgili_mi": 0, "ilgi_kategorisi": "İlgisiz", "guven_skoru": 0.0, "gerekce": ""}


def migrated(news: DataFrame) -> DataFrame:
    """A stored table in the present schema: missing columns take their defaults, or null."""
    fields = [x.strip().split(" ") for x in NEWS.replace("\n", " ").split(",")]
    have = set(news.columns)
    return news.select(*((F.col(n) if n in have else F.lit(LATER_COLUMNS.get(n))).cast(t).alias(n) for n, t in fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as news: the first line is the title, the rest the summary, spread over three days."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.floor(F.col("doc_id") / 20), F.lit(3)).cast("int")).cast("string")
    minute = (F.col("doc_id") * 37) % 1440
    clock = F.format_string("%02d:%02d:00", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("category"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\n') + 1)")).otherwise("").alias("summary"),
        F.concat(day, F.lit(" "), clock).alias("publish_date"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("link"),
    )


ARTICLES_SQL = r"""articles AS (
  SELECT doc_id AS id, source AS source_name, lang AS category, split_part(text, chr(10), 1) AS title,
    CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS summary,
    strftime(DATE '2024-01-01' + CAST((doc_id // 20) % 3 AS INTEGER), '%Y-%m-%d') || ' '
      || lpad(CAST(((doc_id * 37) % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((doc_id * 37) % 1440) % 60 AS VARCHAR), 2, '0') || ':00' AS publish_date,
    'https://' || source || '.example.com/' || doc_id AS link
  FROM documents)"""
