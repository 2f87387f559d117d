"""One ingest cycle and one dashboard reading, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates
from quillstream.functions.lexicon import Lexicon
from quillstream.functions.text import clean_leading_time, filled, is_junk_title
from quillstream.operators import classify, dedup, filters, lookup, report, upsert
from quillstream.operators.stages import cut


def arrivals(items: DataFrame, news: DataFrame, as_of: str, zone: str = "UTC") -> DataFrame:
    """Items (RAW_ARTICLE) worth a look: of today, no junk, with a new link and story, no near-duplicate of their
    source and day, stored ones included. All cheap tests come before the fold."""
    date = dates.with_title_time(dates.pipeline_date(F.col("publish_date"), as_of, zone), F.col("title"))
    rows = items.withColumn("publish_date", date).withColumn("title", clean_leading_time(F.col("title"))).where(filters.since_midnight(as_of))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    # only what the tests read travels, and is written once: the fold reads it several times
    facts = ("source_name", "title", "publish_date", "link", "ord", "_row")
    new = filters.unknown_links(rows.select(*facts).where(~is_junk_title(F.col("title"))), news)
    new = cut(dedup.new_stories(new, news))
    today = news.where(filters.since_midnight(as_of)).withColumns({"ord": F.col("id") - F.lit(1 << 62), "_row": F.lit(None).cast("long")})
    both = cut(today.select(*facts)).unionByName(new)
    kept = dedup.near_survivors(both, dedup.INGEST, order="ord").where("_row is not null").select("_row")
    return rows.join(kept, "_row", "left_semi").drop("_row")


def with_bodies(items: DataFrame, bodies: DataFrame, as_of: str) -> DataFrame:
    """items whose thin summaries and dates are those of fetched pages (link, body, page_date); then of today only."""
    b = bodies.select(F.col("link").alias("_l"), "body", "page_date")
    rows = items.join(b, items.link == F.col("_l"), "left")
    thin = filters.needs_body()
    rows = rows.withColumn("publish_date", F.when(thin, F.coalesce("page_date", "publish_date")).otherwise(F.col("publish_date"))).withColumn("summary", F.when(thin & (filled(F.col("body")) != ""), F.col("body")).otherwise(F.col("summary")))
    return rows.drop("_l", "body", "page_date").where(filters.since_midnight(as_of))


def judged(items: DataFrame, news: DataFrame, lexicon: Lexicon, sources: DataFrame, as_of: str, bodies: DataFrame | None = None, verdicts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The items of a cycle that are stored: provenance, arrivals, bodies, two stages of classification."""
    searched = F.col("veri_kaynagi") == "SerpApi"
    tagged = lookup.with_provenance(items.where(~F.coalesce(searched, F.lit(False))), sources).unionByName(items.where(searched), allowMissingColumns=True)
    rows = cut(arrivals(tagged, news, as_of))
    rows = rows if bodies is None else with_bodies(rows, bodies, as_of)
    found = classify.labelled(cut(classify.with_stage1(rows, lexicon)))
    if verdicts is not None:
        found = classify.with_stage2(found.withColumn("id", F.col("ord")), verdicts).drop("id")
    return found.drop("stage1")


def ingest(items: DataFrame, news: DataFrame, lexicon: Lexicon, sources: DataFrame, as_of: str, bodies: DataFrame | None = None, verdicts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The stored table after a cycle."""
    return upsert.merged(news, judged(items, news, lexicon, sources, as_of, bodies, verdicts), as_of)


def dashboard(news: DataFrame, day: str, only_relevant: bool = False, least: int = 10) -> DataFrame:
    """A day's articles as they are read: deduplicated, with resolved category, is_other and their group's place."""
    rows = news.where(filters.on_day(day))
    rows = dedup.for_reading(rows.where(filters.is_relevant()) if only_relevant else rows)
    rows = lookup.with_category(report.with_other_flag(rows, least)).withColumn("category", F.col("resolved")).drop("resolved")
    return report.source_groups(rows.drop("is_other"), least)
