"""Aggregates and pages of a dashboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillstream.functions.text import day_of, filled, source_slug, turkish_lower
from quillstream.operators.filters import found_by, in_tab, of_source, on_day, since_midnight
from quillstream.operators.stages import cut

# The countries counted, by spellings of which one is in the category.
COUNTRY_MARKS = {"azerbaycan": ("azerbaycan",), "kazakistan": ("kazakistan",), "kirgizistan": ("kırgızistan", "kirgizistan"), "ozbekistan": ("özbekistan", "ozbekistan"), "turkmenistan": ("türkmenistan", "turkmenistan"), "kktc": ("kktc",)}
SUMMARY_CATEGORIES = {"mainstream": "Resmi / Ana Akım", "pro_government": "İktidar Yanlısı", "opposition": "Muhalif"}


def _count(condition) -> F.Column:
    return F.count(F.when(condition, 1))


def daily_summary(news: DataFrame, day: str, categories: dict[str, str] = SUMMARY_CATEGORIES) -> DataFrame:
    """One row: all and relevant rows of a day, and of each category."""
    return news.where(on_day(day)).agg(F.count("*").alias("total"), _count(F.col("ilgili_mi") == 1).alias("relevant"), *(_count(F.col("category") == c).alias(n) for n, c in categories.items()))


def per_source(news: DataFrame) -> DataFrame:
    return news.groupBy("source_name").agg(F.count("*").alias("articles"))


def threshold_groups(news: DataFrame, least: int = 10, by: str = "source_name") -> DataFrame:
    """Groups of at least `least` articles, and one of all others (is_other)."""
    counts = news.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("articles"))
    own = counts.where(F.col("articles") >= least).select("name", source_slug(F.col("name")).alias("slug"), F.lit(False).alias("is_other"), "articles")
    other = counts.where(F.col("articles") < least).agg(F.sum("articles").alias("articles")).where("articles is not null")
    return own.unionByName(other.select(F.lit("other").alias("name"), F.lit("other").alias("slug"), F.lit(True).alias("is_other"), "articles"))


def country_counts(news: DataFrame, marks: dict[str, tuple[str, ...]] = COUNTRY_MARKS) -> DataFrame:
    """One row: relevant rows, and those of each country; a row counts for every country its category names."""
    from functools import reduce

    category = F.trim(turkish_lower(F.col("ilgi_kategorisi")))
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(category, F.lit(w)) for w in words))
    return news.where("ilgili_mi = 1").agg(F.count("*").alias("relevant"), *(_count(has(w)).alias(c) for c, w in marks.items()))


def per_aspect(news: DataFrame, by: str = "ilgi_kategorisi") -> DataFrame:
    return news.where("ilgili_mi = 1").groupBy(by).agg(F.count("*").alias("articles"))


def filtered_and_all(news: DataFrame, condition) -> DataFrame:
    return news.agg(F.count("*").alias("total"), _count(condition).alias("filtered"))


def past_and_today(news: DataFrame, as_of: str) -> DataFrame:
    return news.agg(_count(~since_midnight(as_of)).alias("past"), _count(since_midnight(as_of)).alias("today"))


def recent_days(news: DataFrame, limit: int = 30) -> DataFrame:
    return news.select(day_of(F.col("publish_date")).alias("day")).distinct().orderBy(F.desc("day")).limit(limit)


def quick_days(days: DataFrame, as_of: str, selected: str, quick: int = 3) -> DataFrame:
    """day, place, is_quick: today comes first if missing; the newest few are quick, as is the selected day if known.

    days has a row for each day, so one task orders them."""
    today = days.sparkSession.range(1).select(F.lit(as_of[:10]).alias("day"), F.lit(True).alias("missing"))
    all_ = days.select("day", F.lit(False).alias("missing")).unionByName(today).groupBy("day").agg(F.min("missing").alias("missing"))
    ranked = all_.withColumn("place", F.row_number().over(Window.orderBy(F.desc("missing"), F.desc("day"))))
    return ranked.select("day", "place", ((F.col("place") <= quick) | (F.col("day") == selected)).alias("is_quick"))


def source_groups(news: DataFrame, least: int = 10) -> DataFrame:
    """Rows with the place of their source's group: by number of articles, the pooled others last."""
    counts = per_source(news)
    own = counts.where(F.col("articles") >= least).withColumn("group_rank", F.row_number().over(Window.orderBy(F.desc("articles"), "source_name")))
    groups = counts.join(own.select("source_name", "group_rank"), "source_name", "left")
    last = own.agg((F.coalesce(F.max("group_rank"), F.lit(0)) + 1).alias("_last"))
    groups = groups.select(F.col("source_name").alias("_s"), F.col("group_rank").isNull().alias("is_other"), F.coalesce("group_rank", last.scalar()).alias("group_rank"))
    return news.join(groups, news.source_name == F.col("_s")).drop("_s")


def adapter_health(items: DataFrame, as_of: str) -> DataFrame:
    """Per source what was fetched and how much of it is of today."""
    return items.groupBy("source_name").agg(F.count("*").alias("fetched"), _count(since_midnight(as_of)).alias("today"))


def newest_per_label(news: DataFrame, labels: list[str], n: int = 2) -> DataFrame:
    """The newest n relevant rows whose category holds each label; a row may show under several."""
    array = F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(F.col("ilgi_kategorisi"), x))
    tagged = news.where("ilgili_mi = 1").withColumn("label", F.explode(array))
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("publish_date"), F.desc("id")))
    return tagged.withColumn("turn", turn).where(F.col("turn") <= n)


def newest_first(news: DataFrame, newest: bool = True) -> DataFrame:
    return news.orderBy(F.desc("publish_date"), F.desc("id")) if newest else news.orderBy("publish_date", "id")


def page(news: DataFrame, tab: str = "all", sub_tab: str = "all", source: str = "all", query: str = "", shown: int = 50, newest: bool = True) -> DataFrame:
    """The first `shown` rows that pass all filters, with `matches`, the number that do: counted as the rows pass on their
    way to the page, so that neither filters nor what made the columns run twice."""
    seen = Observation("matches")
    rows = news.where(in_tab(tab, sub_tab) & of_source(source) & found_by(query)).observe(seen, F.count(F.lit(1)).alias("n"))
    first = cut(newest_first(rows, newest).limit(shown))
    return newest_first(first.withColumn("matches", F.lit(seen.get["n"]).cast("long")), newest)


def run_metrics(fetched: DataFrame, saved: DataFrame, began: str | None = None, ended: str | None = None) -> DataFrame:
    """Of one cycle: fetched, saved and relevant rows, and the seconds between two moments, null if one isn't given."""
    n, relevant = saved.agg(F.count("*")).scalar(), saved.agg(_count(F.col("ilgili_mi") == 1)).scalar()
    return fetched.agg(F.count("*").alias("fetched")).withColumns({"saved": n, "relevant": relevant, "duration_seconds": F.unix_timestamp(F.lit(ended)).cast("double") - F.unix_timestamp(F.lit(began)).cast("double")})


def observed_run(items: DataFrame, saved: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], began: str | None = None, ended: str | None = None) -> DataFrame:
    """What run_metrics says, counted in the one pass that writes saved(items): nothing is computed for the counts alone."""
    seen, kept = Observation("fetched"), Observation("saved")
    rows = saved(items.observe(seen, F.count(F.lit(1)).alias("n")))
    write(rows.observe(kept, F.count(F.lit(1)).alias("n"), F.count_if(F.col("ilgili_mi") == 1).alias("relevant")))
    one = items.sparkSession.createDataFrame([(seen.get["n"], kept.get["n"], kept.get["relevant"])], "fetched long, saved long, relevant long")
    return one.withColumn("duration_seconds", F.unix_timestamp(F.lit(ended)).cast("double") - F.unix_timestamp(F.lit(began)).cast("double"))


def with_other_flag(news: DataFrame, least: int = 10) -> DataFrame:
    """news with is_other: whether its source has fewer articles than a group of its own needs."""
    small = per_source(news).where(F.col("articles") < least).select(F.col("source_name").alias("_s"), F.lit(True).alias("_o"))
    return news.join(small, filled(news.source_name) == filled(F.col("_s")), "left").withColumn("is_other", F.coalesce("_o", F.lit(False))).drop("_s", "_o")
