"""Filters over articles and news."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates
from quillstream.functions.text import PLACEHOLDER_SUMMARIES, filled, search_fold
from quillstream.operators.lookup import OTHER

PROMO = ("BISTECH", "KAP")
AGGREGATOR = "news.google.com"
# Local outlets of one region that can be taken out.
REGION_SOURCES = ("%KKTC%", "%Lefkoşa%", "%Lefkosa%")
REGION_DOMAINS = ("kibrispostasi.com", "kibrisgazetesi.com", "haberkibris.com", "yeniduzen.com", "brtk.net", "gundemkibris.com", "kibrisnethaber.com")


def on_day(day: str, date: str = "publish_date") -> Column:
    """Whether a date text lies on a day: a range of texts, so that it reaches the scan."""
    return F.col(date).between(f"{day} 00:00:00", f"{day} 23:59:59")


def is_relevant(status: str = "relevance_status", flag: str = "ilgili_mi") -> Column:
    s = F.col(status)
    return F.coalesce(s.ilike("Stage 1%") | s.ilike("Stage 2%") | (s == "İlgili"), F.lit(False)) | F.coalesce(F.col(flag) == 1, F.lit(False))


def since_midnight(as_of: str, date: str = "publish_date") -> Column:
    return F.col(date) >= f"{as_of[:10]} 00:00:00"


def is_aggregator(link: Column) -> Column:
    return F.contains(filled(link), F.lit(AGGREGATOR))


def blocked(sources: tuple[str, ...] = REGION_SOURCES, domains: tuple[str, ...] = REGION_DOMAINS) -> Column:
    """Whether the source is like one of the patterns or the link holds one of the domains; null counts as no."""
    tests = [F.col("source_name").ilike(s) for s in sources] + [F.col("link").ilike(f"%{d}%") for d in domains]
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in tests)), F.lit(False))


def outdated_reason(as_of: str) -> Column:
    """Which date of a row lies before the day: the column's, else the title's, else that of the first 500 characters
    of the summary; null if none does."""
    cutoff = f"{as_of[:10]} 00:00:00"
    before = lambda d: F.coalesce(d < cutoff, F.lit(False))
    column = F.date_format(F.try_to_timestamp(F.col("publish_date"), F.lit(dates.FORM)), dates.FORM)
    title, summary = dates.text_date(F.col("title")), dates.text_date(F.substring(filled(F.col("summary")), 1, 500))
    return F.when(before(column), F.concat(F.lit("DB date was "), F.col("publish_date"))).when(before(title), F.concat(F.lit("Title contained "), F.substring(title, 1, 10))).when(before(summary), F.concat(F.lit("Summary contained "), F.substring(summary, 1, 10)))


def needs_body(summary: str = "summary") -> Column:
    return F.length(F.trim(filled(F.col(summary)))) < 50


def backfill(news: DataFrame, limit: int = 40) -> DataFrame:
    """The newest relevant rows without a full summary."""
    s = F.col("summary")
    thin = s.isNull() | s.isin("", *PLACEHOLDER_SUMMARIES) | s.like("%...") | (F.length(s) < 60)
    return news.where((F.col("ilgili_mi") == 1) & thin).orderBy(F.desc("publish_date"), F.desc("id")).limit(limit)


def is_promo(title: str = "title") -> Column:
    return reduce(lambda a, b: a & b, (F.contains(filled(F.col(title)), F.lit(p)) for p in PROMO))


def in_tab(tab: str = "all", sub_tab: str = "all", first: str = "Azerbaycan") -> Column:
    """Whether a row shows under a tab: relevant, and its category holds the tab and, under the first one, the sub-tab."""
    if tab == "all":
        return F.lit(True)
    category, fold = search_fold(F.col("ilgi_kategorisi")), lambda x: search_fold(F.lit(x))
    yes = F.coalesce(F.col("ilgili_mi") == 1, F.lit(False)) & F.contains(category, fold(tab))
    return yes & (F.lit(sub_tab == "all") | (fold(tab) != fold(first)) | F.contains(category, fold(sub_tab)))


def of_source(source: str = "all") -> Column:
    if source == "all":
        return F.lit(True)
    return (F.col("is_other") | (F.col("category") == OTHER)) if source == "other" else F.col("source_name") == source


def found_by(query: str) -> Column:
    """Whether title, source or category holds the query, in lower case."""
    q = query.strip().lower()
    return F.lit(True) if not q else reduce(lambda a, b: a | b, (F.contains(F.lower(filled(F.col(c))), F.lit(q)) for c in ("title", "source_name", "ilgi_kategorisi")))


def unknown_links(items: DataFrame, stored: DataFrame, order: str = "ord") -> DataFrame:
    """items with a link that isn't stored, the first of each link."""
    from quillstream.operators.dedup import first_of

    new = items.where(filled(F.col("link")) != "").join(stored.select(F.col("link").alias("_l")).distinct(), F.col("link") == F.col("_l"), "left_anti")
    return first_of(new, ["link"], [F.col(order)])


def dirty_rows(news: DataFrame, sources: tuple[str, ...] = ("%Haber7%",)) -> DataFrame:
    """Rows that must not be stored: of given sources, or with a title that still starts with a time or alert label. A longer
    number, such as an address, is no time."""
    from quillstream.functions.text import clean_leading_time

    bad = reduce(lambda a, b: a | b, (F.col("source_name").ilike(s) for s in sources))
    return news.where(bad | (clean_leading_time(F.col("title"), numbers=True) != F.col("title")))
