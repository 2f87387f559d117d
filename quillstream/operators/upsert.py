"""Changes to the stored table as new versions of it: upsert, updates by id, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import clean_leading_time, filled, is_full_summary
from quillstream.operators.classify import GENERAL, NOT_RELEVANT, STAGE_2
from quillstream.operators.stages import cut

# What an insert stores where an item has nothing.
DEFAULTS = {"source_id": "", "source_name": "Bilinmeyen", "category": "Resmi / Ana Akım", "author": "", "relevance_status": "", "llm_relevance_explanation": "", "relevance_aspect": "", "inconsistency_status": 0, "inconsistency_note": "", "group_id": "", "veri_kaynagi": "Scraping"}
MERGED = ("author", "relevance_status", "llm_relevance_explanation", "relevance_aspect", "inconsistency_status", "inconsistency_note", "group_id", "veri_kaynagi", "ilgili_mi", "ilgi_kategorisi", "guven_skoru", "gerekce")


def prepared(items: DataFrame, as_of: str, numbers: bool = False) -> DataFrame:
    """items (with ord) as they are stored: cleaned, with defaults. A relevant item's missing or zero score is 1. `numbers`
    keeps leading numbers that are longer than a time."""
    col = lambda c, kind="string": F.col(c) if c in items.columns else F.lit(None).cast(kind)
    flag = F.when(col("ilgili_mi").cast("string").isin("1", "true"), 1).otherwise(0)
    score = F.when(F.coalesce(col("guven_skoru", "double"), F.lit(0.0)) == 0.0, F.when(flag == 1, 1.0).otherwise(0.0)).otherwise(col("guven_skoru", "double"))
    wanted = lambda c, d: F.when(filled(col(c)) == "", d).otherwise(col(c))
    out = {k: F.coalesce(col(k), F.lit(d)) for k, d in DEFAULTS.items()}
    out |= {
        "title": clean_leading_time(col("title"), numbers=numbers),
        "summary": clean_leading_time(col("summary"), numbers=numbers),
        "link": filled(col("link")),
        "publish_date": wanted("publish_date", F.lit(as_of)),
        "scraped_at": wanted("scraped_at", F.lit(as_of)),
        "ilgili_mi": flag,
        "ilgi_kategorisi": wanted("ilgi_kategorisi", F.when(flag == 1, "Doğrudan").otherwise(NOT_RELEVANT)),
        "guven_skoru": score,
        "gerekce": wanted("gerekce", filled(col("llm_relevance_explanation"))),
    }
    return items.select("ord", *(v.alias(k) for k, v in out.items()))


def _keeps(relevant: Column, summary: Column) -> Column:
    """Whether a stored summary outlasts a new one."""
    return (F.coalesce(relevant, F.lit(0)) == 1) & is_full_summary(summary)


def merged(stored: DataFrame, items: DataFrame, as_of: str, largest: int | None = None) -> DataFrame:
    """The stored table after items were upserted in the order of ord; link is the key.

    A stored relevant row keeps its full summary, else a new non-empty one replaces it; an empty date replaces
    nothing; title and labels are the new ones; source, category, scraped_at and id stay. Where a batch has a link
    several times, its rows are folded in order with the stored row as the start: the links that recur are few,
    and each one's rows are of one story. New rows get ids after the largest one, in order of first arrival; `largest`
    names it where stored is only a part of the table."""
    new = prepared(items, as_of)
    columns = [c for c in stored.columns if c != "id"]
    row = F.struct("ord", *(F.col(c) for c in columns))
    batch = new.groupBy("link").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumnRenamed("link", "_link")
    old = stored.select("id", F.struct(*columns).alias("old"))
    both = old.join(batch, F.col("old.link") == F.col("_link"), "full")

    def step(acc: Column, x: Column) -> Column:
        keep = acc["summary"]
        summary = F.when(_keeps(acc["ilgili_mi"], keep), keep).otherwise(F.when(filled(x["summary"]) != "", x["summary"]).otherwise(keep))
        date = F.when(filled(x["publish_date"]) != "", x["publish_date"]).otherwise(acc["publish_date"])
        new = {"title": x["title"], "summary": summary, "publish_date": date} | {c: F.coalesce(x[c], acc[c]) for c in MERGED}
        return F.struct(*((new[c] if c in new else acc[c]).cast(stored.schema[c].dataType).alias(c) for c in columns))

    first = F.element_at("rows", 1)
    start = F.coalesce(F.col("old"), F.struct(*(first[c].cast(stored.schema[c].dataType).alias(c) for c in columns)))
    rest = F.when(F.col("old").isNull(), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    after = both.withColumn("now", F.when(F.col("rows").isNull(), F.col("old")).otherwise(F.aggregate(rest, start, step)))
    # written once: the join isn't repeated for what is numbered and what is counted
    after = cut(after.select("id", F.when(F.col("id").isNull(), first["ord"]).alias("_first"), "now"))
    top = after.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if largest is None else F.lit(largest)
    fresh = after.where("id is null").select("_first", "now")
    numbered = _numbered(fresh, "_first").select((top + F.col("_n")).cast("long").alias("id"), "now")
    return after.where("id is not null").select("id", "now").unionByName(numbered).select("id", *(F.col(f"now.{c}").alias(c) for c in columns))


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with _n = 1, 2, ... in an order: counted by ranges of the order and within them, in two steps."""
    from pyspark.sql import Window

    size = 1 << 16
    ranged = rows.withColumn("_r", F.floor(F.col(order) / size))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_b")
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return ranged.withColumn("_i", inside).join(before, "_r").withColumn("_n", F.col("_b") + F.col("_i")).drop("_r", "_i", "_b")


def with_updates(news: DataFrame, updates: DataFrame) -> DataFrame:
    """news with the non-null values of updates (id and any of its columns)."""
    names = [c for c in updates.columns if c != "id"]
    new = updates.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in names))
    out = news.join(new, news.id == F.col("_id"), "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in news.columns))


def with_verdicts(news: DataFrame, verdicts: DataFrame) -> DataFrame:
    """news with verdicts (id, relevant, category, confidence, reason) of a second stage."""
    yes = F.col("relevant")
    return with_updates(news, verdicts.select("id", yes.cast("int").alias("ilgili_mi"), F.col("category").alias("ilgi_kategorisi"), F.col("confidence").alias("guven_skoru"), F.col("reason").alias("gerekce"), F.when(yes, STAGE_2).otherwise(GENERAL).alias("relevance_status"), F.when(yes, F.col("category")).otherwise("Genel").alias("relevance_aspect"), F.col("reason").alias("llm_relevance_explanation")))


def without_ids(news: DataFrame, ids: DataFrame) -> DataFrame:
    """news without the rows of these ids."""
    return news.join(ids.select(F.col("id").alias("_id")).distinct(), news.id == F.col("_id"), "left_anti")


def written(news: DataFrame, path: str) -> None:
    """news as a new table under a path, partitioned by day so that a day's reads prune the rest. A path that news itself
    is read from is refused, as its files would go before they are read: sources.news_table changes tables in place."""
    of = lambda x: x.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    if any(of(f).startswith(of(path)) for f in news.inputFiles()):
        raise ValueError(f"{path} holds files that these rows are read from")
    news.withColumn("publish_day", F.substring("publish_date", 1, 10)).write.mode("overwrite").partitionBy("publish_day").parquet(path)
