"""Feeds and search results that were landed as files, and how a source's ways of reading combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import dates
from quillstream.functions.text import canonical_url, clean_text, filled, is_junk_title, squashed_ends, strip_title_suffix
from quillstream.operators.dedup import first_of
from quillstream.operators.lookup import with_source

_FIELDS = ("title", "link", "description", "summary", "content:encoded", "author", "dc:creator", "pubDate", "published", "dc:date", "updated")
ENTRY = T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS])
ATOM = T.StructType([T.StructField(f, T.StructType([T.StructField("_href", T.StringType()), T.StructField("_VALUE", T.StringType())]) if f == "link" else T.StringType()) for f in _FIELDS])
RESULT = "array<struct<title: string, link: string, iso_date: string, date: string, source: struct<name: string>>>"


def feed_items(spark: SparkSession, path: str, as_of: str, source_id: str = "", source_name: str = "", category: str = "", most: int = 100, zone: str = "UTC") -> DataFrame:
    """Items of RSS files (item) or, where a file has none, of Atom files (entry) under a path: the first `most` of
    each file, those with title and link, without junk titles. Fields fall back on their other names."""
    rss = _entries(spark, path, "item", ENTRY).withColumn("link", F.col("link"))
    atom = _entries(spark, path, "entry", ATOM).withColumn("link", F.coalesce("link._VALUE", "link._href"))
    atom = atom.join(rss.select("file").distinct(), "file", "left_anti")
    rows = rss.unionByName(atom)
    turn = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= most)
    title = strip_title_suffix(clean_text(F.col("title")))
    raw = clean_text(F.coalesce("pubDate", "published", F.col("`dc:date`"), "updated"))
    out = rows.select(
        "ord",
        F.lit(source_id).alias("source_id"),
        F.lit(source_name).alias("source_name"),
        F.lit(category).alias("category"),
        title.alias("title"),
        clean_text(F.coalesce("description", "summary", F.col("`content:encoded`"))).alias("summary"),
        clean_text(F.coalesce("author", F.col("`dc:creator`"))).alias("author"),
        dates.feed_date(raw, title, as_of, zone).alias("publish_date"),
        canonical_url(squashed_ends(filled(F.col("link")))).alias("link"),
        F.lit(as_of).alias("scraped_at"),
    )
    return out.where((F.col("title") != "") & (F.col("link") != "") & ~is_junk_title(F.col("title")))


def _entries(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    """Entries with their file and their order in it."""
    rows = spark.read.format("xml").schema(schema).option("rowTag", tag).option("valueTag", "_VALUE").load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))


def search_items(results: DataFrame, sources: DataFrame, as_of: str, value: str = "json") -> DataFrame:
    """Items of search answers (JSON texts with news_results): titled ones with a link, each of a configured source
    (ord, name, category) if the names fit."""
    parsed = F.from_json(F.col(value), f"news_results {RESULT}")
    rows = results.select(F.posexplode(parsed["news_results"]).alias("ord", "r"))
    rows = rows.select(F.col("ord").cast("long").alias("ord"), F.trim(filled(F.col("r.title"))).alias("title"), F.trim(filled(F.col("r.link"))).alias("link"), F.col("r.iso_date").alias("iso_date"), F.col("r.date").alias("said"), F.coalesce("r.source.name", F.lit("Bilinmeyen")).alias("raw_source"))
    rows = with_source(rows.where("title <> '' and link <> ''"), sources)
    date = dates.search_date(F.col("iso_date"), F.col("said"), F.col("title"), as_of)
    return rows.select("ord", F.lit("serpapi").alias("source_id"), "source_name", "category", "title", F.lit("").alias("summary"), F.lit("").alias("author"), date.alias("publish_date"), "link", F.lit("SerpApi").alias("veri_kaynagi"), F.lit(as_of).alias("scraped_at"))


def combined(feed: DataFrame, scraped: DataFrame, policy: DataFrame) -> DataFrame:
    """Items by each source's policy (source_name, policy): `feed` alone, `fallback` (scraped ones where the feed has
    none), `both`. A source without a policy is read from its feed."""
    have = feed.select("source_name").distinct()
    want = scraped.join(policy.select("source_name", "policy"), "source_name").where("policy in ('fallback', 'both')")
    instead = want.where("policy = 'fallback'").join(have, "source_name", "left_anti")
    return feed.unionByName(want.where("policy = 'both'").unionByName(instead).drop("policy"), allowMissingColumns=True)


def capped(items: DataFrame, caps: DataFrame, by: tuple[str, ...] = (), order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first `most` items of each source in caps (source_name, any other names of items' columns, most), or of each
    of its parts if `by` names them; those without a cap, or a null one, all stay.

    The window deals rows as the join does, so caps cost no further shuffle of items if `by` is empty."""
    keys = [c for c in caps.columns if c != "most"]
    turn = F.row_number().over(Window.partitionBy("source_name", *by).orderBy(*order))
    most = caps.select(*(F.col(c).alias("_cap_" + c) for c in keys), F.col("most").alias("_most"))
    same = reduce(lambda a, b: a & b, (items[c] == most["_cap_" + c] for c in keys))
    rows = items.withColumn("_turn", turn).join(most, same, "left").where("_most is null or _turn <= _most")
    return rows.drop("_turn", *most.columns)


def local_items(items: DataFrame, stop_phrases: tuple[str, ...] = (), least_title: int = 20, most: int = 30) -> DataFrame:
    """Items of local outlets: long enough titles without stop phrases, the first of each link, `most` per outlet."""
    stop = reduce(lambda a, b: a | b, (F.contains(F.lower(filled(F.col("title"))), F.lit(p)) for p in stop_phrases), F.lit(False))
    kept = items.where((F.length(filled(F.col("title"))) >= least_title) & ~stop)
    return first_of(first_of(kept, ["source_name", "link"], [F.col("ord")]), ["source_name"], [F.col("ord")], most)


def outlet_of(title: F.Column) -> F.Column:
    """The outlet's name after the last ` - ` of a title."""
    return F.trim(F.substring_index(title, " - ", -1))


def log_usage(spark: SparkSession, path: str, at: str, queries: int, price: float = 0.01) -> None:
    """Appends a line with the number of queries and their cost."""
    spark.createDataFrame([(f"{at} queries={queries} cost={queries * price:.2f}",)], "value string").coalesce(1).write.mode("append").text(path)
