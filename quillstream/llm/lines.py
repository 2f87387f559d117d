"""Line dedup by site-relative frequency, with DataFrame functions only.

A line of a host is boilerplate if more than `ratio` of the host's pages have it. Empty lines don't count, and documents
of a host with the same text are one page, so that copies of a page don't make boilerplate of its lines. On
request near copies are one page too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored, text_key, with_columns
from quillstream.llm.graph import components

#: A line is dropped if over this share of its host's documents, and at least so many of them, have it.
RATIO, LEAST_PAGES = 0.02, 5
#: With near copies as one page: share of a page's characters in frequent lines from which on it may be a copy. A line
#: of so large a share of so many pages is the site's all the same: pages with little of their own look like copies.
COPIED, EVERYWHERE, MANY_PAGES = 2 / 3, 0.99, 50
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, or null."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _line(line: Column) -> Column:
    return F.trim(line)


def _key(line: Column) -> Column:
    return F.xxhash64(_line(line))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, near_copies: bool = False) -> DataFrame:
    """host, line (key), pages and share of every boilerplate line. near_copies: these count as one page, see `_classed`."""
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: _line(x) != ""), _key))
    pages = docs.select(F.col(host).alias("host"), text_key(text).alias("page"), F.coalesce(keys, F.array().cast("array<bigint>")).alias("lines"), *([_sized(F.col(text)).alias("sized")] if near_copies else []))
    pages = stored(pages.distinct(), "pages")
    lines = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    lines = lines.where(F.col("pages") >= least_pages)
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("total"))
    found = lines.join(totals, lines.host.eqNullSafe(totals.h)).select("host", "line", "pages", (F.col("pages") / F.col("total")).alias("share"), "total")
    if not near_copies:
        return found.where(F.col("share") > ratio).drop("total")
    # classes are fewer than pages: a line may be over the share of these only
    found = stored(found, "frequent")
    classed = _classed(pages, found.where(F.col("share") > ratio))
    several = F.count_distinct("class")
    totals = classed.groupBy(F.col("host").alias("h")).agg(several.alias("classes_in_all"))
    counted = classed.select(F.col("host").alias("h2"), "class", F.explode("lines").alias("l")).groupBy("h2", "l").agg(several.alias("classes")).where(F.col("classes") >= least_pages)
    found = found.join(totals, found.host.eqNullSafe(totals.h)).drop("h")
    found = found.join(counted, found.host.eqNullSafe(counted.h2) & (found.line == counted.l), "left").withColumn("by_class", F.coalesce("classes", F.lit(0)) / F.col("classes_in_all"))
    everywhere = (F.col("total") >= MANY_PAGES) & (F.col("share") >= EVERYWHERE)
    return found.where(everywhere | (F.col("by_class") > ratio)).select("host", "line", F.coalesce("classes", F.lit(0)).alias("pages"), F.col("by_class").alias("share"))


def _sized(text: Column) -> Column:
    """Length and key of each line that isn't blank."""
    sized = F.transform(F.filter(F.split(text, "\n"), lambda x: _line(x) != ""), lambda x: F.struct(F.length(_line(x)).alias("n"), _key(x).alias("line")))
    return F.coalesce(F.array_distinct(sized), F.array().cast("array<struct<n: int, line: bigint>>"))


def _classed(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """host, lines, class of each page (host, page, lines, sized).

    Where frequent lines are most of a page, its class is that of the longest one; lines that are the longest two of
    such a page are of one class, so that copies of which different lines were edited meet. Others are alone."""
    joined = _beside_host(pages, frequent.groupBy("host").agg(F.collect_set("line").alias("__qs_drop")), "host", F.col("page"), hot_hosts(pages, "host"))
    often = F.filter("sized", lambda x: F.array_contains(F.coalesce("__qs_drop", F.array().cast("array<bigint>")), x.line))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x.n)
    own = joined.select("host", "page", "lines", often.alias("often"), chars(F.col("sized")).alias("chars"))
    own = own.withColumn("often", F.when(chars(F.col("often")) >= COPIED * F.col("chars"), F.col("often")))
    first = F.array_max("often")
    node = lambda x: F.xxhash64("host", x.line)
    own = own.withColumn("u", F.when(first.isNotNull(), node(first)))
    second = F.array_max(F.filter("often", lambda x: x != first))
    own = stored(own.select("host", "page", "lines", "u", F.when(second.isNotNull(), node(second)).alias("v")), "heads")
    label = components(own.where("v is not null").select("u", "v").distinct())
    own = own.join(label, own.u == label.node, "left")
    return own.select("host", "lines", F.coalesce("label", "u", "page").alias("class"))


def hot_hosts(docs: DataFrame, host: str) -> list:
    """Hosts with over 1/256 of all rows: fewer than 256, whatever the corpus."""
    counts = docs.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return [r.h for r in counts.join(F.broadcast(total), F.col("n") * 256 > F.col("total")).select("h").collect()]


def _beside_host(rows: DataFrame, found: DataFrame, host: str, key: Column, hot: list) -> DataFrame:
    """rows with __qs_drop of their host; rows of hot hosts are dealt by a key beside it, so only these hosts' arrays are repeated."""
    names = [h for h in hot if h is not None]
    is_hot = lambda h: F.coalesce(h.isin(names), F.lit(None in hot)) if names else h.isNull() & F.lit(None in hot)
    salted = found.withColumn("__qs_salt", F.explode(F.when(is_hot(F.col("host")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    here = F.col(f"`{host}`")
    rows = with_columns(rows, {"__qs_salt": F.when(is_hot(here), F.pmod(key, F.lit(SALTS)).cast("int")).otherwise(0), "__qs_host": here})
    return rows.join(salted.withColumnRenamed("host", "__qs_h"), F.col("__qs_host").eqNullSafe(F.col("__qs_h")) & (rows["__qs_salt"] == salted["__qs_salt"]), "left").drop(salted["__qs_salt"])


def dedup_lines(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, prefix: str = "", near_copies: bool = False) -> DataFrame:
    """docs with their boilerplate lines removed, and n_lines, n_dropped, both counting lines that aren't blank.

    Lines are compared without blanks at their ends. A null text stays null; a null host is a host of its own.
    A text that loses nothing stays as it is, byte for byte. Repeated rows stay, and
    count as one page of their host, as do near copies if near_copies is set. The lines that go are few for a host (shares add up to its mean number of lines, so fewer than that mean
    over `ratio`), but hosts may be many: they are joined as one array per host. Rows of a hot host (over 1/256 of all) are
    dealt over partitions by the row's key beside the host, and its array is repeated for each salt."""
    prepare(docs.sparkSession)
    found = boilerplate(docs, text, host, ratio, least_pages, near_copies).groupBy("host").agg(F.collect_set("line").alias("__qs_drop"))
    found = stored(found, "boilerplate")
    joined = _beside_host(docs, found, host, text_key(text), hot_hosts(docs, host))
    lines = F.split(F.col(text), "\n")
    drop = F.coalesce(F.col("__qs_drop"), F.array().cast("array<bigint>"))
    goes = lambda x: (_line(x) != "") & F.array_contains(drop, _key(x))
    counts = {"n_lines": F.coalesce(F.size(F.filter(lines, lambda x: _line(x) != "")), F.lit(0)), "n_dropped": F.coalesce(F.size(F.filter(lines, goes)), F.lit(0))}
    counts["n_lines"] = F.when(F.col(text).isNull(), 0).otherwise(counts["n_lines"])
    counts["n_dropped"] = F.when(F.col(text).isNull() | F.col("__qs_drop").isNull(), 0).otherwise(counts["n_dropped"])
    clean = F.when(F.col(text).isNull() | F.col("__qs_drop").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x: ~goes(x)), "\n"))
    out = with_columns(joined, {**{prefix + k: v.cast("long") for k, v in counts.items()}, "__qs_text": clean})
    return with_columns(out, {text: F.col("__qs_text")}).drop("__qs_salt", "__qs_host", "__qs_h", "__qs_drop", "__qs_text")


LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, source, i, lines[i] AS raw, trim(lines[i], ' ') AS line FROM (SELECT r, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
pages AS (SELECT source, line, count(DISTINCT text) AS n FROM l JOIN (SELECT r, text FROM d) USING (r) WHERE line <> '' GROUP BY ALL),
totals AS (SELECT source, count(DISTINCT coalesce(text, '')) AS total FROM d GROUP BY ALL),
bad AS (SELECT p.source, line FROM pages p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n / total > 0.02),
marked AS (SELECT l.*, b.line IS NOT NULL AS goes FROM l LEFT JOIN bad b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source),
per AS (SELECT r, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (goes) AS n_dropped,
  coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, text, '')) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
