"""The sources, local outlets and saved queries that a monitor of the Turkish press reads, and how it reads them.

All are defaults: every operator takes other tables of the same form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import filled, is_junk_title
from quillstream.operators.dedup import first_of
from quillstream.sources.feeds import capped, combined
from quillstream.sources.html import SiteCards, bodies

OFFICIAL, GOVERNMENT, OPPOSITION, LOCAL = "Resmi / Ana Akım", "İktidar Yanlısı", "Muhalif", "Yerel / Bölgesel Basın"

# Id, name, category, type, domain of each source, in order of precedence.
SOURCES = (
    ("aa", "Anadolu Ajansı (AA)", OFFICIAL, "scrape", "aa.com.tr"),
    ("trt", "TRT Haber", OFFICIAL, "rss/scrape", "trthaber.com"),
    ("iha", "İhlas Haber Ajansı (İHA)", OFFICIAL, "scrape", "iha.com.tr"),
    ("dha", "DHA | Demirören Haber Ajansı", OFFICIAL, "rss/scrape", "dha.com.tr"),
    ("ntv", "NTV Haber", OFFICIAL, "rss/scrape", "ntv.com.tr"),
    ("haberturk", "Habertürk", OFFICIAL, "rss/scrape", "haberturk.com"),
    ("milliyet", "Milliyet", OFFICIAL, "rss", "milliyet.com.tr"),
    ("hurriyet", "Hürriyet", OFFICIAL, "rss/scrape", "hurriyet.com.tr"),
    ("ahaber", "A Haber", GOVERNMENT, "rss/scrape", "ahaber.com.tr"),
    ("yenisafak", "Yeni Şafak", GOVERNMENT, "rss/scrape", "yenisafak.com"),
    ("sabah", "Sabah", GOVERNMENT, "rss", "sabah.com.tr"),
    ("turkiyegazetesi", "Türkiye Gazetesi", GOVERNMENT, "rss/scrape", "turkiyegazetesi.com.tr"),
    ("yeniakit", "Yeni Akit", GOVERNMENT, "rss/scrape", "yeniakit.com.tr"),
    ("benguturk", "Bengütürk TV", GOVERNMENT, "rss/scrape", "benguturk.com"),
    ("sozcu", "Sözcü", OPPOSITION, "rss/scrape", "sozcu.com.tr"),
    ("cumhuriyet", "Cumhuriyet", OPPOSITION, "rss", "cumhuriyet.com.tr"),
    ("halktv", "Halk TV", OPPOSITION, "rss/scrape", "halktv.com.tr"),
    ("t24", "T24", OPPOSITION, "rss", "t24.com.tr"),
    ("birgun", "BirGün", OPPOSITION, "rss/scrape", "birgun.net"),
    ("regional_border", "Sınır & Kafkas Basını (Iğdır/Kars/Ardahan/Ağrı)", LOCAL, "rss/scrape", "kha.com.tr"),
    ("mediterranean_local", "Akdeniz Bölge Basını (Mersin/Adana/Hatay/Antalya)", LOCAL, "rss/scrape", "mersinhaber.com"),
    ("anatolian_local", "Anadolu İlleri Yerel Basını", LOCAL, "rss/scrape", "olay.com.tr"),
)

# Source, policy, most items of a feed, most cards of a page, most items if the feed gives any (of both
# together, if both are read), most cards in its place. None: no limit.
READINGS = (
    ("Anadolu Ajansı (AA)", "fallback", 100, 20, None, None),
    ("TRT Haber", "both", 100, 20, None, None),
    ("İhlas Haber Ajansı (İHA)", "fallback", 40, None, 50, 40),
    ("DHA | Demirören Haber Ajansı", "both", 100, 30, None, None),
    ("NTV Haber", "both", 100, 30, None, None),
    ("Habertürk", "feed", 50, 0, 60, 0),
    ("Milliyet", "fallback", 100, 20, None, None),
    ("Hürriyet", "fallback", 100, 20, None, None),
    ("A Haber", "both", 100, 30, None, None),
    ("Yeni Şafak", "both", 100, 30, None, None),
    ("Sabah", "fallback", 100, 20, None, None),
    ("Türkiye Gazetesi", "fallback", 100, 20, None, None),
    ("Sözcü", "fallback", 100, 20, None, None),
    ("Cumhuriyet", "fallback", 100, 20, None, None),
    ("Halk TV", "fallback", 100, 20, None, None),
    ("T24", "fallback", 40, None, 50, 30),
    ("BirGün", "fallback", 40, None, 50, 30),
    ("Yeni Akit", "both", 40, None, 60, None),
    ("Bloomberg HT", "both", 60, 30, 70, None),
    ("Defensehere", "feed", 50, 0, None, 0),
    ("Bengütürk TV", "both", 100, None, None, None),
)

# Group, id, name, domain, city of each local outlet.
OUTLETS = (
    ("regional_border", "yesiligdir", "Yeşil Iğdır", "yesiligdir.com", "Iğdır"),
    ("regional_border", "igdirgazetesi", "Iğdır Gazetesi", "igdirgazetesi.com", "Iğdır"),
    ("regional_border", "igdirhaber", "Iğdır Haber", "igdirhaber.com", "Iğdır"),
    ("regional_border", "igdirdogus", "Iğdır Doğuş", "igdirdogus.com", "Iğdır"),
    ("regional_border", "kafkashaber", "Kafkas Haber Ajansı", "kha.com.tr", "Kars"),
    ("regional_border", "karsmanset", "Kars Manşet", "karsmanset.com", "Kars"),
    ("regional_border", "gazetekars", "Gazete Kars", "gazetekars.com", "Kars"),
    ("regional_border", "karsolay", "Kars Olay", "karsolay.com", "Kars"),
    ("regional_border", "serhattv", "Serhat TV", "serhattv.com.tr", "Kars"),
    ("regional_border", "ardahanhaber", "Ardahan Haber", "ardahanhaber.com.tr", "Ardahan"),
    ("regional_border", "ardahanmedya", "Ardahan Medya", "ardahanmedya.com", "Ardahan"),
    ("regional_border", "agridahaber", "Ağrı'da Haber", "agridahaber.com", "Ağrı"),
    ("regional_border", "erzurumajans", "Erzurum Ajans", "erzurumajans.com", "Erzurum"),
    ("mediterranean_local", "mersinhaber", "Mersin Haber", "mersinhaber.com", "Mersin"),
    ("mediterranean_local", "mersinportal", "Mersin Portal", "mersinportal.com", "Mersin"),
    ("mediterranean_local", "guneygazetesi", "Güney Gazetesi", "guneygazetesi.com", "Mersin"),
    ("mediterranean_local", "akdenizpostasi", "Akdeniz Postası", "akdenizpostasi.com.tr", "Mersin"),
    ("mediterranean_local", "cukurovabaris", "Çukurova Barış", "cukurovabaris.com.tr", "Adana"),
    ("mediterranean_local", "bolgegazetesi", "Bölge Gazetesi", "bolgegazetesi.com.tr", "Adana"),
    ("mediterranean_local", "antakyagazetesi", "Antakya Gazetesi", "antakyagazetesi.com", "Hatay"),
    ("mediterranean_local", "iskenderunses", "İskenderun Ses", "sesgazetesi-hatay.com", "İskenderun"),
    ("mediterranean_local", "antalyakorfez", "Antalya Körfez", "korfezgazetesi.com", "Antalya"),
    ("anatolian_local", "olaygazetesi", "Olay Gazetesi", "olay.com.tr", "Bursa"),
    ("anatolian_local", "bursahakimiyet", "Bursa Hakimiyet", "bursahakimiyet.com.tr", "Bursa"),
    ("anatolian_local", "61saat", "61saat", "61saat.com", "Trabzon"),
    ("anatolian_local", "gunebakis", "Günebakış", "gunebakis.com.tr", "Trabzon"),
    ("anatolian_local", "egedesonsoz", "Ege'de Sonsöz", "egedesonsoz.com", "İzmir"),
    ("anatolian_local", "izgazete", "İz Gazete", "izgazete.net", "İzmir"),
    ("anatolian_local", "pusulahaber", "Pusula Haber", "pusulahaber.com.tr", "Konya"),
    ("anatolian_local", "kayseriolay", "Kayseri Olay", "kayseriolay.com", "Kayseri"),
    ("anatolian_local", "hedefhalk", "Hedef Halk", "hedefhalk.com", "Samsun"),
    ("anatolian_local", "gazianteppusula", "Gaziantep Pusula", "gazianteppusula.com", "Gaziantep"),
    ("anatolian_local", "ozgurkocaeli", "Özgür Kocaeli", "ozgurkocaeli.com.tr", "Kocaeli"),
)

# Group, words and label of each saved query; a group's id for their items and name for unnamed outlets.
SAVED_QUERIES = (
    ("regional_border", "Iğdır Azerbaycan", "Iğdır / Azerbaycan"),
    ("regional_border", "Iğdır Nahçıvan", "Iğdır / Nahçıvan"),
    ("regional_border", "Iğdır Dilucu", "Iğdır / Dilucu Sınır Kapısı"),
    ("regional_border", "Kars Azerbaycan", "Kars / Azerbaycan"),
    ("regional_border", "Kars Başkonsolosluğu", "Kars / Başkonsolosluk"),
    ("regional_border", "Kars Nahçıvan", "Kars / Nahçıvan"),
    ("regional_border", "Ardahan Gürcistan Azerbaycan", "Ardahan / Kafkas"),
    ("regional_border", "Doğu Anadolu Zengezur", "Doğu Anadolu / Zengezur"),
    ("mediterranean_local", "Mersin Limanı lojistik", "Mersin / Lojistik"),
    ("mediterranean_local", "Mersin deniz ticaret", "Mersin / Ticaret"),
    ("mediterranean_local", "Adana sanayi ihracat", "Adana / Ekonomi"),
    ("mediterranean_local", "Hatay İskenderun liman", "Hatay / Liman"),
    ("mediterranean_local", "Mersin Azerbaycan", "Mersin / Dış İlişkiler"),
    ("anatolian_local", "Yerel Basın Azerbaycan", "Anadolu / Azerbaycan"),
    ("anatolian_local", "Yerel Gazete Karabağ", "Anadolu / Karabağ"),
    ("anatolian_local", "Yerel Basın KKTC", "Anadolu / KKTC"),
    ("anatolian_local", "Belediye Azerbaycan Kardeş Şehir", "Belediye / Kardeş Şehir"),
    ("anatolian_local", "Türk Dünyası yerel haber", "Yerel / Türk Dünyası"),
    ("anatolian_local", "Orta Koridor lojistik yerel", "Bölgesel / Lojistik"),
)
GROUPS = (("regional_border", "border_query", "Sınır Basını"), ("mediterranean_local", "med_local_query", "Akdeniz Basını"), ("anatolian_local", "anatolian_query", "Anadolu Basını"))
# Phrases of links that are no news; one group has a further one. Limits of local readings.
STOP_PHRASES = ("foto galeri", "video", "reklam", "resmi ilandır", "nöbetçi", "vefat", "künye")
MORE_STOP_PHRASES = {"mediterranean_local": ("iletişim",)}
OUTLET_FEED, OUTLET_MOST, QUERY_FEED, LEAST_TITLE = 25, 30, 20, 20

#: Cards of each site's list pages, and what of them is read.
_TITLES = ("h2", "h3", "h4")
SITE_CARDS = (
    SiteCards("Anadolu Ajansı (AA)", "https://www.aa.com.tr", ("item-card", "list-item"), ("article",), ("/tr/",), ("/gundem/", "/dunya/", "/politika/", "/turkiye/"), (*_TITLES, "span", "div")),
    SiteCards("TRT Haber", "https://www.trthaber.com", ("standard-card", "news-item", "card"), hrefs=("/haber/",), links=("/haber/",), titles=(*_TITLES, "div", "span")),
    SiteCards("DHA | Demirören Haber Ajansı", "https://www.dha.com.tr", ("card",), ("article",), ("dha.com.tr/", "/haber/"), titles=(*_TITLES, "strong", "span"), cards=30),
    SiteCards("NTV Haber", "https://www.ntv.com.tr", ("card", "news-card"), hrefs=("/gundem/", "/dunya/"), titles=(*_TITLES, "span", "p"), summary=False, cards=30),
    SiteCards("Milliyet", "https://www.milliyet.com.tr", ("card", "news-item"), hrefs=("milliyet.com.tr/gundem/", "milliyet.com.tr/dunya/"), links=("-",)),
    SiteCards("Hürriyet", "https://www.hurriyet.com.tr", ("card", "news-box"), hrefs=("hurriyet.com.tr/gundem/", "hurriyet.com.tr/dunya/"), links=("-",), titles=(*_TITLES, "h5")),
    SiteCards("A Haber", "https://www.ahaber.com.tr", ("card", "news-item"), hrefs=("/gundem/", "/dunya/"), links=("-",), titles=(*_TITLES, "strong", "span"), cards=30),
    SiteCards("Yeni Şafak", "https://www.yenisafak.com", ("card", "news-item"), hrefs=("/gundem/", "/dunya/"), titles=(*_TITLES, "span", "p"), summary=False, cards=30),
    SiteCards("Sabah", "https://www.sabah.com.tr", ("card", "news-item"), hrefs=("sabah.com.tr/gundem/", "sabah.com.tr/dunya/"), links=("-",), titles=(*_TITLES, "strong", "span")),
    SiteCards("Türkiye Gazetesi", "https://www.turkiyegazetesi.com.tr", ("card",), ("article",), ("/gundem/", "/dunya/"), ("-",)),
    SiteCards("Yeni Akit", "https://www.yeniakit.com.tr", hrefs=("/haber/",), links=("/gundem/", "/dunya/", "/siyaset/"), summary=False, longer=19, cards=1 << 20, skip=("foto galeri", "video")),
    SiteCards("Sözcü", "https://www.sozcu.com.tr", ("news-card",), ("article",), ("sozcu.com.tr/",), ("/gundem/", "/dunya/", "-p", "-wp"), (*_TITLES, "span", "strong")),
    SiteCards("Cumhuriyet", "https://www.cumhuriyet.com.tr", ("haber", "card"), ("article",), ("cumhuriyet.com.tr/",), ("/turkiye/", "/dunya/", "/haber/")),
    SiteCards("Halk TV", "https://halktv.com.tr", ("card",), ("article",), ("halktv.com.tr/gundem/", "halktv.com.tr/dunya/"), ("-",)),
    SiteCards("BloombergHT", "https://www.bloomberght.com", ("news-item", "card"), ("article",), ("/haber/", "/ekonomi/", "/piyasalar/", "/enerji/"), titles=(*_TITLES, "strong", "span"), longer=15, cards=30),
)
#: Sections that a site writes before its titles.
SECTION_PREFIXES = {"Bengütürk TV": ("Gündem", "Dünya", "Siyaset", "Ekonomi", "Spor", "Haber")}


def items_of_today(items: DataFrame, pages: DataFrame, as_of: str) -> DataFrame:
    """Items of a site whose cards have no date (source_name, title, link): titles without their section, those that are
    no junk, and of these the ones whose own page (link, html) gives a date of the day, which they take."""
    own = bodies(pages.select(F.col("link").alias("_l"), "html")).select("_l", "page_date")
    title = F.col("title")
    for source, prefixes in SECTION_PREFIXES.items():
        for p in prefixes:
            title = F.when((F.col("source_name") == source) & F.startswith(title, F.lit(p + " ")), F.trim(F.substring(title, len(p) + 1, 1 << 20))).otherwise(title)
    rows = items.withColumn("title", title).where(~is_junk_title(F.col("title")))
    dated = rows.join(own, rows.link == F.col("_l")).where(F.startswith("page_date", F.lit(as_of[:10])))
    return dated.withColumn("publish_date", F.col("page_date")).drop("_l", "page_date")



def sources(spark: SparkSession) -> DataFrame:
    """ord, id, name, category, type, domain."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SOURCES)], "ord int, id string, name string, category string, type string, domain string")


def readings(spark: SparkSession) -> DataFrame:
    """source_name, policy, most_of_feed, most_of_page, most, most_instead."""
    return spark.createDataFrame(list(READINGS), "source_name string, policy string, most_of_feed int, most_of_page int, most int, most_instead int")


def outlets(spark: SparkSession) -> DataFrame:
    """group, id, name, domain, city, source_name (as items of the outlet are called)."""
    rows = spark.createDataFrame(list(OUTLETS), "group string, id string, name string, domain string, city string")
    return rows.withColumn("source_name", F.format_string("%s (%s)", "name", "city"))


def saved_queries(spark: SparkSession) -> DataFrame:
    """group, query, label, source_id, unnamed."""
    rows = spark.createDataFrame(list(SAVED_QUERIES), "group string, query string, label string")
    return rows.join(F.broadcast(spark.createDataFrame(list(GROUPS), "group string, source_id string, unnamed string")), "group")


def gathered(feed: DataFrame, scraped: DataFrame, how: DataFrame) -> DataFrame:
    """Items (source_name, place, ord; place: the feed or page they were read from) by each source's reading: the
    first ones of each place, the two kinds combined by policy, feed items first, and the first of what is left. A
    source without a reading is read from its feed, whole."""
    limit = lambda column: how.select("source_name", F.col(column).alias("most"))
    first = capped(feed, limit("most_of_feed"), by=("place",)).withColumn("_kind", F.lit(0))
    second = capped(scraped, limit("most_of_page"), by=("place",)).withColumn("_kind", F.lit(1))
    instead = F.when(F.col("policy") == "both", F.col("most")).otherwise(F.col("most_instead"))
    caps = how.select("source_name", F.explode(F.array(F.struct(F.lit(0).alias("_kind"), "most"), F.struct(F.lit(1).alias("_kind"), instead.alias("most")))).alias("c")).select("source_name", "c.*")
    return capped(combined(first, second, how), caps, order=("_kind", "ord")).drop("_kind")


def before_outlet(title: Column) -> Column:
    """The part of a title before its first ` - `."""
    return F.trim(F.substring_index(filled(title), " - ", 1))


def outlet_items(feed: DataFrame, links: DataFrame, stop_phrases: tuple[str, ...] = STOP_PHRASES) -> DataFrame:
    """Items of local outlets (source_name, ord, title, link): the first 25 of an outlet's feed, by the part of the title
    before the outlet, then links of its front page with long enough titles and no stop phrase; of each link the
    first, and the first 30 of an outlet."""
    own = first_of(feed, ["source_name"], [F.col("ord")], OUTLET_FEED).withColumn("title", before_outlet(F.col("title"))).withColumn("veri_kaynagi", F.lit("RSS"))
    title = filled(F.col("title"))
    news = links.where(F.length(title) >= LEAST_TITLE)
    for phrase in stop_phrases:
        news = news.where(~F.contains(F.lower(title), F.lit(phrase)))
    news = news.where(F.startswith("link", F.lit("http"))).withColumn("veri_kaynagi", F.lit("Scraping"))
    rows = own.where(filled(F.col("link")) != "").withColumn("_kind", F.lit(0)).unionByName(news.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_kind"), F.col("ord")]
    return first_of(first_of(rows, ["source_name", "link"], order), ["source_name"], order, OUTLET_MOST).drop("_kind")


def query_items(feed: DataFrame, queries: DataFrame) -> DataFrame:
    """Items (query, ord, title, link) of saved queries' feeds, the first 20 of each: the title before its first ` - `,
    and the outlet named after it, else the group's name, with the query's label."""
    rows = first_of(feed, ["query"], [F.col("ord")], QUERY_FEED).join(queries, "query")
    parts = F.split(filled(F.col("title")), " - ")
    name = F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).otherwise(F.format_string("%s (%s)", "unnamed", "label"))
    return rows.withColumn("source_name", F.format_string("%s (%s)", name, F.col("label"))).withColumn("title", before_outlet(F.col("title"))).withColumn("category", F.lit(LOCAL)).drop("group", "label", "unnamed")
