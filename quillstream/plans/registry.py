"""Queries of the news-monitoring operators over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import dates, text
from quillstream.functions.lexicon import Lexicon, re2
from quillstream.operators import classify, dedup, filters, lookup, report, stages, upsert
from quillstream.plans import ingest, sql
from quillstream.schema import ARTICLES_SQL, articles, migrated, table
from quillstream.sources import configured, feeds, html
from quillstream.sources.news_table import NewsTable
from quillstream.streaming import monitor

DAY, AS_OF = "2024-01-02", "2024-01-03 12:00:00"
#: A lexicon of words that the test documents have; the engine's users bring their own.
LEXICON = Lexicon(
    keywords=("eau", "ouan", "elle", "ment", "inea", "ating", "rent", "reth", "erat", "ertion", "rely", "thnt", "qui", "par", "erat", "whst", "nterti", "theastou", "lytionat", "vipa"),
    countries={"Azerbaycan": ("eau", "ouan", "erat"), "KKTC": ("rely",), "Kazakistan": ("elle", "ating"), "Kırgızistan": ("rent",), "Özbekistan": ("ertion",), "Türkmenistan": ("thnt",)},
    topics={"Ermenistan Hattı": ("inea", "onon"), "Sınır Hattı & Bölgesel Diplomasi": ("reth",), "Spor": ("thre", "par"), "Güvenlik/Savunma": ("ther", "des"), "Enerji/Ekonomi": ("from", "que")},
    flagging=("Ermenistan Hattı", "Sınır Hattı & Bölgesel Diplomasi"),
    union=("whst", "theastou"),
    weak=("qui", "reth"),
    masks=(r"(?i)\bthe\s+ating\b", r"(?i)\bles\s+elle\b"),
)
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = f"WITH {ARTICLES_SQL}{oracle if oracle.lstrip().startswith(',') else ' ' + oracle}"
        return f

    return add


def _news(spark: SparkSession, sf: str) -> DataFrame:
    """articles, labelled by the lexicon's first stage."""
    return classify.labelled(classify.with_stage1(articles(spark, sf), LEXICON)).drop("stage1")


_STAGE1 = sql.stage1(LEXICON)
_NEWS = f", {_STAGE1}, {sql.NEWS}"
_KEYED = ", " + sql.KEYED


@_query(f"{_NEWS} SELECT count(*) AS total, count(*) FILTER (ilgili_mi = 1) AS relevant, count(*) FILTER (category = 'en') AS english, count(*) FILTER (category = 'de') AS german FROM news WHERE publish_date BETWEEN '{DAY} 00:00:00' AND '{DAY} 23:59:59'")
def daily_summary(spark, sf):
    return report.daily_summary(_news(spark, sf), DAY, {"english": "en", "german": "de"})


@_query("SELECT source_name, count(*) AS articles FROM articles GROUP BY 1")
def source_counts(spark, sf):
    return report.per_source(articles(spark, sf))


@_query(", c AS (SELECT source_name || '/' || category AS name, count(*) AS articles FROM articles GROUP BY 1) SELECT name, regexp_replace(lower(name), '[^\\pL\\pN]', '', 'g')[1:16] AS slug, false AS is_other, articles FROM c WHERE articles >= 10 UNION ALL SELECT 'other', 'other', true, CAST(sum(articles) AS BIGINT) FROM c WHERE articles < 10 HAVING count(*) > 0")
def threshold_groups(spark, sf):
    return report.threshold_groups(articles(spark, sf).withColumn("group", F.concat_ws("/", "source_name", "category")), by="group")


@_query(f"{_NEWS} SELECT count(*) AS relevant, " + ", ".join(f"count(*) FILTER ({' OR '.join(f'contains(c, {sql.text(w)})' for w in words)}) AS {name}" for name, words in report.COUNTRY_MARKS.items()) + " FROM (SELECT trim(lower(translate(ilgi_kategorisi, 'İIƏ', 'iıə'))) AS c FROM news WHERE ilgili_mi = 1)")
def country_multi_counts(spark, sf):
    return report.country_counts(_news(spark, sf))


@_query(f"{_NEWS} SELECT ilgi_kategorisi, count(*) AS articles FROM news WHERE ilgili_mi = 1 GROUP BY 1")
def aspect_counts(spark, sf):
    return report.per_aspect(_news(spark, sf))


@_query(f"{_NEWS} SELECT count(*) AS total, count(*) FILTER (ilgili_mi = 1) AS filtered FROM news")
def total_and_relevant(spark, sf):
    return report.filtered_and_all(_news(spark, sf), F.col("ilgili_mi") == 1)


@_query("SELECT count(*) FILTER (publish_date < '2024-01-03 00:00:00') AS past, count(*) FILTER (publish_date >= '2024-01-03 00:00:00') AS today FROM articles")
def past_vs_today(spark, sf):
    return report.past_and_today(articles(spark, sf), AS_OF)


@_query("SELECT DISTINCT publish_date[1:10] AS day FROM articles ORDER BY 1 DESC LIMIT 30")
def recent_days(spark, sf):
    return report.recent_days(articles(spark, sf))


@_query(", d AS (SELECT DISTINCT publish_date[1:10] AS day FROM articles), a AS (SELECT '2024-01-09' AS day, true AS f UNION ALL SELECT day, false FROM d), r AS (SELECT day, row_number() OVER (ORDER BY f DESC, day DESC) AS place FROM a) SELECT day, CAST(place AS INTEGER) AS place, place <= 3 OR day = '2024-01-01' AS is_quick FROM r")
def quick_days(spark, sf):
    return report.quick_days(report.recent_days(articles(spark, sf)), "2024-01-09 08:00:00", "2024-01-01")


@_query(", c AS (SELECT source_name, count(*) AS n FROM articles WHERE category <> 'en' GROUP BY 1), o AS (SELECT source_name, row_number() OVER (ORDER BY n DESC, source_name) AS g FROM c WHERE n >= 20) SELECT id, a.source_name, g IS NULL AS is_other, CAST(coalesce(g, (SELECT coalesce(max(g), 0) + 1 FROM o)) AS INTEGER) AS group_rank FROM articles a JOIN c USING (source_name) LEFT JOIN o USING (source_name) WHERE category <> 'en'")
def source_groups(spark, sf):
    return report.source_groups(articles(spark, sf).where("category <> 'en'"), 20).select("id", "source_name", "is_other", "group_rank")


@_query("SELECT source_name, count(*) AS fetched, count(*) FILTER (publish_date >= '2024-01-03 00:00:00') AS today FROM articles GROUP BY 1")
def adapter_health(spark, sf):
    return report.adapter_health(articles(spark, sf), AS_OF)


@_query(f"{_NEWS}, l AS (SELECT unnest(['Azerbaycan', 'Kazakistan', 'KKTC', 'Spor']) AS label), r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY publish_date DESC, id DESC) AS turn FROM news, l WHERE ilgili_mi = 1 AND contains(ilgi_kategorisi, label)) SELECT label, id, CAST(turn AS INTEGER) AS turn FROM r WHERE turn <= 2")
def top2_per_label(spark, sf):
    return report.newest_per_label(_news(spark, sf), ["Azerbaycan", "Kazakistan", "KKTC", "Spor"]).select("label", "id", "turn")


@_query(f"SELECT id, {sql.title_key('title')} AS view_key, {sql.title_key('title', False)} AS dedup_key FROM articles")
def title_norm(spark, sf):
    return articles(spark, sf).select("id", text.title_key(F.col("title")).alias("view_key"), text.title_key(F.col("title"), False).alias("dedup_key"))


@_query(f"SELECT id, list_sort({sql.words('title')}) AS words, list_sort({sql.words('title', (*text.TITLE_STOPWORDS, *text.NOTICE_STOPWORDS))}) AS notice_words, list_sort({sql.folded_words('title')}) AS folded FROM articles")
def title_tokens(spark, sf):
    t = F.col("title")
    return articles(spark, sf).select("id", F.array_sort(text.title_words(t)).alias("words"), F.array_sort(text.title_words(t, (*text.TITLE_STOPWORDS, *text.NOTICE_STOPWORDS))).alias("notice_words"), F.array_sort(text.folded_words(t)).alias("folded"))


@_query(f", w AS (SELECT id, {sql.words('title')} AS a, lag({sql.words('title')}) OVER (PARTITION BY source_name ORDER BY id) AS b FROM articles) SELECT id, {sql.jaccard('a', 'b')} AS similarity, {sql.contained('a', 'b')} AS nested FROM w WHERE b IS NOT NULL")
def title_similarity(spark, sf):
    from pyspark.sql import Window

    w = articles(spark, sf).select("id", "source_name", text.title_words(F.col("title")).alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy("source_name").orderBy("id")))
    return w.where("b is not null").select("id", text.jaccard(F.col("a"), F.col("b")).alias("similarity"), text.contained(F.col("a"), F.col("b")).alias("nested"))


@_query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x{a0}]+', ' ', 'g'), ' ') AS body FROM pages")
def text_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("body"))


@_query(f"SELECT page_id, {sql.canonical_url('url')} AS link FROM pages")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.canonical_url(F.col("url")).alias("link"))


@_query(f"SELECT id, {sql.is_junk('title')} AS junk FROM articles")
def junk_titles(spark, sf):
    return articles(spark, sf).select("id", text.is_junk_title(F.col("title")).alias("junk"))


@_query("SELECT id, lower(translate(title, 'İIƏ', 'iıə')) AS turkish, trim(lower(translate(translate(title, 'İI', 'iı'), 'ıöüşçğ', 'iouscg'))) AS folded, (regexp_replace(lower(title), '[^\\pL\\pN]', '', 'g'))[1:16] AS slug, publish_date[12:16] AS clock, publish_date[1:10] AS day FROM articles")
def text_folds(spark, sf):
    t = F.col("title")
    return articles(spark, sf).select("id", text.turkish_lower(t).alias("turkish"), text.search_fold(t).alias("folded"), text.source_slug(t).alias("slug"), text.display_time(F.col("publish_date")).alias("clock"), text.day_of(F.col("publish_date")).alias("day"))


@_query("SELECT id, length(trim(summary, ' ')) < 60 OR trim(summary, ' ') IN ('...', '` and `') OR suffix(trim(summary, ' '), '...') OR suffix(trim(summary, ' '), '…') AS needs_brief, length(summary) >= 60 AND right(trim(summary, ' '), 3) <> '...' AS is_full, length(trim(summary, ' ')) < 50 AS needs_body FROM articles")
def summary_quality(spark, sf):
    s = F.col("summary")
    return articles(spark, sf).select("id", text.needs_brief(s).alias("needs_brief"), text.is_full_summary(s).alias("is_full"), filters.needs_body().alias("needs_body"))


@_query(", t AS (SELECT id, CASE WHEN id % 3 = 0 THEN title || ' - ' || source_name WHEN id % 3 = 1 THEN 'Short - ' || source_name ELSE title END AS raw FROM articles) SELECT id, CASE WHEN length(trim(regexp_extract(raw, '(?s)^(.*) - ', 1))) > 10 THEN trim(regexp_extract(raw, '(?s)^(.*) - ', 1)) ELSE raw END AS title, trim(string_split(raw, ' - ')[-1]) AS outlet FROM t")
def title_suffixes(spark, sf):
    raw = F.when(F.col("id") % 3 == 0, F.concat_ws(" - ", "title", "source_name")).when(F.col("id") % 3 == 1, F.concat(F.lit("Short - "), F.col("source_name"))).otherwise(F.col("title"))
    return articles(spark, sf).select("id", text.strip_title_suffix(raw).alias("title"), feeds.outlet_of(raw).alias("outlet"))


_SAID = "CASE id % 5 WHEN 0 THEN (id % 59) || ' dak önce' WHEN 1 THEN (id % 23) || ' saat önce' WHEN 2 THEN (id % 6) || ' gün önce' WHEN 3 THEN (id % 7) || ' hours ago' ELSE 'yesterday' END"


@_query(f", t AS (SELECT id, {_SAID} AS raw FROM articles) SELECT id, strftime(TIMESTAMP '{AS_OF}' - to_seconds(CASE WHEN raw LIKE '%dak%' THEN 60 WHEN raw LIKE '%saat%' OR raw LIKE '%hour%' THEN 3600 WHEN raw LIKE '%gün%' THEN 86400 END * TRY_CAST(regexp_extract(raw, '^\\d+') AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS publish_date FROM t")
def relative_date(spark, sf):
    return articles(spark, sf).select("id", dates.relative_date(F.expr(_SAID), AS_OF).alias("publish_date"))


_RAW_DATE = "CASE id % 6 WHEN 0 THEN substr(publish_date, 1, 10) || 'T' || substr(publish_date, 12) || 'Z' WHEN 1 THEN substr(publish_date, 9, 2) || '.' || substr(publish_date, 6, 2) || '.' || substr(publish_date, 1, 4) || ' ' || substr(publish_date, 12, 5) WHEN 2 THEN 'Mon, 0' || (id % 9 + 1) || ' Jan 2024 ' || substr(publish_date, 12) || ' +0300' WHEN 3 THEN substr(publish_date, 1, 16) WHEN 4 THEN publish_date || '.123' ELSE 'unknown' END"
_FORM = "'%Y-%m-%d %H:%M:%S'"
_PARSED = f"coalesce(strftime(try_strptime(regexp_extract(raw, '^\\w+, (.*) \\+0300$', 1), '%d %b %Y %H:%M:%S') - INTERVAL 3 HOUR, {_FORM}), strftime(try_strptime(replace(replace(string_split(raw, '.')[1], 'Z', ''), 'T', ' '), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d']), {_FORM}), strftime(try_strptime(raw, ['%d.%m.%Y %H:%M:%S', '%d.%m.%Y %H:%M']), {_FORM}))"


@_query(f", t AS (SELECT id, {_RAW_DATE} AS raw FROM articles) SELECT id, coalesce({_PARSED}, '{AS_OF}') AS feed, least(coalesce({_PARSED}, '{AS_OF}'), '{AS_OF}') AS pipeline, strftime(try_strptime(trim(translate(string_split(raw, '.')[1], 'TZ', ' ')), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M']), {_FORM}) AS meta FROM (SELECT id, CASE WHEN raw = 'unknown' THEN 'none' ELSE raw END AS raw FROM t WHERE raw NOT LIKE '__.__.____ %') UNION ALL SELECT id, coalesce({_PARSED}, '{AS_OF}'), least(coalesce({_PARSED}, '{AS_OF}'), '{AS_OF}'), NULL FROM t WHERE raw LIKE '__.__.____ %'")
def parse_dates(spark, sf):
    raw = F.expr(_RAW_DATE)
    a = articles(spark, sf)
    return a.select("id", dates.feed_date(raw, F.lit(""), AS_OF).alias("feed"), dates.pipeline_date(raw, AS_OF).alias("pipeline"), dates.parse_date(raw).alias("meta"))


_MONTHS = ("Ocak", "Mart", "Temmuz", "Ekim", "Haziran")
_SPOKEN = "CASE id % 4 WHEN 0 THEN 'Haber ' || (id % 33) || ' ' || m || ' 2023 14:05 not' WHEN 1 THEN 'on ' || (id % 33) || '.0' || (id % 9 + 1) || '.2023' WHEN 2 THEN (id % 33) || ' ' || m || ' 2023' ELSE 'none' END"


@_query(
    f", t AS (SELECT id, {_SPOKEN} AS raw, m, CASE m WHEN 'Ocak' THEN 1 WHEN 'Mart' THEN 3 WHEN 'Temmuz' THEN 7 WHEN 'Ekim' THEN 10 ELSE 6 END AS mn FROM (SELECT *, [{', '.join(map(sql.text, _MONTHS))}][CAST(id % 5 + 1 AS INTEGER)] AS m FROM articles)) "
    f"SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE strftime(try_strptime(CASE id % 4 WHEN 0 THEN (id % 33) || '.' || mn || '.2023 14:05' WHEN 1 THEN (id % 33) || '.' || (id % 9 + 1) || '.2023 12:00' ELSE (id % 33) || '.' || mn || '.2023 12:00' END, '%d.%m.%Y %H:%M'), {_FORM}) END AS text_date, "
    f"CASE WHEN id % 2 = 0 THEN strftime(try_strptime((id % 33) || '.' || mn || '.2023 12:00', '%d.%m.%Y %H:%M'), {_FORM}) END AS title_date FROM t"
)
def turkish_dates(spark, sf):
    a = articles(spark, sf).withColumn("m", F.element_at(F.array(*map(F.lit, _MONTHS)), (F.col("id") % 5 + 1).cast("int")))
    return a.select("id", dates.text_date(F.expr(_SPOKEN)).alias("text_date"), dates.title_date(F.expr(_SPOKEN), AS_OF).alias("title_date"))


_TIMED = "CASE id % 4 WHEN 0 THEN 'Spor / ' || (id % 30) || ':15 - ' || source_name WHEN 1 THEN (id % 30) || '.45 ' || source_name ELSE source_name END"


@_query(f", t AS (SELECT id, {_TIMED} AS raw, publish_date[1:10] || ' 00:00:00' AS d, source_name, id % 30 AS h FROM articles) SELECT id, CASE WHEN id % 4 = 1 AND h <= 23 THEN d[1:10] || ' ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':45:00' ELSE d END AS title_time, CASE WHEN id % 4 = 0 AND h <= 23 THEN source_name ELSE raw END AS section_title, CASE WHEN id % 4 = 0 AND h <= 23 THEN d[1:10] || ' ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':15:00' ELSE d END AS section_time, CASE WHEN id % 4 = 0 AND h <= 29 THEN '2024-01-03 ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':15:00' WHEN id % 4 = 1 AND h <= 29 THEN '2024-01-03 ' || lpad(CAST(h AS VARCHAR), 2, '0') || ':45:00' END AS clock FROM t")
def title_times(spark, sf):
    raw, d = F.expr(_TIMED), F.concat(text.day_of(F.col("publish_date")), F.lit(" 00:00:00"))
    s = dates.section_time(raw, d)
    return articles(spark, sf).select("id", dates.with_title_time(d, raw).alias("title_time"), s["title"].alias("section_title"), s["publish_date"].alias("section_time"), dates.clock_in(raw, AS_OF).alias("clock"))


@_query(f"{_NEWS} SELECT id FROM news WHERE publish_date BETWEEN '{DAY} 00:00:00' AND '{DAY} 23:59:59' AND (relevance_status ILIKE 'Stage 1%' OR relevance_status ILIKE 'Stage 2%' OR relevance_status = 'İlgili' OR ilgili_mi = 1)")
def relevant_of_day(spark, sf):
    return _news(spark, sf).where(filters.on_day(DAY) & filters.is_relevant()).select("id")


@_query("SELECT event_id, event_type FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events))")
def today_filter(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("ts") >= F.date_trunc("day", e.agg(F.max("ts")).scalar()).cast("timestamp_ntz")).select("event_id", "event_type")


@_query("SELECT id FROM articles WHERE NOT (source_name ILIKE '%src1%' OR link ILIKE '%src7.example%')")
def blocklist_purge(spark, sf):
    return articles(spark, sf).where(~filters.blocked(("%src1%",), ("src7.example",))).select("id")


@_query(f", t AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE publish_date END AS publish_date, CASE WHEN id % 6 = 0 THEN 'x 31.12.2023 y' ELSE 'x' END AS title, CASE WHEN id % 9 = 0 THEN 'y 30/11/2023' ELSE summary END AS summary FROM articles) SELECT id, CASE WHEN publish_date <> '' AND publish_date < '2024-01-03 00:00:00' THEN 'DB date was ' || publish_date WHEN id % 6 = 0 THEN 'Title contained 2023-12-31' WHEN id % 9 = 0 THEN 'Summary contained 2023-11-30' END AS reason FROM t")
def outdated_reason(spark, sf):
    a = articles(spark, sf)
    a = a.withColumns({"publish_date": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("publish_date")), "title": F.when(F.col("id") % 6 == 0, "x 31.12.2023 y").otherwise("x"), "summary": F.when(F.col("id") % 9 == 0, "y 30/11/2023").otherwise(F.col("summary"))})
    return a.select("id", filters.outdated_reason(AS_OF).alias("reason"))


@_query(f"{_NEWS} SELECT id FROM news WHERE ilgili_mi = 1 AND (summary IS NULL OR summary IN ('', '...', '` and `') OR summary LIKE '%...' OR length(summary) < 60) ORDER BY publish_date DESC, id DESC LIMIT 40")
def brief_backfill(spark, sf):
    return filters.backfill(_news(spark, sf)).select("id")


@_query(f"{_NEWS}, c AS (SELECT source_name AS s, count(*) AS n FROM news GROUP BY 1), f AS (SELECT news.*, n < 60 AS is_other FROM news JOIN c ON s = source_name WHERE ilgili_mi = 1 AND contains(trim(lower(translate(translate(ilgi_kategorisi, 'İI', 'iı'), 'ıöüşçğ', 'iouscg'))), 'azerbaycan') AND contains(trim(lower(translate(translate(ilgi_kategorisi, 'İI', 'iı'), 'ıöüşçğ', 'iouscg'))), 'spor') AND (n < 60 OR category = 'Diğer / Sınıflandırılmamış') AND (contains(lower(title), 'src') OR contains(lower(source_name), 'src') OR contains(lower(ilgi_kategorisi), 'src'))) SELECT id, (SELECT count(*) FROM f) AS matches FROM f ORDER BY publish_date DESC, id DESC LIMIT 50")
def search_page(spark, sf):
    return report.page(report.with_other_flag(_news(spark, sf), 60), "Azerbaycan", "Spor", "other", "SRC").select("id", "matches")


@_query("SELECT id FROM articles ORDER BY publish_date, id LIMIT 25")
def oldest_first_page(spark, sf):
    return report.page(articles(spark, sf).withColumns({"ilgili_mi": F.lit(0), "ilgi_kategorisi": F.lit(""), "is_other": F.lit(False)}), shown=25, newest=False).select("id")


@_query(f", {_STAGE1} SELECT id, found[1:5] AS matched FROM stage1")
def keyword_matches(spark, sf):
    a = articles(spark, sf)
    t = classify.masked(classify.lead(F.col("title"), F.col("summary")), LEXICON.masks)
    return a.select("id", F.slice(classify.keywords_in(t, LEXICON.keywords), 1, 5).alias("matched"))


#: The shipped lexicon, and articles that hold its words, some with a capital, among those of the documents.
DEFAULT = Lexicon.read()
_WORDS = list(dict.fromkeys(w for words in (DEFAULT.keywords, *DEFAULT.countries.values(), *DEFAULT.topics.values(), DEFAULT.union) for w in words))
_SPOKEN_OF = "CASE WHEN id % 3 = 0 THEN upper(substr(w1, 1, 1)) || substr(w1, 2) WHEN id % 7 = 1 THEN w1 || 'x' ELSE w1 END || ', ' || source_name || ' ' || w2 || CASE WHEN id % 5 = 0 THEN chr(39) || 'da ' ELSE ' ' END || title"


def _default_sql(columns: str) -> str:
    """A query over articles that hold the shipped lexicon's words. The masks are Java's, so they are left out."""
    picked = f"list AS (SELECT {sql.texts(_WORDS)} AS ws), told AS (SELECT * REPLACE ({_SPOKEN_OF} AS title) FROM (SELECT articles.*, ws[id * 7 % {len(_WORDS)} + 1] AS w1, ws[id * 11 % {len(_WORDS)} + 1] AS w2 FROM articles, list))"
    return f", {picked}, {sql.stage1(replace(DEFAULT, masks=())).replace('FROM articles', 'FROM told')} SELECT {columns} FROM stage1"


def _told(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*map(F.lit, _WORDS))
    word = lambda n: F.element_at(words, (F.col("id") * n % len(_WORDS) + 1).cast("int"))
    return articles(spark, sf).withColumns({"w1": word(7), "w2": word(11)}).withColumn("title", F.expr(_SPOKEN_OF)).drop("w1", "w2")


@_query(_default_sql("id, found[1:5] AS matched"))
def default_keywords(spark, sf):
    """The shipped keywords, repeated ones too, in articles that hold some."""
    t = classify.lead(F.col("title"), F.col("summary"))
    return _told(spark, sf).select("id", F.slice(classify.keywords_in(t, DEFAULT.keywords), 1, 5).alias("matched"))


@_query(_default_sql("id, is_candidate, aspect"))
def default_aspects(spark, sf):
    """The shipped lexicon's first stage."""
    s = classify.with_stage1(_told(spark, sf), replace(DEFAULT, masks=()))
    return s.select("id", F.col("stage1.is_candidate").alias("is_candidate"), F.col("stage1.aspect").alias("aspect"))


@_query(f", {_STAGE1} SELECT id, t AS masked FROM stage1")
def false_friends(spark, sf):
    return articles(spark, sf).select("id", classify.masked(classify.lead(F.col("title"), F.col("summary")), LEXICON.masks).alias("masked"))


@_query(f", {_STAGE1} SELECT id, is_candidate FROM stage1")
def weak_gate(spark, sf):
    return classify.with_stage1(articles(spark, sf), LEXICON).select("id", F.col("stage1.is_candidate").alias("is_candidate"))


@_query(f", {_STAGE1} SELECT id, aspect FROM stage1 WHERE aspect IS NOT NULL")
def aspect_cascade(spark, sf):
    return classify.with_stage1(articles(spark, sf), LEXICON).where("stage1.aspect is not null").select("id", F.col("stage1.aspect").alias("aspect"))


@_query(f", {_STAGE1} SELECT id, aspect IS NOT NULL AS is_relevant, CASE WHEN aspect IS NOT NULL THEN 'Stage 1 (Anahtar Kelime)' END AS stage, is_candidate, CASE WHEN aspect IS NOT NULL OR is_candidate THEN found[1:5] ELSE [] END AS matched, CASE WHEN aspect IS NOT NULL THEN 'Tespit edildi: ' || aspect WHEN is_candidate THEN 'Zayıf anahtar kelime (LLM doğrulaması gerekli): ' || array_to_string(found[1:3], ', ') ELSE '' END AS explanation FROM stage1")
def stage1_result(spark, sf):
    s = classify.with_stage1(articles(spark, sf), LEXICON)
    return s.select("id", *(F.col(f"stage1.{c}").alias(c) for c in ("is_relevant", "stage", "is_candidate", "matched", "explanation")))


@_query(f"{_NEWS} SELECT id, ilgili_mi, ilgi_kategorisi, guven_skoru, gerekce, relevance_status, relevance_aspect FROM news")
def item_labels(spark, sf):
    return _news(spark, sf).select("id", "ilgili_mi", "ilgi_kategorisi", "guven_skoru", "gerekce", "relevance_status", "relevance_aspect")


@_query(f"{_NEWS} SELECT id, ilgili_mi, ilgi_kategorisi, relevance_status, 0.5::DOUBLE AS guven_skoru FROM news")
def bulk_reclassify(spark, sf):
    stored = _news(spark, sf).withColumns({"ilgili_mi": F.lit(1), "guven_skoru": F.lit(0.5)})
    return classify.reclassified(stored, LEXICON).select("id", "ilgili_mi", "ilgi_kategorisi", "relevance_status", "guven_skoru")


_STRICT = {"Spor": ("ing", "elle"), "Enerji": ("tion",)}


@_query(f", t AS (SELECT id, title, lower(title) AS low, summary[1:250] AS lead FROM articles), y AS (SELECT *, NOT regexp_matches(title, '(?i)\\bthe the\\b') AND (regexp_matches(title, {sql.text(re2('eau', 'thnt', 'erat'))}) OR regexp_matches(lead, {sql.text(re2('eau', 'thnt', 'erat'))}) AND (contains(low, 'and') OR contains(low, 'le'))) AS yes FROM t) SELECT id, CAST(yes AS INTEGER) AS ilgili_mi, CASE WHEN NOT yes THEN 'İlgisiz' WHEN contains(low, 'ing') OR contains(low, 'elle') THEN 'Spor' WHEN contains(low, 'tion') THEN 'Enerji' ELSE 'Diplomasi' END AS ilgi_kategorisi FROM y")
def strict_relabel(spark, sf):
    return classify.strictly_relabelled(articles(spark, sf), ("eau", "thnt", "erat"), (r"(?i)\bthe the\b",), ("and", "le"), _STRICT, "Diplomasi").select("id", "ilgili_mi", "ilgi_kategorisi")


_PATTERNS = lookup.outlet_patterns()
_PATTERN_ROWS = ", ".join(f"({i}, {sql.text(p)}, {sql.text(c)})" for i, (p, c) in enumerate(_PATTERNS))
#: Names as sources write them: outlets, with something before or after, parts of one, and others.
_OUTLET_NAMES = [x for i, (p, _) in enumerate(_PATTERNS) for x in (p, f" {p} online" if i % 2 else f"yeni {p}", p[: len(p) // 2])] + ["", "zzz", "xq"]


@_query(f", p(ord, pattern, cat) AS (VALUES {_PATTERN_ROWS}), n AS (SELECT id, category, {sql.texts(_OUTLET_NAMES)}[id % {len(_OUTLET_NAMES)} + 1] AS source FROM articles), m AS (SELECT id, arg_min(cat, (CASE WHEN n = pattern THEN 0 ELSE 1 END, ord)) AS cat FROM (SELECT id, lower(trim(source)) AS n FROM n) JOIN p ON n = pattern OR contains(n, pattern) OR contains(pattern, n) GROUP BY id) SELECT id, coalesce(cat, category) AS resolved FROM n LEFT JOIN m USING (id)")
def category_resolution(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _OUTLET_NAMES)), (F.col("id") % len(_OUTLET_NAMES) + 1).cast("int"))
    return lookup.with_category(articles(spark, sf).withColumn("source_name", name)).select("id", "resolved")


@_query(_SQL["category_resolution"].split(ARTICLES_SQL, 1)[1])
def category_join(spark, sf):
    """As category_resolution, with the patterns as a table."""
    name = F.element_at(F.array(*map(F.lit, _OUTLET_NAMES)), (F.col("id") % len(_OUTLET_NAMES) + 1).cast("int"))
    patterns = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(_PATTERNS)], "ord int, pattern string, category string")
    return lookup.with_category(articles(spark, sf).withColumn("source_name", name), patterns).select("id", "resolved")


_SOURCES = [(0, "SRC1", "A", "rss", "src1"), (1, "Src12 News", "B", "scraping", ""), (2, "c3", "C", "rss+scraping", ""), (3, "src4", "D", "html", "")]
_SOURCE_ROWS = ", ".join(f"({i}, {sql.text(n)}, {sql.text(c)}, {sql.text(t)})" for i, n, c, t, _ in _SOURCES)


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SOURCES, "ord int, name string, category string, type string, domain string")


@_query(f", s(ord, name, cat, type) AS (VALUES {_SOURCE_ROWS}), m AS (SELECT id, arg_min(name, ord) AS name, arg_min(cat, ord) AS cat FROM articles JOIN s ON contains(lower(source_name), lower(name)) OR contains(lower(name), lower(source_name)) GROUP BY id) SELECT id, coalesce(name, source_name) AS source_name, coalesce(cat, 'Diğer / Sınıflandırılmamış') AS category FROM articles LEFT JOIN m USING (id)")
def source_match(spark, sf):
    return lookup.with_source(articles(spark, sf).select("id", F.col("source_name").alias("raw_source")), _sources(spark)).select("id", "source_name", "category")


@_query(f", s(ord, name, cat, type) AS (VALUES {_SOURCE_ROWS}) SELECT id, CASE WHEN contains(type, 'rss') THEN 'RSS' ELSE 'Scraping' END AS veri_kaynagi FROM articles LEFT JOIN s ON source_name = name")
def provenance_tag(spark, sf):
    return lookup.with_provenance(articles(spark, sf), _sources(spark)).select("id", "veri_kaynagi")


@_query(", i AS (SELECT id AS ord, source_name, 'https://x/' || (id % 17) AS link FROM articles) SELECT ord, source_name, link FROM i QUALIFY row_number() OVER (PARTITION BY source_name, link ORDER BY ord) = 1")
def first_per_link(spark, sf):
    i = articles(spark, sf).select(F.col("id").alias("ord"), "source_name", F.concat(F.lit("https://x/"), (F.col("id") % 17).cast("string")).alias("link"))
    return dedup.per_link(i)


@_query(", i AS (SELECT id AS ord, source_name, title, publish_date, category, link FROM articles), s AS (SELECT * FROM i WHERE category = 'en'), k AS (SELECT *, " + sql.title_key("title", False) + " AS t, publish_date[1:10] AS d FROM i WHERE category <> 'en' OR ord % 2 = 1), n AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE ord % 2 = 0 AND s.source_name = k.source_name AND s.publish_date[1:10] = k.d AND " + sql.title_key("s.title", False) + " = k.t)) SELECT ord FROM n QUALIFY t = '' OR row_number() OVER (PARTITION BY source_name, d, t ORDER BY ord) = 1")
def exact_new_stories(spark, sf):
    i = articles(spark, sf).withColumn("ord", F.col("id"))
    old = (F.col("category") == "en") & (F.col("ord") % 2 == 0)
    return dedup.new_stories(i.where(~old), i.where(old)).select("ord")


_AGG = ", g AS (SELECT id, source_name, title, summary, publish_date, CASE WHEN id % 4 = 1 THEN 'https://news.google.com/' || id ELSE link END AS link, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS ilgili_mi, category FROM articles)"


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """articles with some aggregator links and some relevant rows."""
    link = F.when(F.col("id") % 4 == 1, F.concat(F.lit("https://news.google.com/"), F.col("id").cast("string"))).otherwise(F.col("link"))
    return articles(spark, sf).withColumn("link", link).withColumn("ilgili_mi", F.when(F.col("id") % 5 == 0, 1).otherwise(0))


@_query(_AGG + f", k AS (SELECT *, {sql.title_key('title')} AS t, publish_date[1:10] AS d FROM g), w AS (SELECT *, row_number() OVER (PARTITION BY source_name, d, t ORDER BY id) AS n, min(CASE WHEN NOT contains(link, 'news.google.com') THEN (id, link) END) OVER (PARTITION BY source_name, d, t) AS m FROM k WHERE t <> '') SELECT id, CASE WHEN contains(link, 'news.google.com') THEN coalesce(m[2], link) ELSE link END AS link FROM w WHERE n = 1 UNION ALL SELECT id, link FROM k WHERE t = ''")
def store_dedup(spark, sf):
    return dedup.on_storing(_mixed(spark, sf)).select("id", "link")


@_query(_KEYED + " SELECT id FROM keyed QUALIFY row_number() OVER (PARTITION BY source_name, k ORDER BY publish_date DESC, id DESC) = 1")
def view_dedup(spark, sf):
    return dedup.for_reading(articles(spark, sf)).select("id")


@_query(_AGG + ", " + sql.keyed("g", False) + ", s AS (SELECT list(struct_pack(id := id, a := contains(link, 'news.google.com'), r := ilgili_mi) ORDER BY id) AS xs FROM keyed GROUP BY source_name, publish_date[1:10], k) SELECT list_reduce(xs, lambda p, x: CASE WHEN p.a AND NOT x.a OR p.r = 0 AND x.r = 1 THEN x ELSE p END).id AS id FROM s")
def exact_purge(spark, sf):
    return dedup.sequential_survivors(_mixed(spark, sf)).select("id")


@_query(_AGG + ", " + sql.keyed("g") + " SELECT id FROM keyed QUALIFY row_number() OVER (PARTITION BY source_name, publish_date[1:10], k ORDER BY ilgili_mi DESC, contains(link, 'news.google.com'), length(summary) DESC, id DESC) = 1")
def best_of_group(spark, sf):
    return dedup.best_of_stories(_mixed(spark, sf)).select("id")


@_query(_KEYED + ", c AS (SELECT count(*) AS n FROM keyed GROUP BY source_name, publish_date[1:10], k) SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM c WHERE n > 1")
def dup_audit(spark, sf):
    return dedup.surplus(articles(spark, sf))


@_query(", " + sql.fold("articles", "category", "len(x.w) >= 3 AND len(k.w) > 0 AND (" + sql.jaccard("k.w", "x.w") + " >= 0.65 OR " + sql.contained("k.w", "x.w") + ")", "false") + " SELECT id FROM folded")
def near_dup_fold(spark, sf):
    return dedup.near_survivors(articles(spark, sf), dedup.INGEST, ["category"]).select("id")


_NEAR60 = "(" + sql.jaccard("k.w", "x.w") + " >= 0.6 OR (" + sql.contained("k.w", "x.w") + " AND least(len(k.w), len(x.w)) >= 3))"


@_query(_AGG + ", " + sql.fold("g", "source_name, publish_date[1:10]", _NEAR60, "(h.a AND NOT x.a OR h.r = 0 AND x.r = 1 OR x.n > h.n AND h.r = x.r AND NOT x.a)") + " SELECT id FROM folded")
def near_dup_survivor(spark, sf):
    return dedup.near_survivors(_mixed(spark, sf), dedup.HISTORY).select("id")


_NEAR65 = "(" + sql.jaccard("k.w", "x.w") + " >= 0.65 OR (" + sql.jaccard("k.w", "x.w") + " >= 0.5 AND abs(k.ts - x.ts) <= 3600) OR (" + sql.contained("k.w", "x.w") + " AND least(len(k.w), len(x.w)) >= 3))"


@_query(_AGG + f", gd AS (SELECT * FROM g WHERE publish_date[1:10] = '{DAY}'), " + sql.fold("gd", "source_name", _NEAR65, "(h.r = 0 AND x.r = 1 OR x.n > h.n AND h.r = x.r)") + " SELECT id FROM folded")
def near_dup_time(spark, sf):
    """Of one day, as the rule for recent rows is."""
    return dedup.near_survivors(_mixed(spark, sf).where(filters.on_day(DAY)), dedup.ONE_DAY, ["source_name"]).select("id")


@_query(", i AS (SELECT id AS ord, 'https://x/' || (id % 400) AS link FROM articles) SELECT ord, link FROM i WHERE ord % 400 NOT IN (SELECT id FROM articles WHERE id < 50) QUALIFY row_number() OVER (PARTITION BY link ORDER BY ord) = 1")
def known_links(spark, sf):
    link = F.concat(F.lit("https://x/"), (F.col("id") % 400).cast("string"))
    a = articles(spark, sf)
    return filters.unknown_links(a.select(F.col("id").alias("ord"), link.alias("link")), a.where("id < 50").select(F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("link"))).select("ord", "link")


_POLICY = [("src1", "both"), ("src2", "fallback"), ("src3", "fallback"), ("src4", "feed")]


@_query(", f AS (SELECT id, source_name FROM articles WHERE source_name <> 'src3'), s AS (SELECT id + 1000000 AS id, source_name FROM articles) SELECT * FROM f UNION ALL SELECT * FROM s WHERE source_name = 'src1' OR source_name IN ('src2', 'src3') AND source_name NOT IN (SELECT source_name FROM f)")
def source_policies(spark, sf):
    a = articles(spark, sf).select("id", "source_name")
    return feeds.combined(a.where("source_name <> 'src3'"), a.withColumn("id", F.col("id") + 1000000), spark.createDataFrame(_POLICY, "source_name string, policy string"))


@_query(", i AS (SELECT id AS ord, source_name, link FROM articles WHERE length(title) >= 20 AND NOT contains(lower(title), 'elle')) SELECT ord, source_name FROM i QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY ord) <= 30")
def local_outlets(spark, sf):
    i = articles(spark, sf).withColumn("ord", F.col("id"))
    return feeds.local_items(i, ("elle",)).select("ord", "source_name")


_JSON = "concat('{\"news_results\":[{\"title\":\"Story ', id, '\",\"link\":\"', link, '\",\"date\":\"', id % 20, ' saat önce\",\"source\":{\"name\":\"', source_name, '\"}},{\"title\":\"\",\"link\":\"x\"}]}')"


@_query(f", s(ord, name, cat, type) AS (VALUES {_SOURCE_ROWS}), m AS (SELECT id, arg_min(name, ord) AS name, arg_min(cat, ord) AS cat FROM articles JOIN s ON contains(lower(source_name), lower(name)) OR contains(lower(name), lower(source_name)) GROUP BY id) SELECT 'Story ' || id AS title, coalesce(name, source_name) AS source_name, coalesce(cat, 'Diğer / Sınıflandırılmamış') AS category, strftime(TIMESTAMP '{AS_OF}' - to_hours(CAST(id % 20 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS publish_date, link FROM articles LEFT JOIN m USING (id)")
def search_results(spark, sf):
    return feeds.search_items(articles(spark, sf).select(F.expr(_JSON).alias("json")), _sources(spark), AS_OF).select("title", "source_name", "category", "publish_date", "link")


@_query(", h AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<nav\\b[^>]*>.*?</nav\\s*>|<footer\\b[^>]*>.*?</footer\\s*>', ' ', 'g') AS h FROM pages), a AS (SELECT page_id, regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS h FROM h), p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(h, '(?i)<p\\b[^>]*>')[2:], lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '(?is)</p>.*$', ''), '<[^>]+>', '', 'g'), '[\\s\\x{a0}]+', ' ', 'g'), ' ')), lambda x: x <> '' AND NOT (length(x) < 35 AND regexp_matches(lower(x), 'çerez|cookie|takip et|abone ol|paylaş|yorum yap|tıklayın|okumak için|kabul ediyorum|daha fazla'))) AS ps FROM a) SELECT page_id, CASE WHEN length(array_to_string(ps, ' ')) > 100 THEN array_to_string(ps, ' ') ELSE '' END AS body FROM p")
def html_paragraphs(spark, sf):
    return html.paragraphs(table(spark, sf, "pages")).select("page_id", "body")


@_query()
def html_article_text(spark, sf):
    """Bodies as the parser nests open paragraphs, which SQL has no words for; html_paragraphs and page_dates are its parts that have."""
    return html.bodies(table(spark, sf, "pages")).select("page_id", "body", "page_date")


_SITES = configured.SITE_CARDS
_SITE_ROWS = ", ".join(f"({i}, {sql.text(x.source)}, {sql.text(x.base)}, {sql.text(x.classes[0] if x.classes else 'none')}, {sql.texts(x.hrefs)}::VARCHAR[], {sql.texts(x.links)}::VARCHAR[], {str(x.summary).lower()}, {x.longer}, {x.cards}, {sql.texts(x.skip)}::VARCHAR[])" for i, x in enumerate(_SITES))
_CARD_TITLE = "CASE WHEN id % 17 = 3 THEN 'kurz' WHEN id % 11 = 2 THEN 'Foto Galeri ' || id || ' über ' || src ELSE 'Haber ' || id || ' über ' || src || ' heute' END"
_CARD_HREF = "CASE id % 5 WHEN 0 THEN '/gundem/x-' || id WHEN 1 THEN '/haber/dunya/y-' || id WHEN 2 THEN '/spor/z' || id WHEN 3 THEN '/else/e-' || id ELSE '/tr/turkiye/' || id END"


@_query(f""", s(n, source_name, base, class, hrefs, links, summed, longer, most, skip) AS (VALUES {_SITE_ROWS}),
a AS (SELECT s.*, id, {_CARD_TITLE} AS title, {_CARD_HREF} AS href FROM (SELECT id, source_name AS src FROM articles) JOIN s ON id % {len(_SITES)} = n),
c AS (SELECT *, 0 AS sub FROM a WHERE id % 5 IN (0, 2, 4) AND class <> 'none' UNION ALL SELECT *, 1 AS sub FROM a WHERE len(list_filter(hrefs, lambda h: contains(href, h))) > 0),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY n, id // 700 ORDER BY id, sub) <= most)
SELECT source_name, base || href AS link, title, CASE WHEN sub = 0 AND summed THEN 'Über ' || id ELSE '' END AS summary FROM f
WHERE length(title) > longer AND (len(links) = 0 OR len(list_filter(links, lambda l: contains(base || href, l))) > 0) AND len(list_filter(skip, lambda k: contains(lower(title), k))) = 0""")
def site_cards(spark, sf):
    """Articles as cards on list pages of the sites that are read by default."""
    n = (F.col("id") % len(_SITES)).cast("int")
    pick = lambda f: F.element_at(F.array(*(F.lit(f(x)) for x in _SITES)), n + 1)
    a = articles(spark, sf).select("id", F.col("source_name").alias("src"), pick(lambda x: x.source).alias("source_name"), pick(lambda x: x.classes[0] if x.classes else "none").alias("cls"))
    a = a.withColumns({"title": F.expr(_CARD_TITLE), "href": F.expr(_CARD_HREF)})
    linked = F.expr("concat('<a href=\"', href, '\"><h3>', title, '</h3></a>')")
    boxed = F.concat(F.lit('<div class="box '), F.when((F.col("id") % 5).isin(0, 2, 4), F.col("cls")).otherwise("other"), F.lit('">'), linked, F.expr("concat('<p>Über ', id, '</p></div>')"))
    card = F.when(F.col("id") % 5 == 1, linked).otherwise(boxed)
    pages = a.groupBy("source_name", F.floor(F.col("id") / 700).alias("p")).agg(F.array_sort(F.collect_list(F.struct("id", card.alias("h"))))["h"].alias("cards"))
    pages = pages.select("source_name", F.concat(F.lit("<html><body><div>"), F.array_join("cards", "\n"), F.lit("</div></body></html>")).alias("html"))
    return html.cards(pages, list(_SITES), AS_OF).select("source_name", "link", "title", "summary")


_DAY_OF_PAGE = "lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')"
_DATED = rf"""CASE page_id % 9 WHEN 0 THEN replace(html, '</head>', concat('<meta property="article:published_time" content="2024-03-', {_DAY_OF_PAGE}, 'T10:20:30Z"></head>'))
  WHEN 1 THEN replace(html, '</head>', concat('<script type="application/ld+json">{{"@type": "NewsArticle", "datePublished": "2024-02-', {_DAY_OF_PAGE}, 'T04:05:06+03:00"}}</script></head>'))
  WHEN 2 THEN replace(html, '</head>', concat('<script type="application/ld+json">{{"@graph": [{{"x": 1}}, {{"dateCreated": "2024-01-', {_DAY_OF_PAGE}, 'T07:08:09"}}]}}</script></head>'))
  WHEN 3 THEN replace(html, '<article>', concat('<article><time datetime="2024-05-', {_DAY_OF_PAGE}, ' 07:08:00">now</time>'))
  WHEN 4 THEN replace(html, '<article>', concat('<article><time>', {_DAY_OF_PAGE}, '.06.2023 09:10</time>'))
  WHEN 5 THEN replace(html, '<article>', concat('<article><span class="x haber-tarih">', {_DAY_OF_PAGE}, ' Mart 2023</span>'))
  WHEN 6 THEN replace(replace(html, '<article>', concat('<article><time datetime="2024-05-', {_DAY_OF_PAGE}, ' 07:08:00">now</time>')), '</head>', concat('<meta name="publish-date" content="2024-07-', {_DAY_OF_PAGE}, '"></head>'))
  WHEN 7 THEN replace(replace(html, '<article>', concat('<article><time datetime="2024-05-', {_DAY_OF_PAGE}, ' 07:08:00">now</time>')), '</head>', concat('<meta property="og:release_date" content="2024/7/', page_id % 28 + 1, ' 01:02:03.5"></head>'))
  ELSE html END"""


@_query(f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN '2024-03-' || {_DAY_OF_PAGE} || ' 10:20:30' WHEN 1 THEN '2024-02-' || {_DAY_OF_PAGE} || ' 04:05:06' WHEN 2 THEN '2024-01-' || {_DAY_OF_PAGE} || ' 07:08:09'
WHEN 3 THEN '2024-05-' || {_DAY_OF_PAGE} || ' 07:08:00' WHEN 4 THEN '2023-06-' || {_DAY_OF_PAGE} || ' 09:10:00' WHEN 5 THEN '2023-03-' || {_DAY_OF_PAGE} || ' 12:00:00' WHEN 6 THEN '2024-05-' || {_DAY_OF_PAGE} || ' 07:08:00' WHEN 7 THEN '2024-07-' || {_DAY_OF_PAGE} || ' 01:02:03' END AS page_date FROM pages""")
def page_dates(spark, sf):
    """Publication dates of pages that give one in each of the ways that are searched, in their order of trust; a day
    without a time isn't a date of metadata."""
    return html.bodies(table(spark, sf, "pages").select("page_id", F.expr(_DATED.replace("AS VARCHAR", "AS STRING")).alias("html"))).select("page_id", "page_date")


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def daily_tumbling(spark, sf):
    return monitor.daily_counts(table(spark, sf, "events"))


@_query(sql.UPSERT)
def upsert_merge(spark, sf):
    a = articles(spark, sf)
    stored = upsert.prepared(a.withColumn("ord", F.col("id")).withColumn("ilgili_mi", F.when(F.col("id") % 2 == 0, 1).otherwise(0)), AS_OF, numbers=True).withColumn("id", F.col("ord")).drop("ord")
    items = a.select(F.col("id").alias("ord"), "source_name", "category", F.concat(F.lit("N "), F.col("source_name")).alias("title"), F.when(F.col("id") % 5 == 0, "").otherwise("new").alias("summary"), F.when(F.col("id") % 7 == 0, "").otherwise("2024-01-05 00:00:00").alias("publish_date"), F.when(F.col("id") % 3 == 0, F.concat("link", F.lit("/new"))).otherwise(F.col("link")).alias("link"), F.lit(1).alias("ilgili_mi"), F.lit(0.0).alias("guven_skoru"))
    return upsert.merged(stored, items, AS_OF).select("id", "title", "summary", "publish_date", "link", "ilgili_mi", "guven_skoru", "category")


@_query(f"{_NEWS}, v AS (SELECT id, id % 2 = 0 AS y FROM articles WHERE category = 'de') SELECT id, CASE WHEN y IS NULL THEN ilgili_mi ELSE CAST(y AS INTEGER) END AS ilgili_mi, CASE WHEN y IS NULL THEN relevance_status WHEN y THEN 'Stage 2 (LLM)' ELSE 'Genel (Filtresiz)' END AS relevance_status, CASE WHEN y IS NULL THEN guven_skoru ELSE 0.7 END AS guven_skoru FROM news LEFT JOIN v USING (id) WHERE id NOT IN (SELECT id FROM articles WHERE source_name = 'src9')")
def verdicts_and_deletes(spark, sf):
    n = _news(spark, sf)
    v = n.where("category = 'de'").select("id", (F.col("id") % 2 == 0).alias("relevant"), F.lit("Spor").alias("category"), F.lit(0.7).alias("confidence"), F.lit("r").alias("reason"))
    out = upsert.without_ids(upsert.with_verdicts(n, v), n.where("source_name = 'src9'").select("id"))
    return out.select("id", "ilgili_mi", "relevance_status", "guven_skoru")


@_query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value FROM events")
def json_extract(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), F.lit(0)).alias("first_value"))


_ANSWER = """CASE id % 6
  WHEN 0 THEN 'Thought {x} first.\n```json\n{"id": ' || id || '}\n```\nthen ```\n{"last": "' || source_name || '"}\n``` and {"no": 1}'
  WHEN 1 THEN '```json\n{broken ' || id || '}\n``` so {"a": {"b": ' || id || '}} it is'
  WHEN 2 THEN 'first {"n": 1} then {"n": ' || id || ', "s": {"t": [1, 2]}} and {not json}'
  WHEN 3 THEN 'only {broken {' || source_name || '} here'
  WHEN 4 THEN 'none at all ' || id
  ELSE '{"deep": {"er": {"id": ' || id || '}}}' END"""


@_query(f"SELECT id, {sql.json_object(f'({_ANSWER})')} AS object FROM articles")
def llm_json(spark, sf):
    return articles(spark, sf).withColumn("said", F.expr(_ANSWER)).select("id", text.json_object(F.col("said")).alias("object"))


_RAW_TITLE = "CASE id % 3 WHEN 0 THEN '14:24 - ' || title WHEN 1 THEN 'SON DAKİKA: ' || title ELSE title END"


_VARIED_TITLE = """CASE id % 9 WHEN 0 THEN '14:24 - ' || title WHEN 1 THEN 'SON DAKİKA: ' || title WHEN 2 THEN '9.05:33 CANLI | ' || title
  WHEN 3 THEN 'FLASH ' || title || ' &amp; &quot;' || source_name || '&quot;' WHEN 4 THEN 'ÖZEL HABER - 12:30 ' || title WHEN 5 THEN '  12:30 ' || title
  WHEN 6 THEN '12:30CANLI: ' || title || ' &lt;b&gt;&nbsp; ' WHEN 7 THEN '7:5 ' || title ELSE title END"""


@_query(f"SELECT id, {sql.cleaned(f'({_VARIED_TITLE})')} AS title FROM articles")
def title_clean(spark, sf):
    return articles(spark, sf).select("id", text.clean_leading_time(F.expr(_VARIED_TITLE)).alias("title"))


_AFFIXED = "CASE id % 5 WHEN 0 THEN 'Gündem ' || source_name || ' - Site' WHEN 1 THEN source_name || ' -  Site ' WHEN 2 THEN 'Gündem' || category || ' - ' || source_name WHEN 3 THEN ' ' || source_name || ' - Site - Site' ELSE source_name || ' Gündem' END"
_PHRASE = "source_name || ' haber & ' || coalesce(category, 'öz')"


@_query(f"""SELECT id, trim(regexp_replace(CASE WHEN starts_with(raw, 'Gündem') THEN trim(raw[7:]) ELSE raw END, '\\s+-\\s+Site\\s*$', '')) AS bare, trim(split_part(raw, ' - ', 1)) AS first_part, url_encode('"' || phrase || '"') AS query FROM (SELECT id, {_AFFIXED} AS raw, {_PHRASE} AS phrase FROM articles)""")
def title_affixes(spark, sf):
    raw = F.expr(_AFFIXED)
    return articles(spark, sf).select("id", text.without_affixes(raw, ("Gündem",), ("Site",)).alias("bare"), text.without_affixes(raw, first_part=True).alias("first_part"), text.query_encoded(F.expr(_PHRASE)).alias("query"))


_SAID_BRIEF = r"""CASE id % 8 WHEN 0 THEN '<think>hm ' || category || '</think>Özet: "' || title || '."' WHEN 1 THEN 'so <SUMMARY> ' || title || ' </summary> end'
  WHEN 2 THEN 'Drafting' || chr(10) || 'Attempt 1: ilk' || chr(10) || 'Attempt 2:* ' || title || chr(13) || chr(10) || 'done' WHEN 3 THEN '<summary>Analyze the Request ' || source_name || '</summary>'
  WHEN 4 THEN ' `' || title || '` ' || chr(10) WHEN 5 THEN 'xülasə:  ' || title || ' "x"' WHEN 6 THEN 'Internal Monologue' || chr(10) || '1. **Analyze** it' || chr(10) || '* **Role** r' || chr(10) || '```' || chr(10) || 'Attempt none' || chr(10) || '  ' || title || chr(10) || 'and more'
  ELSE '<thinking>a</thinking>' || chr(10) || summary END"""


@_query(f"SELECT id, {sql.brief(f'({_SAID_BRIEF})')} AS brief FROM articles")
def llm_brief(spark, sf):
    return articles(spark, sf).select("id", text.clean_brief(F.expr(_SAID_BRIEF)).alias("brief"))


@_query(f"{_NEWS} SELECT id, CASE WHEN length(trim(summary, ' ')) < 60 OR suffix(trim(summary, ' '), '...') OR suffix(trim(summary, ' '), '…') THEN title ELSE summary END AS content FROM news WHERE ilgili_mi = 1")
def brief_texts(spark, sf):
    return classify.briefs(_news(spark, sf)).select("id", "content")


@_query(f"{_NEWS} SELECT n.id, CASE WHEN s.is_candidate THEN CAST(n.id % 2 = 0 AS INTEGER) ELSE n.ilgili_mi END AS ilgili_mi, CASE WHEN s.is_candidate AND n.id % 2 = 0 THEN 'Stage 2 (LLM)' WHEN s.is_candidate THEN 'Genel (Filtresiz)' ELSE n.relevance_status END AS relevance_status, CASE WHEN s.is_candidate AND n.id % 2 = 0 THEN 1.0::DOUBLE WHEN s.is_candidate THEN 0.0::DOUBLE ELSE n.guven_skoru END AS guven_skoru FROM news n JOIN stage1 s USING (id)")
def second_stage(spark, sf):
    judged = classify.labelled(classify.with_stage1(articles(spark, sf), LEXICON))
    verdicts = lambda c: c.select("id", (F.col("id") % 2 == 0).alias("relevant"), F.lit("Enerji").alias("category"), F.lit(None).cast("double").alias("confidence"), F.lit("offline").alias("reason"))
    return classify.with_stage2(judged, verdicts).select("id", "ilgili_mi", "relevance_status", "guven_skoru")


@_query(f"{_NEWS} SELECT (SELECT count(*) FROM articles) AS fetched, count(*) AS saved, count(*) FILTER (ilgili_mi = 1) AS relevant, 204.0::DOUBLE AS duration_seconds FROM news WHERE source_name <> 'src3'")
def run_metrics(spark, sf):
    """Counted while the saved rows are written."""
    saved = lambda a: classify.labelled(classify.with_stage1(a, LEXICON)).drop("stage1").where("source_name <> 'src3'")
    return report.observed_run(articles(spark, sf), saved, lambda rows: rows.write.parquet(stages.folder(spark, "run")), AS_OF, "2024-01-03 12:03:24")


@_query(f", t AS (SELECT id, source_name, {_RAW_TITLE} AS raw, CASE WHEN id % 7 = 0 THEN 'BISTECH KAP' ELSE title END AS notice, title FROM articles) SELECT id, id % 3 <> 2 OR source_name ILIKE '%src1' OR title <> trim(regexp_replace(title, '[\\s\\x{{a0}}]+', ' ', 'g'), ' ') AS dirty, id % 7 = 0 AS promo FROM t")
def title_hygiene(spark, sf):
    a = articles(spark, sf).withColumn("notice", F.when(F.col("id") % 7 == 0, "BISTECH KAP").otherwise(F.col("title"))).withColumn("title", F.expr(_RAW_TITLE))
    dirty = filters.dirty_rows(a, ("%src1",)).select(F.col("id").alias("_d"), F.lit(True).alias("_y"))
    return a.join(dirty, a.id == F.col("_d"), "left").select("id", F.coalesce("_y", F.lit(False)).alias("dirty"), filters.is_promo("notice").alias("promo"))


@_query(", c(source_name, most) AS (VALUES ('src1', 3), ('src2', 0), ('src4', 60)) SELECT id, source_name FROM articles LEFT JOIN c USING (source_name) QUALIFY most IS NULL OR row_number() OVER (PARTITION BY source_name ORDER BY id) <= most")
def source_caps(spark, sf):
    caps = spark.createDataFrame([("src1", 3), ("src2", 0), ("src4", 60)], "source_name string, most int")
    return feeds.capped(articles(spark, sf).withColumn("ord", F.col("id")), caps).select("id", "source_name")


_NAMES = [x for _, name, *_ in configured.SOURCES for x in (name, f"Yeni {name} Online", name[: len(name) // 2])] + ["zzz"]
_DEFAULT_SOURCES = ", ".join(f"({i}, {sql.text(name)}, {sql.text(category)})" for i, (_, name, category, *_) in enumerate(configured.SOURCES))


@_query(f", s(ord, name, cat) AS (VALUES {_DEFAULT_SOURCES}), r AS (SELECT id, {sql.texts(_NAMES)}[id % {len(_NAMES)} + 1] AS raw FROM articles), l AS (SELECT id, raw, replace(lower(replace(raw, 'İ', '#')), '#', 'i̇') AS low FROM r), m AS (SELECT id, arg_min(name, ord) AS name, arg_min(cat, ord) AS cat FROM l JOIN (SELECT *, replace(lower(replace(name, 'İ', '#')), '#', 'i̇') AS ln FROM s) ON contains(low, ln) OR contains(ln, low) GROUP BY id) SELECT id, coalesce(name, raw) AS source_name, coalesce(cat, 'Diğer / Sınıflandırılmamış') AS category FROM r LEFT JOIN m USING (id)")
def configured_sources(spark, sf):
    """Names as search results give them, matched with the sources that are read by default."""
    raw = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("id") % len(_NAMES) + 1).cast("int"))
    rows = articles(spark, sf).select("id", F.trim(raw).alias("raw_source"))
    return lookup.with_source(rows, configured.sources(spark)).select("id", "source_name", "category")


_READ = [name for name, *_ in configured.READINGS] + ["unread"]
_READING_ROWS = ", ".join("(" + ", ".join("NULL::INT" if v is None else str(v) if isinstance(v, int) else sql.text(v) for v in r) + ")" for r in configured.READINGS)


@_query(f""", r(source_name, policy, most_of_feed, most_of_page, most, most_instead) AS (VALUES {_READING_ROWS}),
a AS (SELECT id AS ord, {sql.texts(_READ)}[id % {len(_READ)} + 1] AS source_name FROM articles),
f AS (SELECT ord, source_name, most, policy FROM a LEFT JOIN r USING (source_name) WHERE ord % 22 NOT IN (0, 2, 5, 9, 15, 16) QUALIFY most_of_feed IS NULL OR row_number() OVER (PARTITION BY source_name, ord % 3 ORDER BY ord) <= most_of_feed),
c AS (SELECT ord + 1000000 AS ord, source_name, policy, CASE policy WHEN 'both' THEN most ELSE most_instead END AS most FROM a JOIN r USING (source_name) QUALIFY most_of_page IS NULL OR row_number() OVER (PARTITION BY source_name, ord % 2 ORDER BY ord) <= most_of_page),
u AS (SELECT ord, source_name, most, 0 AS kind FROM f UNION ALL SELECT ord, source_name, most, 1 FROM c WHERE policy = 'both' OR policy = 'fallback' AND source_name NOT IN (SELECT source_name FROM f))
SELECT ord, source_name FROM u QUALIFY most IS NULL OR row_number() OVER (PARTITION BY source_name ORDER BY kind, ord) <= most""")
def source_readings(spark, sf):
    """Each default source by its reading; some of them have an empty feed."""
    name = F.element_at(F.array(*map(F.lit, _READ)), (F.col("id") % len(_READ) + 1).cast("int"))
    a = articles(spark, sf).select(F.col("id").alias("ord"), name.alias("source_name"))
    feed = a.where(~(F.col("ord") % 22).isin(0, 2, 5, 9, 15, 16)).withColumn("place", F.col("ord") % 3)
    cards = a.withColumn("place", F.col("ord") % 2).withColumn("ord", F.col("ord") + 1000000)
    return configured.gathered(feed, cards, configured.readings(spark)).select("ord", "source_name")


_OUTLET_ROWS = ", ".join(f"({i}, {sql.text(f'{name} ({city})')})" for i, (_, _, name, _, city) in enumerate(configured.OUTLETS))


@_query(f""", o(n, source_name) AS (VALUES {_OUTLET_ROWS}), a AS (SELECT id AS ord, o.source_name, title, CASE WHEN id % 41 = 0 THEN '' WHEN id % 43 = 0 THEN '/x/' || id ELSE 'http://x/' || (id % 997) END AS link FROM articles JOIN o ON id % {len(configured.OUTLETS)} = n),
f AS (SELECT ord, source_name, trim(split_part(title || ' - Outlet - x', ' - ', 1)) AS title, link, 'RSS' AS veri_kaynagi, 0 AS kind FROM a WHERE source_name <> 'Kars Manşet (Kars)' QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY ord) <= 25),
c AS (SELECT ord, source_name, title, link, 'Scraping' AS veri_kaynagi, 1 AS kind FROM (SELECT ord, source_name, CASE WHEN ord % 5 = 0 THEN title || ' VIDEO' WHEN ord % 7 = 3 THEN title[1:19] ELSE title END AS title, link FROM a) WHERE length(title) >= 20 AND link LIKE 'http%' AND NOT regexp_matches(lower(title), 'foto galeri|video|reklam|resmi ilandır|nöbetçi|vefat|künye')),
u AS (SELECT * FROM f WHERE link <> '' UNION ALL SELECT * FROM c), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY source_name, link ORDER BY kind, ord) = 1)
SELECT ord, source_name, title, veri_kaynagi FROM d QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY kind, ord) <= 30""")
def outlet_news(spark, sf):
    """Feeds and front pages of all local outlets."""
    name = F.element_at(F.array(*(F.lit(f"{name} ({city})") for _, _, name, _, city in configured.OUTLETS)), (F.col("id") % len(configured.OUTLETS) + 1).cast("int"))
    link = F.when(F.col("id") % 41 == 0, "").when(F.col("id") % 43 == 0, F.concat(F.lit("/x/"), "id")).otherwise(F.concat(F.lit("http://x/"), F.col("id") % 997))
    a = articles(spark, sf).select(F.col("id").alias("ord"), name.alias("source_name"), "title", link.alias("link"))
    feed = a.where("source_name <> 'Kars Manşet (Kars)'").withColumn("title", F.concat("title", F.lit(" - Outlet - x")))
    links = a.withColumn("title", F.when(F.col("ord") % 5 == 0, F.concat("title", F.lit(" VIDEO"))).when(F.col("ord") % 7 == 3, F.substring("title", 1, 19)).otherwise(F.col("title")))
    return configured.outlet_items(feed, links).select("ord", "source_name", "title", "veri_kaynagi")


_SAVED = ", ".join(f"({i}, {sql.text(q)}, {sql.text(label)}, {sql.text(next(s for g, s, _ in configured.GROUPS if g == group))}, {sql.text(next(u for g, _, u in configured.GROUPS if g == group))})" for i, (group, q, label) in enumerate(configured.SAVED_QUERIES))


@_query(f", q(n, query, label, source_id, unnamed) AS (VALUES {_SAVED}), a AS (SELECT id AS ord, q.*, CASE WHEN id % 3 = 0 THEN title ELSE title || ' - ' || source_name || ' - x' END AS title FROM articles JOIN q ON id % {len(configured.SAVED_QUERIES)} = n QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) <= 20) SELECT ord, source_id, trim(split_part(title, ' - ', 1)) AS title, CASE WHEN contains(title, ' - ') THEN trim(split_part(title, ' - ', 2)) ELSE unnamed || ' (' || label || ')' END || ' (' || label || ')' AS source_name FROM a")
def saved_query_news(spark, sf):
    queries = F.array(*(F.lit(q) for _, q, _ in configured.SAVED_QUERIES))
    title = F.when(F.col("id") % 3 == 0, F.col("title")).otherwise(F.concat("title", F.lit(" - "), "source_name", F.lit(" - x")))
    feed = articles(spark, sf).select(F.col("id").alias("ord"), title.alias("title"), F.element_at(queries, (F.col("id") % len(configured.SAVED_QUERIES) + 1).cast("int")).alias("query"))
    return configured.query_items(feed, configured.saved_queries(spark)).select("ord", "source_id", "title", "source_name")


_FRESH_NEAR = "len(x.w) >= 3 AND len(k.w) > 0 AND (" + sql.jaccard("k.w", "x.w") + " >= 0.65 OR " + sql.contained("k.w", "x.w") + ")"
_MIDNIGHT = f"{AS_OF[:10]} 00:00:00"


@_query(f""", old AS (SELECT *, {sql.cleaned('title')} AS bare FROM articles WHERE publish_date < '{_MIDNIGHT}'),
today AS (SELECT id, source_name, category, {sql.cleaned('title')} AS title, summary, least(publish_date, '{AS_OF}') AS publish_date, link FROM articles WHERE publish_date >= '{_MIDNIGHT}'),
fit AS (SELECT *, {sql.title_key('title', False)} AS k FROM today WHERE NOT {sql.is_junk('title')} AND link NOT IN (SELECT link FROM old)),
fresh AS (SELECT * FROM fit QUALIFY k = '' OR row_number() OVER (PARTITION BY source_name, publish_date[1:10], k ORDER BY id) = 1),
{sql.fold('fresh', 'source_name, publish_date[1:10]', _FRESH_NEAR, 'false')}, found_today AS (SELECT * FROM fresh WHERE id IN (SELECT id FROM folded)),
{_STAGE1.replace('FROM articles', 'FROM found_today')}
SELECT id, source_name, bare AS title, publish_date, link, CAST(0 AS INTEGER) AS ilgili_mi, 'İlgisiz' AS ilgi_kategorisi FROM old
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY id), source_name, {sql.cleaned('title')}, publish_date, link, CAST(aspect IS NOT NULL AS INTEGER), coalesce(aspect, 'İlgisiz') FROM stage1""")
def ingest_cycle(spark, sf):
    """All articles as they would arrive on the last day, onto those of the days before."""
    a = articles(spark, sf)
    stored = upsert.prepared(a.where("publish_date < '2024-01-03 00:00:00'").withColumn("ord", F.col("id")), AS_OF).withColumn("id", F.col("ord")).drop("ord")
    items = a.select(F.col("id").alias("ord"), F.lit("").alias("source_id"), "source_name", "category", "title", "summary", F.lit("").alias("author"), "publish_date", "link", F.lit(None).cast("string").alias("scraped_at"), F.lit(None).cast("string").alias("veri_kaynagi"))
    return ingest.ingest(items, stored, LEXICON, _sources(spark), AS_OF).select("id", "source_name", "title", "publish_date", "link", "ilgili_mi", "ilgi_kategorisi")


def _stored(a: DataFrame, relevant=None) -> DataFrame:
    """articles as they are stored, with their ids."""
    rows = a.withColumn("ord", F.col("id"))
    rows = rows if relevant is None else rows.withColumn("ilgili_mi", relevant)
    return upsert.prepared(rows, AS_OF, numbers=True).withColumn("id", F.col("ord")).drop("ord")


def _in_thirds(rows: DataFrame, order: str) -> list[DataFrame]:
    """rows as they arrive in three landings, by an order."""
    top = rows.agg(F.max(order)).first()[0] or 0
    part = F.floor(F.col(order) * 3 / (top + 1))
    return [rows.where(part == k) for k in range(3)]


def _upserted(a: DataFrame) -> DataFrame:
    link = F.when(F.col("id") % 3 == 0, F.concat("link", F.lit("/new"))).otherwise(F.col("link"))
    return a.select(F.col("id").alias("ord"), "source_name", "category", F.concat(F.lit("N "), F.col("source_name")).alias("title"), F.when(F.col("id") % 5 == 0, "").otherwise("new").alias("summary"), F.when(F.col("id") % 7 == 0, "").otherwise("2024-01-05 00:00:00").alias("publish_date"), link.alias("link"), F.lit(1).alias("ilgili_mi"))


@_query(sql.UPSERT)
def upsert_cycles(spark, sf):
    """What upsert_merge upserts at once, landed in three parts and kept by a stream's cycles in a table of versions; the
    second batch comes twice."""
    a, top = articles(spark, sf), stages.folder(spark, "upsert-cycles")
    news = NewsTable(spark, f"{top}/news")
    news.insert(_stored(a, F.when(F.col("id") % 2 == 0, 1).otherwise(0)))
    for k, part in enumerate(_in_thirds(_upserted(a), "ord")):
        part.write.mode("append").parquet(f"{top}/landing")
        landed = monitor.landed(spark, f"{top}/landing", part.schema, 1 << 20)
        monitor.kept_cycle(landed, news, lambda batch, _: batch, lambda _: AS_OF, f"{top}/checkpoint", "cycle").awaitTermination()
        if k == 1:
            news.upsert(part, AS_OF, "cycle", 1)
    return news.read().select("id", "title", "summary", "publish_date", "link", "ilgili_mi", "guven_skoru", "category")


def _kept_news(spark: SparkSession, sf: str, name: str) -> NewsTable:
    """The labelled articles as a stored table."""
    news = NewsTable(spark, stages.folder(spark, name))
    news.insert(migrated(_news(spark, sf)))
    return news


@_query(_SQL["daily_summary"].split(ARTICLES_SQL, 1)[1])
def stored_daily_summary(spark, sf):
    """As daily_summary, of a stored table: the filter on the day's partition leaves all other days unread."""
    return report.daily_summary(_kept_news(spark, sf, "stored-day").read().where(F.col("publish_day") == DAY), DAY, {"english": "en", "german": "de"})


@_query(f"{_NEWS}, r AS (SELECT id, row_number() OVER (ORDER BY publish_date DESC, id DESC) AS n FROM news WHERE ilgili_mi = 1) SELECT id, CAST((n - 1) // 25 AS INTEGER) AS page FROM r WHERE n <= 100")
def stored_pages(spark, sf):
    """Four pages of relevant news of a stored table, each sought from the last row of the one before."""
    news, after, pages = _kept_news(spark, sf, "stored-pages"), None, []
    for k in range(4):
        page = news.page(25, after, F.col("ilgili_mi") == 1).select("id", "publish_date")
        last = page.orderBy("publish_date", "id").first()
        if last is None:
            break
        after = (last.publish_date, last.id)
        pages.append(page.select("id", F.lit(k).alias("page")))
    return reduce(DataFrame.unionByName, pages) if pages else spark.createDataFrame([], "id long, page int")


#: What feeds say of an article: fields under each of their names, dates in each form, links with what trackers add.
_FEED = {
    "title": "CASE WHEN id % 4 = 0 THEN plain || ' - Site' WHEN id % 9 = 5 THEN 'Foto Galeri ' || plain WHEN id % 13 = 6 THEN 'kurz' ELSE plain END",
    "link": "'https://WWW.' || source_name || '.example.com/haber/' || id || CASE WHEN id % 3 = 0 THEN '/?utm_source=x&page=' || id ELSE '' END",
    "date": "CASE id % 4 WHEN 0 THEN publish_date WHEN 1 THEN replace(publish_date, ' ', 'T') || '.250Z' WHEN 2 THEN substr(publish_date, 9, 2) || '.' || substr(publish_date, 6, 2) || '.' || substr(publish_date, 1, 4) || ' ' || substr(publish_date, 12, 5) ELSE 'Tue, ' || substr(publish_date, 9, 2) || ' Jan 2024 ' || substr(publish_date, 12) || ' +0000' END",
}
_FEED_HEAD = '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
_PLAIN = r"'Haber ' || id || ' über ' || source_name || ' und ' || category"


@_query(f""", p AS (SELECT *, {_PLAIN} AS plain FROM articles), f AS (SELECT *, {_FEED['title']} AS t, row_number() OVER (PARTITION BY source_name ORDER BY id) AS turn FROM p),
c AS (SELECT id, source_name, plain, publish_date, CASE WHEN id % 4 = 0 THEN plain ELSE t END AS title FROM f WHERE turn <= 40)
SELECT title, CASE WHEN id % 5 = 0 THEN '' ELSE 'Über ' || id || ' & mehr' END AS summary, CASE WHEN id % 2 = 0 THEN 'A ' || id ELSE '' END AS author, publish_date[1:CASE WHEN id % 4 = 2 THEN 16 ELSE 19 END] || CASE WHEN id % 4 = 2 THEN ':00' ELSE '' END AS publish_date,
'https://www.' || source_name || '.example.com/haber/' || id || CASE WHEN id % 3 = 0 THEN '?page=' || id ELSE '' END AS link FROM c WHERE NOT {sql.is_junk('title')}""")
def feed_files(spark, sf):
    """Articles written as RSS files, and of a third of the sources as Atom files, and read as feeds."""
    a = articles(spark, sf).withColumn("plain", F.expr(_PLAIN)).withColumns({k: F.expr(v) for k, v in _FEED.items()})
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name.split(' ')[0]}>"))
    pick = lambda n, *cases: reduce(lambda out, kc: F.when(F.col("id") % n == kc[0], kc[1]).otherwise(out), list(enumerate(cases))[::-1], F.lit(""))
    said = F.concat(F.lit("Über "), F.col("id").cast("string"), F.lit(" & mehr"))
    text = F.when(F.col("id") % 5 == 0, "").otherwise(pick(3, tag("description", esc(said)), tag("summary", F.concat(F.lit("<![CDATA[<b>"), said, F.lit("</b>]]>"))), tag("content:encoded", esc(F.concat(F.lit("<p>"), said, F.lit("</p>"))))))
    author = F.when(F.col("id") % 2 == 0, pick(4, tag("author", F.concat(F.lit("A "), "id")), F.lit(""), tag("dc:creator", F.concat(F.lit("A "), "id")))).otherwise("")
    date = pick(4, tag("pubDate", F.col("date")), tag("published", F.col("date")), tag("dc:date", F.col("date")), tag("updated", F.col("date")))
    atom = F.pmod(F.xxhash64("source_name"), F.lit(3)) == 0
    link = F.when(atom & (F.col("id") % 2 == 0), F.concat(F.lit('<link href="'), esc(F.col("link")), F.lit('"/>'))).otherwise(tag("link", esc(F.col("link"))))
    body = F.concat(tag("title", esc(F.col("title"))), link, text, author, date)
    entry = F.when(atom, tag("entry", body)).otherwise(tag("item", body))
    top = stages.folder(spark, "feeds")
    lines = a.select(F.col("source_name").alias("feed"), F.lit(1).alias("part"), "id", entry.alias("value"))
    ends = F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit(_FEED_HEAD).alias("value")), F.struct(F.lit(2).alias("part"), F.lit("</channel></rss>").alias("value"))))
    whole = lines.unionByName(lines.select("feed").distinct().select("feed", F.lit(0).cast("long").alias("id"), ends))
    whole.repartition("feed").sortWithinPartitions("feed", "part", "id").select("feed", "value").write.partitionBy("feed").text(top)
    return feeds.feed_items(spark, top, AS_OF, most=40).select("title", "summary", "author", "publish_date", "link")


@_query(", " + sql.fold("articles", "source_name, publish_date[1:10]", _FRESH_NEAR, "false") + " SELECT id FROM folded")
def headline_stream(spark, sf):
    """The ingest rule over a stream of articles in three landings, with state by source and day."""
    top = stages.folder(spark, "headline-stream")
    for part in _in_thirds(articles(spark, sf).select(F.col("id").alias("ord"), "source_name", "title", "publish_date"), "ord"):
        part.write.mode("append").parquet(f"{top}/landing")
        kept = monitor.new_headlines(monitor.landed(spark, f"{top}/landing", part.schema, 1 << 20), late="5 days")
        kept.writeStream.format("parquet").option("path", f"{top}/kept").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("ord long").parquet(f"{top}/kept").select(F.col("ord").alias("id"))


@_query(f"{_NEWS}, day AS (SELECT * FROM news WHERE publish_date BETWEEN '{DAY} 00:00:00' AND '{DAY} 23:59:59'), {sql.keyed('day')}, r AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY source_name, k ORDER BY publish_date DESC, id DESC) = 1), c AS (SELECT source_name, lower(trim(source_name)) AS s, count(*) AS n FROM r GROUP BY 1), o AS (SELECT source_name, row_number() OVER (ORDER BY n DESC, source_name) AS g FROM c WHERE n >= 10), p(ord, pattern, cat) AS (VALUES {_PATTERN_ROWS}), m AS (SELECT source_name, arg_min(cat, (CASE WHEN s = pattern THEN 0 ELSE 1 END, ord)) AS cat FROM c JOIN p ON s = pattern OR contains(s, pattern) OR contains(pattern, s) GROUP BY 1) SELECT id, source_name, coalesce(cat, CASE WHEN coalesce(category, '') IN ('', {sql.text(lookup.OTHER)}) THEN {sql.text(lookup.OTHER)} ELSE category END) AS category, g IS NULL AS is_other, CAST(coalesce(g, (SELECT coalesce(max(g), 0) + 1 FROM o)) AS INTEGER) AS group_rank FROM r LEFT JOIN o USING (source_name) LEFT JOIN m USING (source_name)")
def dashboard_day(spark, sf):
    return ingest.dashboard(_news(spark, sf), DAY).select("id", "source_name", "category", "is_other", "group_rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
