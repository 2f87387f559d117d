"""Classification, dedup, upsert, sources and reports on small tables."""

import gc
import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions.lexicon import Lexicon, java, re2
from quillstream.operators import classify, dedup, filters, lookup, report, upsert
from quillstream.plans import ingest
from quillstream.schema import NEWS, migrated
from quillstream.sources import feeds, html

AS_OF = "2026-09-01 12:00:00"
LEXICON = Lexicon(
    keywords=("azerbaycan", "bakı", "barda", "karabağ", "kazakistan", "türk devletleri teşkilatı", "btc", "hazar denizi", "kırgızistan"),
    countries={"Azerbaycan": ("azerbaycan", "karabağ", "bakı", "barda"), "KKTC": ("kktc",), "Kazakistan": ("kazakistan",), "Kırgızistan": ("kırgızistan",)},
    topics={"Ermenistan Hattı": ("ermenistan",), "Sınır Hattı & Bölgesel Diplomasi": ("dilucu",), "Spor": ("maç",), "Güvenlik/Savunma": ("ordu", "ordusu", "tatbikat")},
    flagging=("Ermenistan Hattı", "Sınır Hattı & Bölgesel Diplomasi"),
    union=("türk devletleri teşkilatı",),
)
CASES = [
    ("Azerbaycan ordusu ortak tatbikat düzenledi", "", (True, False, "Azerbaycan, Güvenlik/Savunma")),
    ("Azerbaycan ile Kazakistan arasında anlaşma", None, (True, False, "Azerbaycan, Kazakistan")),
    ("Türk Devletleri Teşkilatı zirvesi başladı", "", (True, False, LEXICON.union_label)),
    ("İzmir Karabağlar ilçesinde yangın çıktı", "", (False, False, None)),
    ("BTC fiyatı yükseldi bugün", "", (False, True, None)),
    ("Genç barda kavga etti", "", (False, False, None)),
    ("Barda şehri", "", (True, False, "Azerbaycan, Diplomasi & Siyaset")),
    ("Hazar Denizi seviyesi düşüyor", "", (False, False, None)),
    ("KIRGIZİSTAN'da seçim", "", (True, False, "Kırgızistan")),
    ("boş", "x" * 360 + " azerbaycan", (False, False, None)),
    (None, None, (False, False, None)),
]


def test_stage1(spark):
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "id int, title string, summary string")
    got = [r.stage1 for r in classify.with_stage1(rows, LEXICON).orderBy("id").collect()]
    assert [(s.is_relevant, s.is_candidate, s.aspect) for s in got] == [c[2] for c in CASES]
    assert got[0].matched == ["azerbaycan"] and got[4].explanation.endswith(": btc")


def test_patterns_are_whole_words_in_any_case(spark):
    for word, given, expected in (("kırgızistan", "KIRGIZİSTAN'da", True), ("karabağ", "éKarabağ", False), ("karabağ", "karabağlı", False), ("bakı", "bakı", False), ("bakı", "Bakı", True)):
        assert spark.createDataFrame([(given,)], "x string").select(F.col("x").rlike(java(word))).first()[0] is expected
        duckdb = pytest.importorskip("duckdb")
        assert duckdb.connect().execute("select regexp_matches(?, ?)", [given, re2(word)]).fetchone()[0] is expected


def test_masks_end_where_their_own_words_do(spark):
    """Without the flag U, \\w is ASCII's, and so is \\b on any Java, as in SQL; with it, both are Unicode's."""
    rows = spark.createDataFrame([("des les elleévi çoivi",), ("les elles",), ("éles elle.",)], "t string")
    got = lambda m: [r[0] for r in rows.select(classify.masked(F.col("t"), (m,))).collect()]
    sql = lambda m: [pytest.importorskip("duckdb").connect().execute("select regexp_replace(?, ?, ' ', 'g')", [r.t, m]).fetchone()[0] for r in rows.collect()]
    plain = r"(?i)\bles\s+elle\b"
    assert got(plain) == ["des  évi çoivi", "les elles", "é ."] == sql(plain)
    assert got(r"(?iuU)\bles\s+elle\b") == [r.t for r in rows.collect()]


def test_second_stage(spark):
    rows = spark.createDataFrame([(1, "BTC yükseldi", ""), (2, "BTC düştü", ""), (3, "Azerbaycan", "")], "id int, title string, summary string")
    judged = classify.labelled(classify.with_stage1(rows, LEXICON))
    verdicts = lambda c: c.select("id", (F.col("id") == 1).alias("relevant"), F.lit("Enerji").alias("category"), F.lit(None).cast("double").alias("confidence"), F.lit("why").alias("reason"))
    got = {r.id: r for r in classify.with_stage2(judged, verdicts).collect()}
    assert (got[1].ilgili_mi, got[1].ilgi_kategorisi, got[1].guven_skoru, got[1].relevance_status) == (1, "Enerji", 1.0, "Stage 2 (LLM)")
    assert (got[2].ilgili_mi, got[2].ilgi_kategorisi, got[2].guven_skoru) == (0, "İlgisiz", 0.0) and got[3].guven_skoru == 0.95
    assert classify.with_stage2(judged).count() == 3


def test_categories_and_sources(spark):
    rows = spark.createDataFrame([("AA", "x"), ("NTV Haber Merkezi", "x"), ("", "x"), ("Bilinmez", "Muhalif"), ("Bilinmez", None), ("Star TV", "x")], "source_name string, category string")
    got = [r.resolved for r in lookup.with_category(rows.withColumn("i", F.monotonically_increasing_id())).orderBy("i").collect()]
    assert got == ["Resmi / Ana Akım", "Resmi / Ana Akım", "Resmi / Ana Akım", "Muhalif", lookup.OTHER, "İktidar Yanlısı"]
    sources = spark.createDataFrame([(0, "NTV", "A", "rss"), (1, "Sözcü", "B", "scraping")], "ord int, name string, category string, type string")
    raw = spark.createDataFrame([("NTV Spor",), ("söz",), (None,), ("Other",)], "raw_source string")
    assert {(r.raw_source, r.source_name) for r in lookup.with_source(raw, sources).collect()} == {("NTV Spor", "NTV"), ("söz", "Sözcü"), (None, "NTV"), ("Other", "Other")}
    assert {r.source_name: r.veri_kaynagi for r in lookup.with_provenance(spark.createDataFrame([("NTV",), ("Sözcü",), ("x",)], "source_name string"), sources).collect()} == {"NTV": "RSS", "Sözcü": "Scraping", "x": "Scraping"}


# -- folds


def spec(rows, rule, near=None):
    """The fold of one group, plainly: rows (id, words, relevant, aggregator, size, ts) in order."""
    kept = []
    for r in rows:
        hit = None
        if r["words"] or rule.keep != "first":
            for k in kept if len(r["words"]) >= rule.fewest else ():
                a, b = r["words"], k["words"]
                if not a or not b:
                    continue
                s = len(a & b) / len(a | b)
                if s >= rule.similar or (rule.soon and s >= rule.soon and abs(r["ts"] - k["ts"]) <= 60 * rule.minutes) or ((a <= b or b <= a) and min(len(a), len(b)) >= rule.subset):
                    hit = k
                    break
        if hit is None:
            kept.append(r)
            continue
        longer = r["size"] > hit["size"] and r["relevant"] == hit["relevant"]
        if rule.keep == "direct" and (hit["aggregator"] and not r["aggregator"] or hit["relevant"] == 0 and r["relevant"] == 1 or longer and not r["aggregator"]) or rule.keep == "relevant" and (hit["relevant"] == 0 and r["relevant"] == 1 or longer):
            kept.remove(hit)
            kept.append(r)
    return {k["id"] for k in kept}


@pytest.mark.parametrize("rule", [dedup.INGEST, dedup.HISTORY, dedup.ONE_DAY])
def test_folds_by_their_plain_form(spark, rule):
    r = random.Random(rule.similar)
    pool = [f"kelime{i}" for i in range(14)]
    rows = []
    for i in range(600):
        words = [r.choice(pool) for _ in range(r.randint(0, 7))]
        rows.append((i, f"s{i % 5}", " ".join(words), f"2026-09-01 {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00", f"https://{'news.google.com' if r.random() < 0.4 else 'x'}/{i}", r.randint(0, 1)))
    news = spark.createDataFrame(rows, "id long, source_name string, title string, publish_date string, link string, ilgili_mi int")
    got = {x.id for x in dedup.near_survivors(news, rule).collect()}
    again = {x.id for x in dedup.near_survivors(news.repartition(7), rule).collect()}
    expected = set()
    for s in range(5):
        group = [{"id": i, "words": set(t.split()), "relevant": rel, "aggregator": "google" in link, "size": len(t), "ts": int(d[11:13]) * 3600 + int(d[14:16]) * 60} for i, n, t, d, link, rel in rows if n == f"s{s}"]
        expected |= spec(group, rule)
    assert got == again == expected
    if rule is dedup.INGEST:
        assert {x.id for x in dedup.near_survivors_in_sql(news).collect()} == expected
        assert {x.id for x in dedup.near_survivors(news.where(F.col("id").isin(list(got))), rule).collect()} == got


def test_exact_dedup(spark):
    rows = [(1, "a", "Başlık bir", "https://news.google.com/1", "2026-09-01 10:00:00", 0, "s"), (2, "a", "10:20 Başlık bir - Sözcü", "https://d/2", "2026-09-01 11:00:00", 0, "ss"), (3, "a", "Başlık Bir!", "https://news.google.com/3", "2026-09-01 12:00:00", 1, ""), (4, "a", "!!", "l", None, 0, None), (5, "a", None, "l", None, 0, None), (6, "b", "Başlık bir", "x", "2026-09-02 10:00:00", 0, None)]
    news = spark.createDataFrame(rows, "id long, source_name string, title string, link string, publish_date string, ilgili_mi int, summary string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(dedup.for_reading(news)) == [3, 5, 6]
    assert ids(dedup.best_of_stories(news)) == [3, 5, 6]
    assert ids(dedup.sequential_survivors(news)) == [3, 4, 6]
    assert {r.id: r.link for r in dedup.on_storing(news).collect()} == {1: "https://d/2", 4: "l", 5: "l", 6: "x"}
    assert dedup.surplus(news).first().duplicates == 3


# -- storing


STORED = [
    (1, "s", "n", "c", "Old", "x" * 60, "au", "2026-08-31 00:00:00", "l1", "", "", "", 0, "", "", "t", "RSS", 1, "k", 0.9, "g"),
    (2, "s", "n", "c", "Old", "x" * 60 + "...", "au", "2026-08-31 00:00:00", "l2", "", "", "", 0, "", "", "t", "RSS", 1, "k", 0.9, "g"),
    (3, "s", "n", "c", "Old", "x" * 59, "au", "2026-08-31 00:00:00", "l3", "", "", "", 0, "", "", "t", "RSS", 0, "k", 0.9, "g"),
    (9, "s", "n", "c", "Old", "keep", "au", "2026-08-31 00:00:00", "l9", "", "", "", 0, "", "", "t", "RSS", 0, "k", 0.9, "g"),
]


def stored(spark):
    return spark.createDataFrame(STORED, NEWS)


def test_upsert(spark):
    items = spark.createDataFrame([(1, "l1", "14:20 New", "new", 1, 0.0), (2, "l2", "New", "new", 0, None), (3, "l3", "New", "", 1, 0.5), (4, "l7", "First", "", 0, None), (5, "l7", "Second", "two", 1, None), (6, "l5", "Five", "five", 0, None)], "ord long, link string, title string, summary string, ilgili_mi int, guven_skoru double")
    got = {r.link: r for r in upsert.merged(stored(spark), items, AS_OF).collect()}
    assert len(got) == 6 and got["l9"].title == "Old"
    assert (got["l1"].title, got["l1"].summary, got["l1"].id, got["l1"].guven_skoru) == ("New", "x" * 60, 1, 1.0)
    assert (got["l2"].summary, got["l2"].ilgili_mi, got["l2"].category, got["l2"].publish_date) == ("new", 0, "c", AS_OF)
    assert (got["l3"].summary, got["l3"].author, got["l3"].guven_skoru) == ("x" * 59, "", 0.5)
    assert (got["l7"].title, got["l7"].summary, got["l7"].ilgili_mi, got["l7"].id, got["l5"].id) == ("Second", "two", 1, 10, 11)
    again = {r.link: r for r in upsert.merged(upsert.merged(stored(spark), items, AS_OF), items, AS_OF).collect()}
    assert again == got


def test_updates_deletes_and_versions(spark, tmp_path):
    news = stored(spark)
    v = spark.createDataFrame([(2, True, "Spor", 0.7, "r")], "id long, relevant boolean, category string, confidence double, reason string")
    out = upsert.without_ids(upsert.with_verdicts(news, v), spark.createDataFrame([(9,), (9,)], "id long"))
    got = {r.id: r for r in out.collect()}
    assert sorted(got) == [1, 2, 3] and got[2].relevance_status == "Stage 2 (LLM)" and got[1].relevance_status == ""
    upsert.written(out, str(tmp_path / "v1"))
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 3
    old = spark.createDataFrame([(1, "t")], "id long, title string")
    assert (migrated(old).first().veri_kaynagi, migrated(old).first().ilgili_mi, migrated(old).columns) == ("Scraping", 0, news.columns)


# -- sources


FEED = """<rss><channel><item><title>Cumhurbaşkanı bugün önemli bir açıklama yaptı - Outlet</title><link>https://X.com/a/?utm_source=q</link>
<description><![CDATA[<p>Özet  metin</p>]]></description><dc:creator xmlns:dc="d">Ali</dc:creator><pubDate>Tue, 01 Sep 2026 10:00:00 +0300</pubDate></item>
<item><title>Video galeri</title><link>https://x.com/b</link></item>
<item><title>Bakanlık yeni kararları bugün kamuoyuna duyurdu</title><link>https://x.com/c</link></item></channel></rss>"""
ATOM = """<feed><entry><title>Ekonomide yeni dönem bugün resmen başladı</title><link href="https://y.com/1"/><summary>S</summary><updated>2026-09-01T09:00:00Z</updated></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.xml").write_text(FEED)
    (tmp_path / "f/b.xml").write_text(ATOM)
    got = {r.link: r for r in feeds.feed_items(spark, str(tmp_path / "f"), AS_OF, "id", "Outlet", "c").collect()}
    assert sorted(got) == ["https://x.com/a", "https://x.com/c", "https://y.com/1"]
    a = got["https://x.com/a"]
    assert (a.title, a.summary, a.author, a.publish_date) == ("Cumhurbaşkanı bugün önemli bir açıklama yaptı", "Özet metin", "Ali", "2026-09-01 07:00:00")
    assert got["https://x.com/c"].publish_date == AS_OF and got["https://y.com/1"].publish_date == "2026-09-01 09:00:00"


def test_pages(spark):
    page = """<html><head>%s</head><body>%s<article><p>Takip et</p><p>""" + "Uzun bir paragraf metni. " * 6 + """<p>İkinci paragraf.</p></article><footer><p>f</p></footer></body></html>"""
    pages = [
        (1, page % ('<meta property="article:published_time" content="2026-08-31T10:00:00+03:00">', "")),
        (2, page % ('<script type="application/ld+json">{"@graph": [{"x": 1}, {"datePublished": "2026-08-30T08:00:00Z"}]}</script>', "")),
        (3, page % ("", '<time datetime="bad">29 Ağustos 2026 10:15</time>')),
        (4, page % ("", '<span class="tarih">28.08.2026</span>')),
        (5, page % ("", "<div>27 Ağustos 2026 </div>")),
        (6, "<p>kısa</p>"),
        (7, None),
    ]
    got = {r.id: r for r in html.bodies(spark.createDataFrame(pages, "id int, html string")).collect()}
    assert [got[i].page_date for i in range(1, 8)] == ["2026-08-31 10:00:00", "2026-08-30 08:00:00", "2026-08-29 10:15:00", "2026-08-28 12:00:00", "2026-08-27 12:00:00", None, None]
    assert got[1].body.startswith("Uzun") and got[1].body.endswith("İkinci paragraf.") and "Takip" not in got[1].body and got[6].body == ""


@pytest.mark.parametrize("read", [html.bodies, lambda pages: html.cards(pages, [html.CardSpec("s", "https://z.com")], AS_OF)])
def test_pages_come_in_short_batches(spark, read):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    read(spark.createDataFrame([("s", "<p>x</p>")], "source_name string, html string"))
    sizes = F.pandas_udf(lambda batch: batch * 0 + len(batch), "long", F.PandasUDFType.SCALAR)
    assert spark.range(0, 2000, 1, 1).select(F.max(sizes("id"))).first()[0] <= 256
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    read(spark.createDataFrame([("s", "<p>x</p>")], "source_name string, html string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trees_of_pages_hold_no_cycles():
    gc.collect()
    html.tree("<div><p>a<b>c</b></p></div>" * 50)
    assert gc.collect() == 0


def test_cards_and_local_items(spark):
    h = """<div class="news-card"><a href="/haber/1"><h3>Uzun bir haber başlığı burada</h3></a><p class="spot">Özet</p><span> 14.20</span></div>
    <div class="news-card"><a href="https://z.com/2"><h3>Kısa</h3></a></div><div class="news-card">link yok</div>"""
    pages = spark.createDataFrame([("s", h), ("other", h)], "source_name string, html string")
    got = html.cards(pages, [html.CardSpec("s", "https://z.com")], AS_OF).collect()
    assert [(r.link, r.title, r.summary, r.publish_date) for r in got] == [("https://z.com/haber/1", "Uzun bir haber başlığı burada", "Özet", "2026-09-01 14:20:00")]


def test_search_results_and_policies(spark, tmp_path):
    sources = spark.createDataFrame([(0, "NTV", "A")], "ord int, name string, category string")
    j = '{"news_results": [{"title": "31 Ağustos töreni", "link": "u", "date": "2 saat önce", "source": {"name": "ntv haber"}}, {"title": "x", "link": ""}, {"title": "y", "link": "v", "iso_date": "2026-09-01T01:02:03Z"}]}'
    got = {r.link: r for r in feeds.search_items(spark.createDataFrame([(j,), ("bad",)], "json string"), sources, AS_OF).collect()}
    assert (got["u"].source_name, got["u"].publish_date) == ("NTV", "2026-08-31 12:00:00") and (got["v"].source_name, got["v"].publish_date) == ("Bilinmeyen", "2026-09-01 01:02:03")
    feeds.log_usage(spark, str(tmp_path / "log"), AS_OF, 3)
    feeds.log_usage(spark, str(tmp_path / "log"), AS_OF, 1)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == [f"{AS_OF} queries=1 cost=0.01", f"{AS_OF} queries=3 cost=0.03"]


# -- filters, reports and cycles


def test_filters_and_pages(spark):
    news = stored(spark).withColumn("is_other", F.lit(False))
    assert filters.backfill(news).select("id").collect()[0].id == 2
    assert news.where(filters.is_relevant()).count() == 2 and news.where(filters.on_day("2026-08-31")).count() == 4
    got = report.page(news.withColumn("ilgi_kategorisi", F.lit("Azerbaycan, Spor")), "Azerbaycan", "spor", query="OLD", shown=1).collect()
    assert [(r.id, r.matches) for r in got] == [(2, 2)]
    assert filters.dirty_rows(news.withColumn("title", F.lit("14:20 x"))).count() == 4 and filters.dirty_rows(news).count() == 0
    blocked = spark.createDataFrame([("KKTC Haber", None), ("x", "https://a.BRTK.net/1"), (None, None)], "source_name string, link string")
    assert [r[0] for r in blocked.select(filters.blocked()).collect()] == [True, True, False]
    assert report.run_metrics(news, news).first().asDict() == {"fetched": 4, "saved": 4, "relevant": 2, "duration_seconds": None}
    assert report.run_metrics(news, news, "2026-08-31 10:00:00", "2026-08-31 10:01:05").first().duration_seconds == 65.0


def test_ingest_cycle(spark):
    rows = [
        (1, "Azerbaycan ordusu bugün ortak tatbikat düzenledi", "u1", "2026-09-01 09:00:00"),
        (2, "Azerbaycan ordusu bugün ortak tatbikat düzenledi - NTV", "u2", "2026-09-01 09:05:00"),
        (3, "Azerbaycan ordusu bugün büyük ortak tatbikat düzenledi", "u3", "2026-09-01 09:06:00"),
        (4, "Dünkü haber bugün için artık çok eski sayılır", "u4", "2026-08-31 09:00:00"),
        (5, "Video galeri", "u5", "2026-09-01 09:00:00"),
        (6, "Bambaşka konu hakkında yepyeni uzun bir haber", "l1", "2026-09-01 09:00:00"),
        (7, "Ekonomide yepyeni gelişmeler piyasaları hareketlendirdi", "u7", "2026-09-01 13:00:00"),
    ]
    items = spark.createDataFrame([(o, "id", "NTV", "c", t, "", "", d, u, None, None) for o, t, u, d in rows], "ord long, source_id string, source_name string, category string, title string, summary string, author string, publish_date string, link string, scraped_at string, veri_kaynagi string")
    sources = spark.createDataFrame([(0, "NTV", "rss")], "ord int, name string, type string")
    bodies = spark.createDataFrame([("u7", "Kazakistan " + "metin " * 30, "2026-09-01 08:00:00")], "link string, body string, page_date string")
    out = ingest.ingest(items, stored(spark), LEXICON, sources, AS_OF, bodies)
    got = {r.link: r for r in out.collect() if r.id > 9}
    assert sorted(got) == ["u1", "u7"]
    assert (got["u1"].ilgili_mi, got["u1"].ilgi_kategorisi, got["u1"].veri_kaynagi) == (1, "Azerbaycan, Güvenlik/Savunma", "RSS")
    assert (got["u7"].ilgi_kategorisi, got["u7"].publish_date) == ("Kazakistan", "2026-09-01 08:00:00")
    read = ingest.dashboard(out, "2026-09-01").collect()
    assert {r.link for r in read} == {"u1", "u7"} and all(r.is_other and r.group_rank == 1 for r in read)


def test_a_cycle_reads_the_stored_table_once_for_each_use(spark):
    """For links, for stories, for today's rows and for the upsert; what comes of it is written, not read again."""
    reads, news = spark.sparkContext.accumulator(0), stored(spark)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    schema = "ord long, source_id string, source_name string, category string, title string, summary string, author string, publish_date string, link string, scraped_at string, veri_kaynagi string"
    items = spark.createDataFrame([(o, "id", "NTV", "c", t, "", "", "2026-09-01 09:00:00", f"u{o}", None, None) for o, t in ((1, "Azerbaycan ordusu bugün ortak tatbikat düzenledi"), (2, "Bambaşka konu hakkında yepyeni uzun bir haber"))], schema)
    sources = spark.createDataFrame([(0, "NTV", "rss")], "ord int, name string, type string")
    out = ingest.ingest(items, news.mapInPandas(counted, news.schema), LEXICON, sources, AS_OF).collect()
    assert len(out) > news.count() and reads.value <= 4 * news.count()


def test_titles_without_key_all_stay(spark):
    rows = [(1, "s", "?!", "2026-09-01"), (2, "s", "?!", "2026-09-01"), (3, "s", "Bir", "2026-09-01"), (4, "s", "bir!", "2026-09-01"), (5, None, "iki", "2026-09-01"), (6, "s", None, "2026-09-01"), (6, "s", None, "2026-09-01"), (7, "s", "Bir", None)]
    items = spark.createDataFrame(rows, "ord long, source_name string, title string, publish_date string")
    kept = lambda old: sorted(r.ord for r in dedup.new_stories(items, old).collect())
    assert kept(items.where("false")) == [1, 2, 3, 5, 6, 6, 7]
    assert kept(items.where("ord in (4, 5) or title is null")) == [1, 2, 6, 6, 7]
    assert kept(items.where("ord = 1")) == [3, 5, 7]


def test_sequential_purge_as_a_fold(spark):
    import random

    from pyspark.sql import functions as F

    from quillstream.operators import dedup

    r = random.Random(4)
    rows = [(i, "s", "One headline of a story" if r.random() < 0.5 else f"Story {r.randint(0, 60)}", "2024-01-02 10:00:00", r.choice(["https://news.google.com/x", "https://a/x"]), r.choice([0, 0, 1, None])) for i in range(400)]
    news = spark.createDataFrame(rows, "id long, source_name string, title string, publish_date string, link string, ilgili_mi int")
    kept = {}
    for i, _, title, _, link, relevant in rows:
        now = (i, "google" in link, relevant or 0)
        old = kept.get(title)
        if old is None or old[1] and not now[1] or old[2] == 0 and now[2] == 1:
            kept[title] = now
    got = [x.id for x in dedup.sequential_survivors(news).select(F.col("id")).collect()]
    assert sorted(got) == sorted(x[0] for x in kept.values())


def test_a_title_that_begins_with_an_address_is_not_dirty(spark):
    rows = spark.createDataFrame([(1, "56.187.231.175 Keit in lich auf", "s"), (2, "14:24 Keit in lich auf", "s"), (3, "Keit in lich auf", "s")], "id long, title string, source_name string")
    assert [r.id for r in filters.dirty_rows(rows).collect()] == [2]
