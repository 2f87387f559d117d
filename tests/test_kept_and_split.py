"""A table of versions under replays, folds that are split, streams that keep state, phrases and names by hash."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.functions.lexicon import Lexicon, Phrases, java
from quillstream.operators import dedup, lookup, report, upsert
from quillstream.operators.components import components
from quillstream.plans import ingest
from quillstream.schema import RAW_ARTICLE
from quillstream.sources import configured
from quillstream.sources.news_table import NewsTable
from quillstream.streaming import monitor

AS_OF = "2026-09-03 12:00:00"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables; each partition of a stream keeps state of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


# -- the kept table


def items(spark, rows):
    return spark.createDataFrame([(o, "s", "c", t, s, d, link, r) for o, t, s, d, link, r in rows], "ord long, source_name string, category string, title string, summary string, publish_date string, link string, ilgili_mi int")


BATCHES = [
    [(1, "eins", "kurz", "2026-09-01 10:00:00", "u1", 1), (2, "zwei", "x" * 80, "2026-09-02 10:00:00", "u2", 1), (3, "drei", "", "", "u3", 0)],
    [(4, "eins neu", "", "2026-09-01 11:00:00", "u1", 0), (5, "vier", "y", "2026-09-03 09:00:00", "u4", 0)],
    [(6, "zwei neu", "andere", "2026-09-03 08:00:00", "u2", 0), (7, "eins, zum dritten", "lang " * 20, "", "u1", 1), (8, "fünf", None, None, "u5", None)],
]


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(tuple(r) for r in df.drop("publish_day").collect())


def test_batches_with_a_replay_and_a_crash_equal_one_batch(spark, tmp_path):
    news = NewsTable(spark, str(tmp_path / "news"))
    assert news.read().collect() == [] and news.days() == []
    assert news.upsert(items(spark, BATCHES[0]), AS_OF, "w", 0) == 0
    first = rows_of(news.read())
    assert news.upsert(items(spark, BATCHES[0]), AS_OF, "w", 0) is None and rows_of(news.read()) == first
    real = spark.createDataFrame

    class Killed(Exception):
        pass

    def die(data, *rest, **more):
        if rest and "data_version" in str(rest[0]) and data:
            raise Killed
        return real(data, *rest, **more)

    news.spark = type("Session", (), {"createDataFrame": staticmethod(die), "__getattr__": lambda _, k: getattr(spark, k)})()
    with pytest.raises(Killed):  # its files are written, its line in the log isn't
        news.upsert(items(spark, BATCHES[1]), AS_OF, "w", 1)
    news.spark = spark
    assert os.path.isdir(tmp_path / "news/data/version=1") and rows_of(news.read()) == first
    assert news.upsert(items(spark, BATCHES[1]), AS_OF, "w", 1) == 1
    assert news.upsert(items(spark, BATCHES[2]), AS_OF, "w", 2) == 2
    none = NewsTable(spark, str(tmp_path / "none")).read().drop("publish_day")
    assert rows_of(news.read()) == rows_of(upsert.merged(none, items(spark, sum(BATCHES, [])), AS_OF))
    assert rows_of(news.read(version=0)) == first


def test_only_days_that_change_are_written(spark, tmp_path):
    news = NewsTable(spark, str(tmp_path / "news"))
    news.upsert(items(spark, BATCHES[0]), AS_OF, "w", 0)
    before = files(tmp_path / "news/data")
    news.upsert(items(spark, BATCHES[1]), AS_OF, "w", 1)
    after = files(tmp_path / "news/data")
    assert all(after[f] == t for f, t in before.items())
    assert {f.split("publish_day=")[1][:10] for f in after if f not in before} == {"2026-09-01", "2026-09-03"}
    assert {d.day: d.data_version for d in news.days()} == {"2026-09-01": 1, "2026-09-02": 0, "2026-09-03": 1}
    plan = news.read().where("publish_day = '2026-09-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(publish_day" in plan
    # a row that moves to another day leaves its own empty, which then has no line
    news.upsert(items(spark, [(9, "zwei", "", "2026-09-01 10:00:00", "u2", 0)]), AS_OF, "w", 2)
    assert "2026-09-02" not in {d.day for d in news.days()} and len(rows_of(news.read())) == 4
    news.rewrite(lambda rows: rows.where("link <> 'u4'"), {"2026-09-03"}, "purge", 0)
    assert sorted(r.link for r in news.read().collect()) == ["u1", "u2", "u3"]
    news.upsert(items(spark, [(1, "neu", "", "2026-09-04 10:00:00", "u9", 0)]), AS_OF, "w", 3)
    assert max(r.id for r in news.read().collect()) == 5  # ids of rows that are gone aren't given again
    kept = rows_of(news.read())
    assert news.forget(1) and rows_of(news.read()) == kept and news.applied("w", 0)


def test_a_path_that_is_read_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "news")
    upsert.written(spark.createDataFrame([(1, "2026-09-01 10:00:00")], "id long, publish_date string"), path)
    again = spark.read.parquet(path)
    with pytest.raises(ValueError):
        upsert.written(again.where("id > 0").drop("publish_day"), path)
    assert again.count() == 1
    upsert.written(again.drop("publish_day"), path + "2")


def test_a_cycle_is_kept_batch_by_batch(spark, tmp_path):
    lexicon = Lexicon.read()
    sources = spark.createDataFrame([(0, "Haber", "A", "rss", "")], "ord int, name string, category string, type string, domain string")
    news = NewsTable(spark, str(tmp_path / "news"))
    rows = [
        [(1, "Bakü'de enerji zirvesi bugün başladı devam ediyor", "u1"), (2, "Bakü'de enerji zirvesi bugün başladı", "u2")],
        [(3, "Bakü'de enerji zirvesi bugün başladı devam", "u3"), (4, "Astana görüşmeleri yarın yeniden başlıyor", "u4"), (5, "Astana görüşmeleri yarın yeniden başlıyor", "u1")],
    ]
    for batch in rows:
        spark.createDataFrame([(o, "i", "Haber", "c", t, "", "", "2026-09-03 09:00:00", u, None, None) for o, t, u in batch], RAW_ARTICLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = monitor.kept_cycle(monitor.landed(spark, str(tmp_path / "in")), news, lambda b, stored: ingest.judged(b, stored, lexicon, sources, AS_OF), lambda _: AS_OF, str(tmp_path / "ck"), "cycle")
        assert seen.awaitTermination(120) and seen.exception() is None
    got = {r.link: r for r in news.read().collect()}
    assert sorted(got) == ["u1", "u4"] and got["u4"].ilgi_kategorisi == "Kazakistan" and got["u1"].veri_kaynagi == "RSS"
    assert [d.version for d in news.days()] == [1]


def test_counts_are_taken_in_the_pass_that_writes(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    items_ = spark.range(100).selectExpr("id", "cast(id % 3 = 0 as int) as ilgili_mi").mapInPandas(seen, "id long, ilgili_mi int")
    got = report.observed_run(items_, lambda x: x.where("id >= 10"), lambda x: x.write.parquet(str(tmp_path / "out")), "2026-01-01 00:00:00", "2026-01-01 00:00:09").first()
    assert tuple(got) == (100, 90, 30, 9.0) and read.value == 100


def test_pages_read_a_day_each(spark, tmp_path):
    rows = [(i, f"t{i}", "", f"2026-09-{1 + i // 20:02} {i % 20 // 2:02}:00:00", f"u{i}", i % 2) for i in range(100)]
    news = NewsTable(spark, str(tmp_path / "news"))
    news.upsert(items(spark, rows), AS_OF)
    all_ = [r.id for r in news.read().orderBy(F.desc("publish_date"), F.desc("id")).collect()]
    after, got = None, []
    for _ in range(5):
        page = news.page(30, after)
        last = page.orderBy("publish_date", "id").first()
        got += [r.id for r in page.orderBy(F.desc("publish_date"), F.desc("id")).collect()]
        after = (last.publish_date, last.id) if last else after
    assert got == all_ and news.page(10, after).collect() == []
    news.upsert(items(spark, [(k, "t", "", "ohne", f"v{k}", 0) for k in range(3)]), AS_OF)
    assert [r.link for r in news.page(2, after).collect()] == ["v2", "v1"] and [r.link for r in news.page(2, ("ohne", 102)).collect()] == ["v0"]
    assert [r.link for r in news.page(3, ("2026-09-02 00:00:00", 10**9), F.col("ilgili_mi") == 1).collect()] == ["u21", "u19", "u17"]


# -- folds that are split


def test_components_are_those_of_a_walk(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def headlines(spark, n, seed):
    r = random.Random(seed)
    words = [f"kelime{k}" for k in range(40)] + ["ankara", "haber7"]
    rows = []
    for i in range(n):
        title = " ".join(r.sample(words, r.choice([0, 1, 2, 3, 4, 5, 7]))) if r.random() < 0.6 or not rows else " ".join(set((rows[-1][2] + " " + r.choice(words)).split()))
        when = r.choice([None, "x", f"2026-09-01 {r.randrange(24):02}:{r.randrange(60):02}:00"])
        rows.append((i, r.choice(["s", "s", "t"]), r.choice([title, title, title + " BISTECH KAP"]) if r.random() < 0.1 else title, when, r.choice(["u", "https://news.google.com/x"]), r.choice([0, 1])))
    return spark.createDataFrame(rows, "id long, source_name string, title string, publish_date string, link string, ilgili_mi int")


@pytest.mark.parametrize("rule", [dedup.INGEST, dedup.HISTORY, dedup.ONE_DAY])
def test_split_folds_keep_the_same_rows(spark, rule):
    for seed in (1, 2):
        rows = headlines(spark, 300, seed)
        whole = sorted(r.id for r in dedup.near_survivors(rows, rule, ["source_name"], whole=10_000).collect())
        split = sorted(r.id for r in dedup.near_survivors(rows, rule, ["source_name"], whole=0).collect())
        assert whole == split and 0 < len(whole) < 300


def test_a_hot_group_is_folded_in_many_tasks(spark):
    """200,000 headlines of one source and day, most of them near to one or two others."""
    n = 200_000
    word = lambda k: F.concat(F.lit("w"), F.conv(F.pmod(F.xxhash64(F.col("id") - F.col("id") % 2, F.lit(k)), F.lit(1 << 24)).cast("string"), 10, 36))
    title = F.concat_ws(" ", *(word(k) for k in range(6)), F.when(F.col("id") % 2 == 1, "ek"))
    rows = spark.range(n).select("id", F.lit("s").alias("source_name"), title.alias("title"), F.lit("2026-09-01 10:00:00").alias("publish_date"), F.col("id").cast("string").alias("link"))
    kept = dedup.near_survivors(rows, dedup.INGEST)
    assert kept.agg(F.count("*"), F.sum(F.col("id") % 2)).first()[:] == (n // 2, 0)


# -- streams that keep state


def test_headlines_of_batches_equal_the_fold(spark, tmp_path):
    rows = headlines(spark, 120, 5).withColumn("publish_date", F.concat(F.lit("2026-09-0"), (F.col("id") % 2 + 1).cast("string"), F.lit(" 10:00:00")))
    for k in range(3):
        rows.where(f"id div 40 = {k}").withColumnRenamed("id", "ord").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept = monitor.new_headlines(monitor.landed(spark, str(tmp_path / "in"), "ord long, source_name string, title string, publish_date string"), late="5 days")
        query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    got = sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.id for r in dedup.near_survivors(rows, dedup.INGEST, whole=10_000).collect())


def test_lists_of_words_go_on_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor.Headlines, "LIST", 2)
    rows = [(i, "s", f"aynı{'' if i % 2 else ' kelimeler'} başka{i} farklı{i} sözcük{i}", "2026-09-01 10:00:00") for i in range(12)] + [(12, "s", "aynı kelimeler başka3 farklı3 sözcük3", "2026-09-01 10:00:00"), (13, "s", "kelimeler", "2026-09-01 11:00:00"), (14, "s", "yepyeni kelimeler bunlar", "2026-09-01 12:00:00")]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, "ord long, source_name string, title string, publish_date string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = monitor.new_headlines(monitor.landed(spark, str(tmp_path / "in"), "ord long, source_name string, title string, publish_date string", per_batch=1))
    query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*range(12), 13]


class State:
    """A processor's handle and its states, which counts their calls."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def getMapState(self, name, *_):  # noqa: N802
        return Values(self, name)

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, _):  # noqa: N802
        pass

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


class Values:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def getValue(self, key=()):  # noqa: N802
        self.state.calls += 1
        return self.state.values.get((self.name, *key))

    def updateValue(self, key, value):  # noqa: N802
        self.state.calls += 1
        self.state.values[(self.name, *key)] = value

    get = getValue

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.updateValue((), value)


def kept_of(batches, state, **sizes):
    """ords that a source and day keeps of batches of (ord, words)."""
    out = []
    for batch in batches:
        processor = monitor.Headlines()
        vars(processor).update(sizes)
        processor.init(state)
        some = pd.DataFrame(batch, columns=["ord", "words"])
        out += [o for got in processor.handleInputRows(("s", "2026-09-01"), iter([some[::2], some[1::2]]), state) for o in got["ord"]]
    return out


def test_a_batch_of_headlines_calls_the_state_a_few_times():
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(3000)]
    state = State()
    assert kept_of([rows[:2000], [*rows[:1000], *rows[2000:]]], state) == [*range(3000)] and state.calls < 30


def test_slices_and_parts_of_any_size_keep_the_same_headlines():
    r = random.Random(3)
    for words, most in ((12, 5), (40, 8), (300, 25)):
        rows = [(i, " ".join(sorted(r.sample([f"w{k}" for k in range(words)], r.randint(0, most))))) for i in range(400)]
        rows = [(i, " ".join(sorted({*line.split()[1:], f"w{i % words}"})) if line and r.random() < 0.3 else r.choice([line, rows[i // 2][1]])) for i, line in rows]
        kept, stay = [], []
        for i, line in rows:
            x = set(line.split())
            if len(x) < 3 or not any(len(x & k) / len(x | k) >= 0.65 or len(x & k) == min(len(x), len(k)) for k in kept):
                stay.append(i)
                kept += [x] if x else []
        assert 0 < len(stay) < 400
        for sizes in ({}, {"SLICE": 7, "LIST": 3}, {"SLICE": 1, "LIST": 1}, {"SLICE": 64}):
            assert kept_of([rows[:150], rows[150:160], rows[160:]], State(), **sizes) == stay


# -- phrases and names by hash

WORDS = ("azerbaycan", "azerbaycan'ın", "bakı", "Fuzuli", "fuzuli kenti", "3+3 formatı", "o‘zbekistan", "kars-nahçıvan", "tap", "azerbaycan", "қазақстан", "c++", "kırgızistan", "dağlık karabağ", "karabağ", ".net")


def test_phrases_agree_with_their_patterns(spark):
    r = random.Random(7)
    pieces = [*WORDS, *(w.upper() for w in WORDS), *(w.capitalize() for w in WORDS), "x", " ", "-", "'", "ç", "KIRGIZİSTAN", "ſ", "_", "1", "\n", "kenti", "FUZULI", "Bakı", "BAKI", "̇"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", " ", ", "]) for _ in range(r.randint(0, 12))) for _ in range(400)] + ["", " "]
    phrases = Phrases(WORDS)
    t = F.col("t")
    by_pattern = F.array_compact(F.array(*(F.when(t.rlike(java(w)), F.lit(w)) for w in WORDS)))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = df.select("t", phrases.listed(phrases.found(t), WORDS).alias("ours"), by_pattern.alias("theirs"), phrases.any(phrases.found(t), WORDS[2:5]).alias("some")).collect()
    assert sum(bool(x.ours) for x in rows) > 100
    for x in rows:
        assert x.ours == x.theirs and x.some == any(w in x.theirs for w in WORDS[2:5]), x.t
    assert df.select(Phrases(()).found(t).alias("f")).where("size(f) > 0").count() == 0


def test_stretches_begin_where_a_phrase_of_words_does(spark):
    """A stretch is built at no other part, so that a text costs its words and not all their stretches."""
    phrases = Phrases(("tap", "bakı", "dağlık karabağ", "3+3 formatı"))
    assert (phrases.firsts, phrases.longer) == (["3", "dağlik"], [3, 5])
    rows = [("dağlık dağlık karabağ",), ("x 3+3 formatı",), ("formatı 3+3",), ("3",), ("Tap, Bakı",), ("bakı",), ("",), (None,)]
    found = [sorted(x.f) for x in spark.createDataFrame(rows, "t string").select(phrases.found(F.col("t")).alias("f")).collect()]
    assert found == [["dağlik karabağ"], ["3+3 formati"], [], [], ["=Bakı", "tap"], [], [], []]


def test_parts_are_those_of_plain_classes(spark):
    r = random.Random(5)
    signs = [chr(c) for c in [*range(1, 0x3000), *range(0xFE00, 0x10000), *range(0x1F100, 0x1F200)]]
    texts = [("".join(r.choice(signs if k % 2 else signs[:0x180]) for _ in range(40)),) for k in range(2000)]
    parts = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert spark.createDataFrame(texts, "t string").where(parts(Phrases.PARTS) != parts(r"(?U)\w+|\W+")).count() == 0


def test_the_shipped_lexicon():
    x = Lexicon.read()
    assert len(x.keywords) == 201 and len(set(x.keywords)) == 190 and list(x.countries)[0] == "Azerbaycan" and len(x.countries) == 6
    assert x.flagging == ("Ermenistan Hattı", "Sınır Hattı & Bölgesel Diplomasi") and "tdt" in x.union


def test_names_within_names(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abİç ") for _ in range(r.randint(0, 6)))
    names, patterns = [word() for _ in range(120)] + [""], [(i, word()) for i in range(80)]
    for chosen in (patterns, [p for p in patterns if len(p[1]) > 2], []):
        got = {x.name: x.found for x in lookup.first_within(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(chosen, "ord int, pattern string")).collect()}
        assert got == {n: min((i for i, p in chosen if p in n or n in p), default=None) for n in names}


def test_any_number_of_sources(spark):
    sources = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("Outlet "), F.col("id").cast("string"), F.lit(" News")).alias("name"), F.lit("K").alias("category"))
    raw = spark.createDataFrame([("the outlet 77777 news online",), ("OUTLET 5",), ("nobody",), (None,)], "raw_source string")
    got = {x.raw_source: (x.source_name, x.category) for x in lookup.with_source(raw, sources).collect()}
    assert got == {"the outlet 77777 news online": ("Outlet 77777 News", "K"), "OUTLET 5": ("Outlet 5 News", "K"), "nobody": ("nobody", lookup.OTHER), None: ("Outlet 0 News", "K")}


# -- pages of sites


def test_items_of_today_have_a_page_of_the_day(spark):
    items_ = spark.createDataFrame([("Bengütürk TV", "Gündem Bakanlıkta yeni dönem bugün resmen başladı", "l1"), ("Bengütürk TV", "Spor Dünkü maçın ardından neler söylendi", "l2"), ("Bengütürk TV", "Gündem", "l3"), ("x", "Gündem başka bir kaynakta kalır elbette", "l4"), ("x", "Sayfası olmayan uzun bir haber başlığı", "l5")], "source_name string, title string, link string")
    page = lambda d: f'<html><head><meta property="article:published_time" content="{d}T09:00:00Z"></head><body>x</body></html>'
    pages = spark.createDataFrame([("l1", page("2026-09-03")), ("l2", page("2026-09-02")), ("l3", page("2026-09-03")), ("l4", page("2026-09-03")), ("l6", page("2026-09-03"))], "link string, html string")
    got = {r.link: (r.title, r.publish_date) for r in configured.items_of_today(items_, pages, AS_OF).collect()}
    assert got == {"l1": ("Bakanlıkta yeni dönem bugün resmen başladı", "2026-09-03 09:00:00"), "l4": ("Gündem başka bir kaynakta kalır elbette", "2026-09-03 09:00:00")}


def test_rows_that_hold_an_earlier_short_set_fall_before_any_fold(spark):
    """One short title that many hold made a component of all of them, which one task folded."""
    sets = [("g", 0, ["kars"], 1), ("g", 1, ["ani", "kars"], 1)] + [("g", i, sorted(["kars", f"x{i}", f"y{i}", f"z{i}"]), 1) for i in range(2, 60)]
    sets += [("g", 60, ["a", "b", "c", "d"], 1), ("g", 61, ["a", "b", "c", "d", "e"], 1), ("g", 62, ["b", "c", "d", "e", "f"], 1)]
    nodes = spark.createDataFrame(sets, "g string, rep long, words array<string>, twins long").withColumn("times", F.array().cast("array<double>"))
    ranked = dedup._ranked(nodes)
    assert sorted(r.rep for r in dedup._short_cover(ranked, dedup.INGEST).collect()) == list(range(2, 60))
    pairs = dedup.near_pairs(ranked.where("rep >= 60"), dedup.INGEST)
    assert sorted(map(tuple, pairs.collect())) == [(60, 61), (61, 62)]
    falls, left = dedup._decided(pairs)
    assert [r.node for r in falls.collect()] == [61] and left.isEmpty()
    assert "words" not in dedup._posted(ranked, None).columns
