"""Text and date functions on golden rows."""

import pytest
from pyspark.sql import functions as F

from quillstream.functions import dates, text

AS_OF = "2026-09-01 12:00:00"


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (text.clean_text, [" <p>a  b</p>\n<b>c</b> ", None, ""], ["a b c", "", ""]),
    (text.clean_leading_time, ["14:24 - Başlık  &amp; son", "14.24 SON DAKİKA: Deprem", "son dakika | x", None, "CANLI"], ["Başlık & son", "Deprem", "x", "", ""]),
    (lambda c: text.clean_leading_time(c, numbers=True), ["94.182.225.142 Kars", "10.15.2024 Kars", "14:24:30 - Kars", "14.24 CANLI: Kars", "1:234 Kars"], ["94.182.225.142 Kars", "10.15.2024 Kars", "Kars", "Kars", "1:234 Kars"]),
    (text.strip_title_suffix, ["Uzun bir başlık - Outlet", "Kısa - Outlet", "A - b uzun başlık - X"], ["Uzun bir başlık", "Kısa - Outlet", "A - b uzun başlık"]),
    (text.title_key, ["14:20 Gündem - Kars'ta Şiddetli! - Sözcü Gazetesi", "Haberler: Yeni", None, "İstanbul | TRT Haber"], ["karstaşiddetli", "yeni", "", "istanbul"]),
    (lambda c: text.title_key(c, False), ["Gündem - Kars"], ["gündemkars"]),
    (lambda c: F.array_sort(text.title_words(c)), ["Son dakika: Kars ve Iğdır 2024 kars ab", None], [["2024", "iğdır", "kars"], []]),
    (lambda c: F.array_sort(text.folded_words(c)), ["Şöyle BÜYÜK büyük haberleri konuşma"], [["buyuk", "konusma"]]),
    (text.turkish_lower, ["IĞDIR İZMİR Əli"], ["ığdır izmir əli"]),
    (text.search_fold, [" Kırgızistan IĞDIR ÖÇ "], ["kirgizistan iğdir öç"]),
    (text.canonical_url, ["HTTP://News.Example.com/a/b/?utm_source=x&id=3&preference=1&flag#top", "https://x.com/a;p=1?b=2", "https://x.com/", "", None, "not a url", "https://X.com?a=1&a=2"], ["http://news.example.com/a/b?id=3", "https://x.com/a;p=1?b=2", "https://x.com", "", "", "not a url", "https://x.com?a=1&a=2"]),
    (text.is_junk_title, ["", "Kısa başlık", "Cumhurbaşkanı bugün önemli bir açıklama yaptı", "Kars haberleri tüm haberler", "Bugün Video Galeri sayfasında neler var acaba", "12 Ağustos 2026 14:20 Cumhurbaşkanı bugün önemli açıklama yaptı", "Kadın Voleybol Takımı, son 16 turunda rakibini yendi", None], [True, True, False, True, True, False, True, True]),
    (text.needs_brief, [None, "x" * 60, "x" * 60 + "...", "x" * 60 + "…", "..."], [True, False, True, True, True]),
    (text.is_full_summary, ["x" * 59, "x" * 60, "x" * 60 + "... ", None], [False, True, False, False]),
    (text.source_slug, ["DHA | Demirören Haber Ajansı"], ["dhademirörenhabe"]),
    (text.display_time, ["2026-09-01 14:20:00", "14:20"], ["14:20", "14:20"]),
    (text.query_encoded, ["Kars haber"], ["%22Kars%20haber%22"]),
    (lambda c: text.without_affixes(c, ("Gündem",), ("Yeni Şafak",)), ["Gündem Haber - Yeni Şafak", "Haber"], ["Haber", "Haber"]),
    (text.json_object, ['x ```json\n{"a": 1}\n``` {"b": 2}', 'say {"a": {"b": 1}} and {bad}', "pre {bad} post", "none", None], ['{"a": 1}', '{"a": {"b": 1}}', "{bad}", "", ""]),
    (text.clean_brief, ["<think>hm</think>Özet: \"Metin.\"", "a <summary> İçerik </summary>", "Drafting\nAttempt 1: ilk\nAttempt 2: son", "Drafting\n1. **Analyze** x\nkalan satır", None], ["Metin.", "İçerik", "son", "Drafting kalan satır", ""]),
    (lambda c: dates.clock_in(c, AS_OF), ["saat 9.05 oldu", "23:59", "yok"], ["2026-09-01 09:05:00", "2026-09-01 23:59:00", None]),
    (dates.rfc822, ["Tue, 01 Sep 2026 10:00:00 +0300", "Tue, 1 Sep 2026 10:00:00 GMT", "2026-09-01", None], ["2026-09-01 07:00:00", "2026-09-01 10:00:00", None, None]),
    (dates.iso, ["2026-09-01T10:00:00Z", "2026-09-01T10:00:00.123Z", "2026-09-01T10:00:00+03:00", "2026-09-01", "x"], ["2026-09-01 10:00:00"] * 3 + ["2026-09-01 00:00:00", None]),
    (lambda c: dates.pipeline_date(c, AS_OF), ["", "2027-01-01 00:00:00", "31.08.2026 22:12", "garbage"], [AS_OF, AS_OF, "2026-08-31 22:12:00", AS_OF]),
    (lambda c: dates.title_date(c, AS_OF), ["31 Ağustos törenleri", "1 Ocak 2020 günü", "31 Aralık kutlaması", "31 Şubat 2020 olmaz", "yok"], ["2026-08-31 12:00:00", "2020-01-01 12:00:00", None, None, None]),
    (dates.text_date, ["tarih 31 Ağustos 2026 22:12 idi", "31.08.2026", "1/9/2026 8.05", "31-02-2026", "5 MAYIS 2024", None], ["2026-08-31 22:12:00", "2026-08-31 12:00:00", "2026-09-01 08:05:00", None, "2024-05-05 12:00:00", None]),
    (dates.parse_date, ["2026-09-01T10:00:00.5Z", "2026-09-01 10:00", "01.09.2026 10:00:05", "2026/09/01 10:00:00", "nope"], ["2026-09-01 10:00:00", "2026-09-01 10:00:00", None, "2026-09-01 10:00:00", None]),
    (lambda c: dates.relative_date(c, AS_OF), ["15 dak önce", "2 saat önce", "3 gün önce", "1 day 5 min", "dün"], ["2026-09-01 11:45:00", "2026-09-01 10:00:00", "2026-08-29 12:00:00", "2026-09-01 11:55:00", None]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(spark, case):
    f, inputs, expected = CASES[case]
    assert values(spark, f, inputs) == expected


def test_title_time(spark):
    rows = spark.createDataFrame([("2026-09-01 00:00:00", "14:20 - x"), ("2026-09-01 00:00:00", "29:20 x"), ("2026-09-01 10:00:00", "14:20 x")], "d string, t string")
    assert [r[0] for r in rows.select(dates.with_title_time(F.col("d"), F.col("t"))).collect()] == ["2026-09-01 14:20:00", "2026-09-01 00:00:00", "2026-09-01 10:00:00"]


def test_section_and_time_are_split_off(spark):
    base = F.lit("2026-08-27 19:40:00")
    rows = spark.createDataFrame([("Güncel / 15:58İngiltere Şirket Kurma Paketleri Nelerdir?",), ("Gündem / 14:20 - Kars’ta Şiddetli Fırtına",), ("Plain",)], "x string")
    got = [tuple(r[0]) for r in rows.select(dates.section_time(F.col("x"), base)).collect()]
    assert got == [("İngiltere Şirket Kurma Paketleri Nelerdir?", "2026-08-27 15:58:00"), ("Kars’ta Şiddetli Fırtına", "2026-08-27 14:20:00"), ("Plain", "2026-08-27 19:40:00")]


def test_unescaped_fully(spark):
    assert values(spark, text.unescaped_fully, ["&eacute;&#x41;", None]) == ["éA", None]


def test_squashed_is_every_run_of_white_space_as_a_blank(spark):
    import random

    r = random.Random(3)
    signs = [chr(c) for c in (*range(1, 0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)] + [" "] * 30 + ["a", "ç", "&"] * 12
    texts = [("".join(r.choice(signs) for _ in range(r.randint(0, 12))),) for _ in range(3000)]
    plain = F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), "^ | $", "")
    assert spark.createDataFrame(texts, "t string").where(text.squashed(F.col("t")) != plain).count() == 0
