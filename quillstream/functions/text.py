"""Text and URL functions, Column to Column. All patterns are literals, so each is compiled once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What titles carry besides the headline, and words that don't count.
OUTLET_SUFFIXES = ("Haberler", "Sözcü", "Halk TV", "TRT Haber", "Yeni Şafak", "Cumhuriyet", "A Haber", "NTV", "DHA", "İHA", "Bengü Türk", "Bengütürk")
SECTION_LABELS = ("gündem", "son dakika", "resmi ilan", "haberler", "flaş")
ALERT_LABELS = ("SON DAKİKA", "CANLI", "FLASH", "ÖZEL HABER")
TITLE_STOPWORDS = ("ve", "ile", "bir", "icin", "bu", "da", "de", "den", "dan", "son", "dakika", "haber", "haberi")
NOTICE_STOPWORDS = ("kap", "uygulamasi", "bildirimi")
LONG_STOPWORDS = ("daha", "kadar", "sonra", "once", "gibi", "icin", "olan", "olarak", "veya", "kendi", "tarafından", "uzere", "altı", "yeni", "göre", "gore", "yoksa", "yıllık", "yılda", "tarihli", "sayılı", "konu", "haber", "haberleri", "gelen", "gecen", "geçen", "böyle", "boyle", "şöyle", "soyle", "hakkında", "hakkinda", "çünkü", "cunku", "ancak", "lakin", "fakat", "yine", "hala")
TRACKING_KEYS = ("utm", "amp", "ref", "rss", "fbclid", "gclid")
JUNK_PHRASES = ("sayfa /", "sayfa 1", "sayfa 2", "foto galeri", "video galeri", "videolar", "yazarlarımız", "çerez politikası", "gizlilik politikası", "künye", "kunye", "kurumsal", "bize ulaşın", "iletişim", "site haritası", "whatsapp ihbar", "taziye ilanları", "vefat edenler", "nöbetçi eczane", "nobetci eczane", "sayısal loto", "süper loto", "on numara", "şans topu", "milli piyango", "çekiliş sonuçları", "bilet sorgulama", "günlük burç", "burç yorumları")
GENERIC_TITLES = ("haberleri", "tüm haberler", "tum haberler", "son dakika haberleri", "manşet haberleri", "manset haberleri", "gündem haberleri", "asayiş haberleri", "ekonomi haberleri", "spor haberleri", "dünya haberleri", "yerel haberler", "kars haberleri", "ığdır haberleri", "ardahan haberleri", "mersin haberleri")
OUTDATED_PHRASES = ("son 16 turunda azerbaycan", "kadin voleybol takimi, son 16 turunda", "cumhurbaskani erdogan, aliyev ile gorustu", "cumhurbaskani erdogan aliyev ile gorustu")
PLACEHOLDER_SUMMARIES = ("...", "` and `")
SUMMARY_LABELS = ("Özet:", "Özetçe:", "Xülasə:", "Summary:")
MONOLOGUE_MARKS = ("Analyze the Request", "Drafting", "Internal Monologue", "Attempt")
MONOLOGUE_HEADS = ("Analyze", "Drafting", "Role", "Task", "Constraint", "Input", "Person", "Action", "Event", "Source")
# Entities that are decoded inside the JVM.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'", "&#x27;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lt;": "<", "&gt;": ">", "&amp;": "&"}

LEADING_TIME = r"^[0-2]?\d[:.][0-5]\d\s*[-–—:]?\s*"
_any = "|".join


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it: what is written as a chain of columns, the
    optimiser would copy into each place that uses one."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def filled(c: Column) -> Column:
    """c, with null as an empty string: the two are one everywhere a value is merely wanted or not."""
    return F.coalesce(c, F.lit(""))


def squashed(c: Column) -> Column:
    """White space, of Unicode, as single blanks, none at the ends. Only runs that aren't one blank yet are matched."""
    return F.trim(F.regexp_replace(c, r"(?U)\s(?:(?<! )|\s)\s*", " "))


def lower(c: Column) -> Column:
    return F.lower(c)


def clean_text(c: Column) -> Column:
    """Text without tags and with single blanks; null is empty."""
    return squashed(F.regexp_replace(filled(c), "<[^>]+>", " "))


def strip_title_suffix(title: Column) -> Column:
    """The part before the last " - ", if it has more than ten characters."""
    left = F.trim(F.regexp_extract(title, r"(?s)^(.*) - ", 1))
    return F.when(F.length(left) > 10, left).otherwise(title)


def unescaped(c: Column) -> Column:
    """Common character entities decoded in the JVM, each once, from left to right over the fixed list."""
    return F.when(F.contains(c, F.lit("&")), reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)).otherwise(c)


def unescaped_fully(c: Column) -> Column:
    """Every character reference of HTML, in Arrow batches."""
    from html import unescape

    return F.pandas_udf(lambda batch: batch.map(unescape, na_action="ignore"), "string", F.PandasUDFType.SCALAR)(c)


def clean_leading_time(c: Column, decode=unescaped, numbers: bool = False) -> Column:
    """Decoded, without a leading time and then a leading alert label, with single blanks. With `numbers`, a longer number
    that begins as a time does (94.182.225.142, 10.15.2024) stays whole; without, it loses that part as a time would."""
    longer = r"(?![.:]?\d)" if numbers else ""
    t = F.regexp_replace(decode(filled(c)), rf"^\d{{1,2}}[:.]\d{{2}}(:\d{{2}})?{longer}\s*[-–—]?\s*", "")
    return squashed(F.regexp_replace(t, rf"(?iuU)^({_any(ALERT_LABELS)})\s*[:|-]?\s*", ""))


def headline(title: Column, strip_labels: bool = True) -> Column:
    """A title without leading time, section label (if asked) and outlet suffix."""
    t = F.regexp_replace(filled(title), LEADING_TIME, "")
    if strip_labels:
        t = F.regexp_replace(t, rf"(?iuU)^(?:{_any(SECTION_LABELS)})\s*[-–—:]?\s*", "")
    return F.regexp_replace(t, rf"(?iuU)\s*[-–—|]\s*(?:{_any(OUTLET_SUFFIXES)}).*$", "")


def title_key(title: Column, strip_labels: bool = True) -> Column:
    """What two titles of one story share: the headline's letters and digits in lower case."""
    return F.regexp_replace(lower(headline(title, strip_labels)), r"[^\p{L}\p{N}]", "")


def title_words(title: Column, stopwords: tuple[str, ...] = TITLE_STOPWORDS) -> Column:
    """Distinct words of three letters or digits and more of a headline, without stopwords."""
    words = F.regexp_extract_all(lower(headline(title)), F.lit("[a-zA-ZğüşıöçĞÜŞİÖÇ0-9]{3,}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, stopwords)))


def folded_words(text: Column, least: int = 5, stopwords: tuple[str, ...] = LONG_STOPWORDS) -> Column:
    """Distinct ASCII words after folding Turkish letters; stopwords with such letters never match."""
    words = F.regexp_extract_all(F.translate(lower(filled(text)), "ıöüşçğ", "iouscg"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, stopwords)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contained(a: Column, b: Column) -> Column:
    """Whether one set holds the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(filled(c), "İIƏ", "iıə"))


def search_fold(c: Column) -> Column:
    """Lower case without Turkish letters, for searches."""
    return F.trim(F.lower(F.translate(F.translate(filled(c), "İI", "iı"), "ıöüşçğ", "iouscg")))


def canonical_url(url: Column) -> Column:
    """Lower-case host, no trailing slash, fragment or tracking pairs (by substring of the key), nor pairs without =."""
    u = filled(url)
    part = lambda i: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    scheme, host, path, query = (part(i) for i in range(1, 5))
    keeps = lambda pair: F.contains(pair, F.lit("=")) & ~reduce(lambda a, b: a | b, (F.contains(F.lower(F.substring_index(pair, "=", 1)), F.lit(k)) for k in TRACKING_KEYS))
    kept = F.array_join(F.filter(F.split(query, "&"), keeps), "&")
    last = F.regexp_extract(path, r"(;[^/]*)$", 1)
    path = F.concat(F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", ""), last)
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def is_junk_title(title: Column) -> Column:
    """Whether a title is navigation, a category, a bare date, too short or a known re-indexed story."""
    t = squashed(filled(title))
    t = F.regexp_replace(t, r"^\d{1,2}\s+[A-ZÇĞİÖŞÜa-zçğıöşü]+\s+\d{4}\s*\d{0,2}[:.]?\d{0,2}\s*[-–—]?\s*", "")
    t = F.trim(F.regexp_replace(t, r"^\d{1,2}[:.]\d{2}(:\d{2})?\s*[-–—]?\s*", ""))
    return bound(F.struct(t.alias("t"), lower(t).alias("low")), lambda x: _is_junk(x["t"], x["low"]))


def _is_junk(t: Column, low: Column) -> Column:
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) > 1))
    holds = lambda c, phrases: reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in phrases))
    ends = reduce(lambda a, b: a | b, (F.endswith(low, F.lit(g)) for g in GENERIC_TITLES))
    bare = t.rlike(r"^(\d+\s+[A-Za-zÇĞİÖŞÜçğıöşü]+\s+\d{4}|\d+[\s.-]+\d+[\s.-]+\d+|\d{1,2}[:.]\d{2})+$")
    plain = F.translate(low, "’‘`´“”ığüşöç", "''''\"\"igusoc")
    return (F.length(t) < 20) | (words < 4) | holds(low, JUNK_PHRASES) | low.isin(*GENERIC_TITLES) | ((words <= 4) & ends) | bare | holds(plain, OUTDATED_PHRASES)


def needs_brief(summary: Column) -> Column:
    """Whether a summary is too short, a placeholder or cut off."""
    s = F.trim(filled(summary))
    return (F.length(s) < 60) | s.isin(*PLACEHOLDER_SUMMARIES) | F.endswith(s, F.lit("...")) | F.endswith(s, F.lit("…"))


def is_full_summary(summary: Column) -> Column:
    """60 characters and more that don't end in an ellipsis."""
    return (F.length(filled(summary)) >= 60) & (F.right(F.trim(filled(summary)), F.lit(3)) != "...")


def source_slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(lower(filled(name)), r"[^\p{L}\p{N}]", ""), 1, 16)


def display_time(publish_date: Column) -> Column:
    """HH:MM of a date text, else its first five characters."""
    return F.when(F.length(publish_date) >= 16, F.substring(publish_date, 12, 5)).otherwise(F.substring(publish_date, 1, 5))


def day_of(publish_date: Column) -> Column:
    return F.substring(publish_date, 1, 10)


def without_affixes(title: Column, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), first_part: bool = False) -> Column:
    """A title without a site's prefixes and " - <site>" suffixes, or only what stands before the first " - "."""
    t = filled(title)
    for p in prefixes:
        t = F.when(F.startswith(t, F.lit(p)), F.trim(F.substring(t, len(p) + 1, 1 << 30))).otherwise(t)
    for s in suffixes:
        t = F.regexp_replace(t, rf"\s+-\s+{s}\s*$", "")
    return F.trim(F.substring_index(t, " - ", 1)) if first_part else F.trim(t)


def query_encoded(phrase: Column) -> Column:
    """A phrase in quotation marks, percent-encoded."""
    return F.replace(F.url_encode(F.concat(F.lit('"'), phrase, F.lit('"'))), F.lit("+"), F.lit("%20"))


def json_object(text: Column) -> Column:
    """The last valid JSON object of a text: of fenced blocks, else of braces nested once, else the outermost braces."""
    t = filled(text)
    valid = lambda a: F.element_at(F.filter(F.reverse(a), lambda x: F.try_parse_json(x).isNotNull()), 1)
    # The two patterns in which answers carry objects.
    fenced = F.regexp_extract_all(t, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    braces = F.regexp_extract_all(t, F.lit(r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), F.lit(0))
    outer = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    first = lambda a: F.when(F.size(F.filter(a, lambda x: F.try_parse_json(x).isNotNull())) > 0, valid(a))
    return F.coalesce(first(fenced), first(braces), outer)


def clean_brief(answer: Column) -> Column:
    """A model's summary without tags, thoughts, labels and quotation marks."""
    t = filled(answer)
    tagged = F.trim(F.regexp_extract(t, r"(?is)<summary>(.*?)</summary>", 1))
    plain = (tagged != "") & ~F.contains(tagged, F.lit("Analyze the Request")) & ~F.contains(tagged, F.lit("Internal Monologue"))
    told = F.regexp_replace(t, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    monologue = reduce(lambda a, b: a | b, (F.contains(told, F.lit(m)) for m in MONOLOGUE_MARKS))
    attempts = F.regexp_extract_all(told, F.lit(r"Attempt\s*\d+:\*?\s*([^\n\r]+)"), F.lit(1))
    lines = F.filter(F.transform(F.split(told, "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(rf"(?i)^(\d+\.|\*)\s*\*\*({_any(MONOLOGUE_HEADS)})") & ~F.startswith(x, F.lit("```")) & ~F.startswith(x, F.lit("Attempt")))
    body = F.when(~monologue, told).when(F.size(attempts) > 0, F.trim(F.element_at(attempts, F.greatest(F.size(attempts), F.lit(1))))).otherwise(F.array_join(lines, " "))
    body = F.regexp_replace(squashed_ends(body), rf"(?iuU)^({_any(SUMMARY_LABELS)})\s*", "")
    return F.when(t == "", "").when(plain, tagged).otherwise(F.regexp_replace(body, '^["` ]+|["` ]+$', ""))


def squashed_ends(c: Column) -> Column:
    """c without white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
