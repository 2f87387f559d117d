"""Dates of feeds, cards and texts. The present moment is always a parameter, `as_of` ('yyyy-MM-dd HH:mm:ss').

All results are text in that form, or null; nothing that fails to parse raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import filled

FORM = "yyyy-MM-dd HH:mm:ss"
# Turkish months and their spellings in ASCII.
MONTHS = {"ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "agustos": 8, "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12}
TITLE_MONTHS = {k: v for k, v in MONTHS.items() if k not in ("subat", "mayis", "eylul", "kasim", "aralik")}
_NUMBERS = r"^\d+$"


def _stamp(c: Column, form: str) -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit(form)), FORM)


def _made(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """A moment of numbers, null if there is none such."""
    text = F.format_string("%04d-%02d-%02d %02d:%02d:00", *(F.coalesce(x, F.lit(-1)) for x in (year, month, day, hour, minute)))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), _stamp(text, FORM))


def _int(c: Column) -> Column:
    return F.when(c.rlike(_NUMBERS), c.try_cast("int"))


def _month(name: Column, months: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in months.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.translate(name, "İI", "iı")))


def clock_in(text: Column, as_of: str) -> Column:
    """The first HH:MM or H.MM of a text, on the day of as_of; else null."""
    found = F.regexp_extract(filled(text), r"\b([0-2]?\d[:.][0-5]\d)\b", 1)
    return F.when(found != "", F.concat(F.lit(as_of[:10] + " "), F.lpad(F.replace(found, F.lit("."), F.lit(":")), 5, "0"), F.lit(":00")))


def rfc822(raw: Column, zone: str = "UTC") -> Column:
    """A date as in mail headers, in the wall-clock time of a zone."""
    t = F.regexp_replace(F.trim(filled(raw)), r"^[A-Za-z]{3,},?\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s(GMT|UTC|UT|Z)$", " +0000"), r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})( [+-])", "$1:00$2")
    moment = F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), moment.cast("timestamp_ntz")), FORM)


def iso(raw: Column) -> Column:
    """An ISO date; fraction and Z are cut off, an offset is dropped, nothing is shifted."""
    t = F.replace(F.substring_index(F.trim(filled(raw)), ".", 1), F.lit("Z"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, r"(\d{2}:\d{2})[+-]\d{2}:?\d{2}$", "$1"), r"^(\d{4}-\d{2}-\d{2})[T ]", "$1 ")
    return F.coalesce(_stamp(t, FORM), _stamp(t, "yyyy-MM-dd HH:mm"), _stamp(t, "yyyy-MM-dd"))


def dotted(raw: Column) -> Column:
    t = F.trim(filled(raw))
    return F.coalesce(_stamp(t, "d.M.yyyy HH:mm:ss"), _stamp(t, "d.M.yyyy HH:mm"))


def feed_date(raw: Column, title: Column, as_of: str, zone: str = "UTC") -> Column:
    """Date of a feed entry: a date said in the title, else mail, ISO or dotted form, else as_of."""
    return F.coalesce(title_date(title, as_of), rfc822(raw, zone), iso(raw), dotted(raw), F.lit(as_of))


def pipeline_date(raw: Column, as_of: str, zone: str = "UTC") -> Column:
    """Date of an item on its way in; as_of if it has none or a later one."""
    return F.least(F.coalesce(rfc822(raw, zone), iso(raw), dotted(raw), F.lit(as_of)), F.lit(as_of))


def with_title_time(date: Column, title: Column) -> Column:
    """date at midnight takes the time that its title starts with; hours over 23 don't count."""
    hour, minute = (_int(F.regexp_extract(filled(title), r"^([0-2]?\d)[:.]([0-5]\d)\s*[-–—:]?\s*", i)) for i in (1, 2))
    time = F.format_string("%s %02d:%02d:00", F.substring(date, 1, 10), hour, minute)
    return F.when((F.substring(date, 12, 8) == "00:00:00") & (hour <= 23), time).otherwise(date)


def title_date(title: Column, as_of: str) -> Column:
    """`dd Month [yyyy]` of a title at noon, the year of as_of by default, if not after as_of."""
    pattern = rf"(?iuU)\b([0-3]?\d)\s+({'|'.join(m.capitalize() for m in TITLE_MONTHS)})\s*(\d{{4}})?\b"
    day, month, year = (F.regexp_extract(filled(title), pattern, i) for i in (1, 2, 3))
    made = _made(F.coalesce(_int(year), F.lit(int(as_of[:4]))), _month(month, TITLE_MONTHS), _int(day), F.lit(12), F.lit(0))
    return F.when(made <= as_of, made)


def text_date(text: Column) -> Column:
    """`dd Month yyyy [HH:MM]` anywhere in a text, else dd.mm.yyyy with ., / or -; noon by default."""
    clock = r"(?:\s+([0-2]?\d)[:.]([0-5]\d))?\b"
    named = rf"(?iuU)\b([0-3]?\d)\s+({'|'.join(m.capitalize() for m in MONTHS)})\s+(\d{{4}}){clock}"
    plain = rf"\b([0-3]?\d)[./-]([0-1]?\d)[./-](\d{{4}}){clock}"
    t = filled(text)

    def made(pattern: str, month) -> Column:
        g = [F.regexp_extract(t, pattern, i) for i in range(1, 6)]
        return _made(_int(g[2]), month(g[1]), _int(g[0]), F.coalesce(_int(g[3]), F.lit(12)), F.coalesce(_int(g[4]), F.lit(0)))

    return F.coalesce(made(named, lambda m: _month(m, MONTHS)), made(plain, _int))


def parse_date(raw: Column) -> Column:
    """A date of page metadata: fraction, offset and Z are cut off, T is a blank."""
    t = F.regexp_replace(F.substring_index(filled(raw), ".", 1), r"([+-]\d{2}):?(\d{2})$", "")
    t = F.trim(F.translate(t, "TZ", " "))
    forms = (FORM, "yyyy-MM-dd HH:mm", "d.M.yyyy HH:mm:ss", "d.M.yyyy HH:mm", "yyyy/M/d HH:mm:ss")
    return F.coalesce(*(_stamp(t, f) for f in forms))


def relative_date(raw: Column, as_of: str) -> Column:
    """as_of less so many minutes, hours or days; null without a number of them."""
    t = F.lower(filled(raw))
    seconds = None
    for pattern, unit in ((r"(\d+)\s*(?:dak|min)", 60), (r"(\d+)\s*(?:saat|hour|hr)", 3600), (r"(\d+)\s*(?:gün|day)", 86400)):
        found = F.regexp_extract(t, pattern, 1)
        one = F.when(found != "", found.try_cast("bigint") * unit)
        seconds = one if seconds is None else F.coalesce(seconds, one)
    moment = F.lit(as_of).cast("timestamp")
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(moment) - seconds), FORM)


def search_date(iso_date: Column, said: Column, title: Column, as_of: str) -> Column:
    """Date of a search result: said in the title, else ISO, else relative, else as_of."""
    return F.coalesce(title_date(title, as_of), iso(iso_date), relative_date(said, as_of), F.lit(as_of))


def parse_time(raw: Column) -> Column:
    """The first 19 characters as a timestamp, or null."""
    return F.try_to_timestamp(F.substring(raw, 1, 19), F.lit(FORM))


def section_time(raw: Column, date: Column) -> Column:
    """struct<title, publish_date> of `Section / HH:MM[ - ]Title`: the time replaces the date's own."""
    pattern = r"^[^/]{1,40}/\s*([0-2]?\d)[:.]([0-5]\d)\s*[-–—]?\s*(.+)$"
    hour, minute, title = (F.regexp_extract(filled(raw), pattern, i) for i in (1, 2, 3))
    has = (title != "") & (_int(hour) <= 23)
    return F.struct(F.when(has, title).otherwise(filled(raw)).alias("title"), F.when(has, F.concat(F.substring(date, 1, 10), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(":00"))).otherwise(date).alias("publish_date"))
