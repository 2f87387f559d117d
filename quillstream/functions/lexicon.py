"""Keyword lexicons as patterns: one form for Spark's Java regular expressions, one for RE2."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import bound

# Place names that are words too, and count only with a capital.
HOMONYMS = ("bakı", "barda", "gence", "laçın", "laçin", "fuzuli", "ağdam", "terter")
WEAK = ("tap", "btc")
# Phrases in which a keyword means something else.
FALSE_FRIEND_NAMES = ("karabağlar", "karabağ mahallesi", "karabağ caddesi", "karabağ sokak", "karabağ köyü")
FALSE_FRIEND_PHRASES = (
    r"\b(?:yerdeki|talihsiz|yaralı|genç|kavga|şiddet|video|haber)\s+gence\b",
    r"\bgence\s+(?:saldırdı|tekmeler|bağırdı|vurdu|dehşet|dayak|kavga)\b",
    r"\bbarda\s+(?:kavga|dehşet|olay|cinayet|silahlı|eğlenen|tartışma)\b",
    r"\bfuzuli\s+(?:olur|yere|masraf|masraflar|işgal|harcama|iş|bir|gör|görüldü|sayıldı|olarak)\b",
    r"\b(?:faydasız|gereksiz|yersiz|boş|anlamsız)\s+ve\s+fuzuli\b",
)
UNION_LABEL = "TDT / Türk Dünyası"
COUNTRIES = ("Azerbaycan", "KKTC", "Kazakistan", "Kırgızistan", "Özbekistan", "Türkmenistan")
_I = {"i": "[iıIİ]", "ı": "[iıIİ]", "I": "[iıIİ]", "İ": "[iıIİ]"}


def _word(keyword: str) -> tuple[str, bool]:
    """A keyword as it must be written, and whether case counts."""
    return (keyword[0].upper() + keyword[1:], True) if keyword.lower() in HOMONYMS else (keyword, False)


def java(*keywords: str) -> str:
    """A pattern that finds any of the keywords as whole words; letters i match in all their forms."""
    exact = [re.escape(w) for w, cased in map(_word, keywords) if cased]
    free = [re.escape(w) for w, cased in map(_word, keywords) if not cased]
    parts = ([f"(?-iu:{'|'.join(exact)})"] if exact else []) + free
    return rf"(?iuU)(?<!\w)(?:{'|'.join(parts)})(?!\w)" if parts else "(?!)"


def edged(pattern: str) -> str:
    r"""A Java pattern whose \b is where its \w begins or ends: before Java 19, \b goes by Unicode's letters even where \w
    is ASCII's."""
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return re.sub(r"(?s)\\(.)", lambda m: edge if m[1] == "b" else m[0], pattern)


def re2(*keywords: str) -> str:
    """The same for engines without look-behind; it also takes the characters at both sides."""
    parts = []
    for w, cased in map(_word, keywords):
        spelt = "".join(re.escape(c) if cased else _I.get(c, re.escape(c)) for c in w)
        parts.append(spelt if cased else f"(?i:{spelt})")
    return rf"(?:^|[^\pL\pN_])(?:{'|'.join(parts)})(?:[^\pL\pN_]|$)" if parts else r"[^\s\S]"


def fold(c: Column) -> Column:
    """Lower case in which all forms of i are one letter, as for `java`."""
    return F.lower(F.translate(c, "İIıſ", "iiis"))


def folded(word: str) -> str:
    return word.translate(str.maketrans("İIıſ", "iiis")).lower()


class Phrases:
    """Finds many words and phrases in one pass over a text, whatever their number.

    A text is split where words begin and end; its words, and the stretches of as many words as phrases have that begin
    with the first word of one, are intersected with the phrases by hash. They agree with `java`: stretches are compared with the separators in between, so whole words only,
    and words that need a capital with the text's own letters. Phrases that don't begin and end with a letter or digit
    can't be stretches and keep their patterns."""

    #: \w+ or \W+; naming ASCII letters and the blank first spares most characters the look-up in Unicode's tables.
    PARTS = r"(?U)[a-zA-Z0-9_\w]+|[ [^a-zA-Z0-9_\w]]+"

    def __init__(self, phrases: Iterable[str]) -> None:
        self.exact, self.free, self.odd = {}, {}, []
        for p in dict.fromkeys(phrases):
            word, cased = _word(p)
            parts = re.findall(r"\w+|\W+", p)
            if not re.fullmatch(r"\w(?s:.*\w)?", p) or cased and len(parts) > 1:
                self.odd.append(p)
            elif cased:
                self.exact[p] = "=" + word
            else:
                self.free[p] = folded(p)
        self.tokens = self.exact | self.free | {p: "~" + p for p in self.odd}
        parts = [re.findall(r"\w+|\W+", x) for x in self.free.values()]
        self.longer = sorted({len(x) for x in parts} - {1})
        self.firsts = sorted({x[0] for x in parts if len(x) > 1})

    def found(self, text: Column) -> Column:
        """The tokens of all phrases in a text, each once."""
        none = F.array().cast("array<string>")
        array = lambda xs: F.array(*map(F.lit, sorted(set(xs)))) if xs else none

        def stretches(parts: Column, begun: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_contains(begun, F.element_at(parts, i)))
            of = lambda n: lambda i: F.array_join(F.slice(parts, i, F.lit(n)), "")
            longer = bound(starts, lambda at: F.concat(*(F.transform(at, of(n)) for n in self.longer)))
            return F.when(F.size(begun) > 0, F.array_intersect(longer, array(self.free.values()))).otherwise(none)

        def all_(parts: Column) -> Column:
            out = [F.array_intersect(parts, array(self.free.values()))]
            if self.longer:
                out.append(bound(F.array_intersect(parts, array(self.firsts)), lambda begun: stretches(parts, begun)))
            if self.exact:
                words = [x[1:] for x in self.exact.values()]
                cased = F.transform(F.array_intersect(F.regexp_extract_all(text, F.lit(self.PARTS), 0), array(words)), lambda w: F.concat(F.lit("="), w))
                out.append(F.when(F.arrays_overlap(parts, array(map(folded, words))), cased).otherwise(none))
            return F.concat(*out)

        out = bound(F.coalesce(F.regexp_extract_all(fold(text), F.lit(self.PARTS), 0), none), all_)
        odd = [F.when(text.rlike(java(p)), F.lit("~" + p)) for p in self.odd]
        return F.concat(out, F.array_compact(F.array(*odd))) if odd else out

    def listed(self, found: Column, phrases: Iterable[str]) -> Column:
        """Those of some phrases that were found, in their order, repeated ones too."""
        phrases = list(phrases)
        if not phrases:
            return F.array().cast("array<string>")
        rows = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(self.tokens[p]).alias("t")) for p in phrases))
        hits = F.transform(F.filter(rows, lambda r: F.array_contains(found, r["t"])), lambda r: r["p"])
        return F.when(F.size(found) > 0, hits).otherwise(F.array().cast("array<string>"))

    def any(self, found: Column, phrases: Iterable[str]) -> Column:
        phrases = list(phrases)
        return F.arrays_overlap(found, F.array(*(F.lit(self.tokens[p]) for p in phrases))) if phrases else F.lit(False)


@dataclass(frozen=True)
class Lexicon:
    """Ordered word lists of a classifier. Order and repeated entries of `keywords` show in results.

    countries: name -> words; the first country's news get a topic, in the order of `topics`, of which those in
    `flagging` also count as words of that country. union: words of news that concern all countries."""

    keywords: tuple[str, ...]
    countries: dict[str, tuple[str, ...]]
    topics: dict[str, tuple[str, ...]] = field(default_factory=dict)
    flagging: tuple[str, ...] = ()
    default_topic: str = "Diplomasi & Siyaset"
    union: tuple[str, ...] = ()
    weak: tuple[str, ...] = WEAK
    masks: tuple[str, ...] = (*(java(x) for x in FALSE_FRIEND_NAMES), *("(?iuU)" + x for x in FALSE_FRIEND_PHRASES))
    window: int = 350

    @property
    def union_label(self) -> str:
        first, second, *rest = self.countries
        return f"{UNION_LABEL} ({', '.join([first, *rest, second])})"

    @classmethod
    def from_lines(cls, text: str, **lists) -> Lexicon:
        """keywords from a text with one on each line; blank lines and # comments don't count."""
        return cls(tuple(x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")), **lists)

    @classmethod
    def read(cls, path: str | Path = Path(__file__).with_name("lexicon.txt")) -> Lexicon:
        """A lexicon from a file with sections [keywords], [country name], [topic name] and [union], a word a line; by
        default the one of the Turkic countries. The words of the first two topics count as words of the first country."""
        lists: dict[str, list[str]] = {}
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            if line.startswith("["):
                words = lists.setdefault(line.strip("[]"), [])
            elif line.strip() and not line.startswith("#"):
                words.append(line.strip())
        of = lambda kind: {k.removeprefix(kind): tuple(v) for k, v in lists.items() if k.startswith(kind)}
        topics = of("topic ")
        return cls(tuple(lists["keywords"]), of("country "), topics, flagging=tuple(topics)[:2], union=tuple(lists.get("union", ())))
