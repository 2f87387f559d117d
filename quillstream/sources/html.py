"""Pages as rows: article bodies, publication dates and cards, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates
from quillstream.functions.text import filled, squashed
from quillstream.operators.stages import short_batches

# What pages are searched for.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe")
WIDGET_PHRASES = ("çerez", "cookie", "takip et", "abone ol", "paylaş", "yorum yap", "tıklayın", "okumak için", "kabul ediyorum", "daha fazla")
BODY_CLASSES = ("article-body", "article-content", "news-content", "story-body", "post-content", "entry-content", "detay-icerik", "news-detail", "detay_icerik")
DATE_METAS = (("property", "article:published_time"), ("name", "article:published_time"), ("name", "datePublished"), ("name", "datepublished"), ("itemprop", "datePublished"), ("property", "og:published_time"), ("name", "publish-date"), ("name", "publication_date"), ("name", "release-date"), ("property", "og:release_date"))
DATE_CLASSES = ("date", "tarih", "news-date", "post-date", "entry-date", "haber-tarih", "time", "info-date", "detay-tarih")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEAST_BODY, WIDGET_CHARS, LEAD_CHARS = 100, 35, 1500


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Element | None) -> None:
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self, without: tuple[str, ...] = ()) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.name not in without:
                stack += reversed(e.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, dict(attrs), self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent and e.name != tag:
            e = e.parent
        if e.parent:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Element:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    for e in parser.root.walk():
        e.parent = None  # without cycles a page's tree goes as soon as it is read
    return parser.root


def body_text(root: Element) -> str:
    """Paragraphs of the article, or of what looks like one, without short widgets; empty up to 100 characters."""
    dropped = {id(x) for e in root.walk() if e.name in DROPPED for x in e.walk()}
    rest = [e for e in root.walk() if id(e) not in dropped]
    looks = re.compile("|".join(BODY_CLASSES), re.I)
    target = next((e for e in rest if e.name == "article"), None) or next((e for e in rest if any(looks.search(c) for c in e.classes())), root)
    blocks = [e.text(DROPPED).strip() for e in target.walk() if e.name == "p" and id(e) not in dropped]
    blocks = [b for b in blocks if b and not (len(b) < WIDGET_CHARS and any(w in b.lower() for w in WIDGET_PHRASES))]
    text = re.sub(r"\s+", " ", " ".join(blocks).strip())
    return text if len(text) > LEAST_BODY else ""


def date_candidates(root: Element) -> list[tuple[str, str]]:
    """What may say a page's date, in order of trust: (`meta`, value) to parse as a date, (`text`, value) to search."""
    out: list[tuple[str, str]] = []
    metas = [e.attrs for e in root.walk() if e.name == "meta"]
    found = next((m for key, value in DATE_METAS for m in metas if m.get(key) == value), None)
    if found and found.get("content"):
        out.append(("meta", found["content"].strip()))
    for e in root.walk():
        if e.name == "script" and e.attrs.get("type") == "application/ld+json":
            try:
                data = json.loads(e.text())
            except ValueError:
                continue
            if isinstance(data, dict):
                graph = [x for x in data.get("@graph") or [] if isinstance(x, dict)]
                said = next((v for x in (data, *graph) for v in (x.get("datePublished"), x.get("dateCreated")) if v), None)
                if said:
                    out.append(("meta", str(said)))
    for e in root.walk():
        if e.name == "time":
            if e.attrs.get("datetime"):
                out.append(("meta", e.attrs["datetime"]))
            out.append(("text", e.text()))
    for c in DATE_CLASSES:
        out += [("text", e.text()) for e in root.walk() if c in e.classes()]
    body = next((e for e in root.walk() if e.name == "body"), None)
    if body:
        out.append(("text", body.text()[:LEAD_CHARS]))
    return out


def bodies(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with body and page_date ('yyyy-MM-dd HH:mm:ss' or null); dates are parsed by the JVM, in order of trust."""
    short_batches(pages.sparkSession)
    kind = "body string, metas array<struct<kind: string, value: string>>"

    @F.pandas_udf(kind)
    def read(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for h in batch:
            root = tree(h)
            rows.append((body_text(root), [{"kind": k, "value": v} for k, v in date_candidates(root)]))
        return pd.DataFrame(rows, columns=["body", "metas"])

    out = pages.withColumn("_r", read.asNondeterministic()(filled(F.col(html))))
    said = F.transform("_r.metas", lambda m: F.when(m["kind"] == "meta", dates.parse_date(m["value"])).otherwise(dates.text_date(m["value"])))
    return out.withColumn("body", F.col("_r.body")).withColumn("page_date", F.element_at(F.array_append(F.array_compact(said), F.lit(None).cast("string")), 1)).drop("_r")


def paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with body as body_text() gives it, by patterns alone: for pages whose paragraphs don't nest."""
    h = F.regexp_replace(filled(F.col(html)), rf"(?is)<({'|'.join(DROPPED)})\b[^>]*>.*?</\1\s*>", " ")
    article = F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    h = F.when(article != "", article).otherwise(h)
    ps = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|$)"), F.lit(1)), lambda p: squashed(F.regexp_replace(p, "<[^>]+>", "")))
    widget = lambda p: (F.length(p) < WIDGET_CHARS) & F.lower(p).rlike("|".join(WIDGET_PHRASES))
    text = F.array_join(F.filter(ps, lambda p: (p != "") & ~widget(p)), " ")
    return pages.withColumn("body", F.when(F.length(text) > LEAST_BODY, text).otherwise(""))


@dataclass(frozen=True)
class CardSpec:
    """How one site's cards are read. card, title, summary: class patterns (card also takes element names)."""

    source: str
    base: str
    card: str = r"card|news|item|article"
    title: str = r"title|headline"
    summary: str = r"summary|desc|spot"
    link: str = "."
    least_title: int = 15
    cards: int = 30


@dataclass(frozen=True)
class SiteCards:
    """How one site's list pages are read, by exact names: cards are elements of these names or classes, and anchors whose
    address holds one of `hrefs`, in page order, the first `cards` of them. A card's link must hold one of `links`, if
    any are given, and its title, the first element of `titles` or else the link's text, be longer than `longer`."""

    source: str
    base: str
    classes: tuple[str, ...] = ()
    elements: tuple[str, ...] = ()
    hrefs: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    titles: tuple[str, ...] = ("h2", "h3", "h4", "strong")
    summary: bool = True
    longer: int = 10
    cards: int = 20
    skip: tuple[str, ...] = ()


def _site_cards(root: Element, spec: SiteCards) -> Iterator[tuple[str, str, str, str]]:
    def is_card(e: Element) -> bool:
        if e.name in spec.elements or any(c in spec.classes for c in e.classes()):
            return True
        return e.name == "a" and any(h in (e.attrs.get("href") or "") for h in spec.hrefs)

    def first(e: Element, names: tuple[str, ...]) -> Element | None:
        return next((x for x in e.walk() if x is not e and x.name in names), None)

    for card in [e for e in root.walk() if is_card(e)][: spec.cards]:
        anchor = card if card.name == "a" else first(card, ("a",))
        if anchor is None or not anchor.attrs.get("href"):
            continue
        link = anchor.attrs["href"]
        link = link if link.startswith("http") else spec.base + link
        title = re.sub(r"\s+", " ", (first(card, spec.titles) or anchor).text()).strip()
        said = first(card, ("p",)) if spec.summary else None
        if len(title) > spec.longer and (not spec.links or any(x in link for x in spec.links)) and not any(x in title.lower() for x in spec.skip):
            yield link, title, re.sub(r"\s+", " ", said.text()).strip() if said else "", card.text()


def cards(pages: DataFrame, specs: list[CardSpec | SiteCards], as_of: str, html: str = "html", source: str = "source_name") -> DataFrame:
    """source_name, ord, link, title, summary, publish_date of the first cards of each page that the site's spec takes.

    Links are made absolute by the site's base; the date is a clock time in the card, on the day of as_of."""
    short_batches(pages.sparkSession)
    by_source = {s.source: s for s in specs}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, h in zip(batch[source], batch[html], strict=True):
                spec = by_source.get(name)
                if spec:
                    out += [(name, i, *c) for i, c in enumerate((_cards if isinstance(spec, CardSpec) else _site_cards)(tree(h), spec))]
            yield pd.DataFrame(out, columns=["source_name", "ord", "link", "title", "summary", "said"])

    found = pages.select(source, html).mapInPandas(read, "source_name string, ord long, link string, title string, summary string, said string")
    return found.withColumn("publish_date", F.coalesce(dates.clock_in(F.col("said"), as_of), F.lit(as_of))).drop("said")


def _cards(root: Element, spec: CardSpec) -> Iterator[tuple[str, str, str, str]]:
    like = lambda e, pattern: any(re.search(pattern, c, re.I) for c in e.classes())
    found = [e for e in root.walk() if like(e, spec.card) or e.name == "article"][: spec.cards]
    for card in found:
        anchor = next((e for e in card.walk() if e.name == "a" and e.attrs.get("href")), None)
        if anchor is None:
            continue
        link = anchor.attrs["href"].strip()
        link = link if re.match(r"https?://", link) else spec.base.rstrip("/") + "/" + link.lstrip("/")
        head = next((e for e in card.walk() if like(e, spec.title) or e.name in ("h1", "h2", "h3", "h4")), anchor)
        title = re.sub(r"\s+", " ", head.text()).strip()
        said = next((e for e in card.walk() if like(e, spec.summary)), None)
        if len(title) >= spec.least_title and re.search(spec.link, link):
            yield link, title, re.sub(r"\s+", " ", said.text()).strip() if said else "", card.text()
