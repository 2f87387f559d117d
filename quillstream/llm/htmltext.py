"""Main text of web pages by composite text density.

For each node of the DOM: characters per tag, adjusted by its links; a node's density sum is the sum over its
children. The body-path threshold is the least density on the way from the node of the largest sum up to the body;
the subtree of the largest sum under a node that passes it is the content. It stands for the article around it, or is
joined by the heading and leads beside it."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, with_columns

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(id|class|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never belong to an article's text.
DROPPED = frozenset("head nav footer aside form script style title textarea noscript template iframe button select input object embed canvas svg math dialog menu noembed noframes xmp audio video map datalist label fieldset search".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that end an open one of their own group, and what stops the search for it.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",))}
#: Words of class, id and role that mark what isn't the article, if a name holds nothing else but neutral words.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall menu menus nav navbar navigation breadcrumb breadcrumbs crumbs pagination pager toolbar sidebar sidebars aside rail widget widgets related recommended recommendations trending popular share sharing social follow header masthead topbar footer foot bottombar copyright disclaimer comment comments commentlist respond reply replies discussion disqus feedback search searchform form skip toc tags taglist hidden complementary contentinfo outbrain taboola".split())
NEUTRAL = frozenset("a an the and of on in for to my site page main global local area bar block blocks body bottom box boxes button buttons btn card cards col column container content contents cta div element entry entries field fields fixed group header heading inner input item items js label left line link links list lists module mobile outer panel post posts article articles story stories right row section sections side slot sticky text title top unit user users view wrap wrapper zone desktop small large first last primary secondary icon icons dfp google".split())
#: Marks that also name the part of an article with its title.
HEADS = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: What an article's text beside its largest part is in, and elements in which a paragraph may be left open.
PROSE = frozenset("p blockquote ul ol dl pre table figure h1 h2 h3 h4 h5 h6".split())
HOLDS_P = frozenset("td th button caption".split())
#: Marks that count beside any other words of a name.
CLEAR = frozenset("advert adverts advertisement advertising adsense adbox adslot sponsored outbrain taboola cookie cookies gdpr consent newsletter subscribe subscription comments commentlist disqus breadcrumb breadcrumbs".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[a-z])(?=[0-9])")
ARTICLE = frozenset(("article", "main"))
#: Elements that are dropped unless they enclose the article, as are those with MARKS.
WRAPPERS = frozenset(("form", "fieldset"))


class Node:
    __slots__ = ("name", "parent", "children", "drop", "maybe", "head", "main", "inner", "chars", "links", "link_chars", "tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, main: bool = False) -> None:
        self.name, self.parent, self.drop, self.maybe, self.head, self.main = name, parent, drop, False, False, main
        self.inner = main or parent is not None and parent.inner
        self.children: list[Node | str] = []


def marks(value: str) -> set[str]:
    """The marks in an attribute's names; a name with other words than marks and neutral ones has none."""
    found: set[str] = set()
    for name in value.split():
        words = {x.lower() for x in SPLIT.split(name) if x and not x.isdigit()}
        if words - MARKS <= NEUTRAL:
            found |= words & MARKS
        elif words & CLEAR:
            found |= words & CLEAR
        elif (whole := name.lower()) in MARKS:
            found.add(whole)
    return found


def marked(rest: str) -> tuple[bool, set[str], bool]:
    """Whether the attributes say that an element is hidden, by what it isn't part of the article, or whether it is the main part."""
    main, found = False, set()
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, set(), False
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, set(), False
        elif key == "role" and value.lower() == "main":
            main = True
        else:
            found |= marks(value)
    return False, found, main and not found


class Open:
    """The open elements of a page, and where each name stands among them: every tag costs what it opens or closes, so
    that deep pages take linear time."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Closes all from place k on."""
        while len(self.stack) > k:
            self.at[self.stack.pop().name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, names) -> int:
        return max((places[-1] for x in names if (places := self.at.get(x))), default=0)

    def before(self, name: str) -> None:
        """Closes what ends where an element of this name begins: paragraphs, list items and cells have no end tag."""
        if name in ENDS_P and (k := self.last(("p",))) > self.last(HOLDS_P):
            self.cut(k)
        if name in SIBLINGS:
            group, stops = SIBLINGS[name]
            stop = self.last(stops)
            open_ = [places[k] for x in group if (places := self.at.get(x)) and (k := bisect_right(places, stop)) < len(places)]
            if open_:
                self.cut(min(open_))

    def end(self, name: str) -> None:
        k = self.last((name,))
        # an end tag of an inline element doesn't end a block
        if k and (name in BLOCKS or not self.blocks or self.blocks[-1] <= k):
            self.cut(k)


def parse(html: str) -> Node:
    """The tree of a page. Elements that don't belong to an article are kept, marked `drop`."""
    root = Node("#root", None)
    open_ = Open(root)
    at, find, n = 0, TOKEN.search, len(html)
    while at < n:
        m = find(html, at)
        if not m:
            open_.stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            open_.stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, rest = name.lower(), m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            open_.end(name)
            continue
        open_.before(name)
        node = open_.stack[-1]
        drop, found, main = marked(rest) if rest and "=" in rest or "hidden" in rest else (False, set(), False)
        if name in ("html", "body", "article", "main"):
            drop, found = False, set()
        within_main = node.inner
        if name == "header" and not within_main:
            found = found | {"header"}
        drop = drop or name in DROPPED and name not in WRAPPERS
        child = Node(name, node, drop, main or name in ARTICLE)
        child.maybe = not drop and (bool(found) or name in WRAPPERS)
        # a page's header is dropped; one inside its article, or beside it below the body, may have the title
        child.head = bool(found) and found <= HEADS and (within_main or node.name != "body")
        node.children.append(child)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            at = (html.find(">", end.end()) + 1 or n) if end else n
        elif name not in VOID and not (rest.endswith("/") and name in ("svg", "path")):
            open_.push(child)
    weigh(root)
    return root


def weigh(root: Node) -> None:
    """Drops what is marked, or is a form, unless it holds most of the characters outside links of the article around it
    (of the page, if that names no article), or the largest article that isn't inside another one (comments are). A
    header that has a heading outside links stays, where it isn't the page's own."""
    order, stack = [], [(root, root, False, False)]
    while stack:
        node, frame, linked, nested = stack.pop()
        order.append((node, frame, linked, nested))
        frame, nested = (node, True) if node.main else (frame, nested)
        stack += [(x, frame, linked or node.name == "a", nested) for x in node.children if isinstance(x, Node) and not x.drop]
    if not any(node.maybe for node, *_ in order):
        return
    held, titled, mains = {}, set(), []
    for node, _, linked, nested in reversed(order):
        kids = [x for x in node.children if isinstance(x, Node) and not x.drop]
        own = 0 if linked or node.name == "a" else sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        held[node] = own + sum(held[x] for x in kids)
        if node.name in HEADINGS and held[node] or any(x in titled for x in kids):
            titled.add(node)
        if node.main and held[node] and not nested:
            mains.append(node)
    top = max(mains, key=held.__getitem__, default=None)
    around = {top, *path(top)} if top else set()
    for node, frame, _, _ in order:
        keep = node in around or node.head and node in titled or 2 * held[node] > held[frame] and (frame is not root or not top)
        node.drop = node.drop or node.maybe and not keep


def measure(root: Node) -> None:
    """Characters, tags and links of every kept node, then its density and the sum of its children's."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and not x.drop]
    for node in reversed(order):
        node.chars = node.links = node.link_chars = node.tags = 0
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.drop:
                node.chars += x.chars
                node.links += x.links
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
        if node.name == "a":
            node.links, node.link_chars = node.links + 1, node.chars
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.links, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            odds = c / max(lc, 1) * t / lt
            node.density = c / t * (math.log(odds) / base if odds > 1 else 0.0)
        node.total = sum(x.density for x in node.children if isinstance(x, Node) and not x.drop)


def descendants(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in reversed(x.children) if isinstance(y, Node) and not y.drop]


def path(node: Node) -> Iterator[Node]:
    while node.parent:
        node = node.parent
        yield node


def kids(node: Node) -> list[Node]:
    return [x for x in node.children if isinstance(x, Node) and not x.drop]


def prose(node: Node) -> bool:
    """Whether a node has text, most of it outside links."""
    return node.chars > 2 * node.link_chars


def is_card(node: Node) -> bool:
    """Whether an article's headings are links: it then points to another page's text."""
    stack = [(node, False)]
    while stack:
        x, linked = stack.pop()
        if x.name in HEADINGS and x.chars and (linked or 2 * x.link_chars > x.chars):
            return True
        stack += [(y, linked or x.name == "a") for y in kids(x)]
    return False


def by_density(body: Node, best: Node, least: float) -> Node:
    """The subtree of the largest sum in the outermost node around `best` that passes the threshold."""
    around = {best, *path(best)}
    node = body
    while (node is body or not node.chars or node.density < least) and node is not best:
        node = next(x for x in kids(node) if x in around)
    return max(descendants(node), key=lambda x: x.total) if node.total else node


def content(root: Node) -> list[Node]:
    """The roots of the content, in page order.

    Density picks a subtree. Articles of the page that hold it, or that hold most of its text, stand for it, with any
    others that are prose: a page's short article is as whole as its long one, but a card that links elsewhere is none. In a main part or a body without articles the lists of links go. Else headings and leads beside the subtree join it."""
    measure(root)
    if not root.chars:
        return []
    best = max(descendants(root), key=lambda x: x.total)
    least, body = best.density, best
    while body.parent and body.name not in ("body", "html"):
        least, body = min(least, body.density), body.parent
    picked = best if best is body else by_density(body, best, least)
    own = lambda y: y.chars - y.link_chars
    up = {picked, *path(picked)}
    articles = list(outermost(body, "article"))
    around = [y for y in articles if y in up]
    below = [y for y in outermost(picked, "article") if prose(y)] if not around else []
    if around or 2 * sum(map(own, below)) > own(picked):
        found = {*around, *below}
        chosen = [y for y in articles if y in found or prose(y) and not is_card(y)]
        return [z for y in chosen for z in (*(() if any(x.name in HEADINGS for x in descendants(y)) else beside(y)[0]), y)]
    mains = [y for y in up if y.main and y is not body]
    if not mains:
        mains = [y for y in descendants(picked) if y.main and 2 * own(y) > own(picked)][:1]
    if mains:
        picked = max(mains, key=lambda y: y.chars)
    if mains or picked is body:
        for y in list(descendants(picked)):
            y.drop = y.drop or y is not picked and y not in up and y.name in BLOCKS and y.links > 1 and not prose(y)
        return [picked]
    before, after = beside(picked)
    return [*before, picked, *after]


def outermost(top: Node, name: str) -> Iterator[Node]:
    """Elements of a name with text that are in no other one below top, in page order."""
    stack = [top]
    while stack:
        x = stack.pop()
        if x.name == name and x.chars and x is not top:
            yield x
        else:
            stack += reversed(kids(x))


def beside(node: Node) -> tuple[list[Node], list[Node]]:
    """The heading before a node, on its own level or the nearest one above that has one, with the prose between them;
    and paragraphs after it on its level."""
    before: list[Node] = []
    after: list[Node] = []
    x, level = node, 0
    while x.parent and x.name not in ("body", "html"):
        all_ = kids(x.parent)
        place = next(i for i, y in enumerate(all_) if y is x)
        if not level and x.parent.name != "body":
            after = [y for y in all_[place + 1 :] if y.name in PROSE and prose(y)]
        titled = [i for i, y in enumerate(all_[:place]) if prose(y) and any(z.name in HEADINGS for z in descendants(y))]
        if titled:
            first = next((i for i in reversed(titled) if any(z.name == "h1" for z in descendants(all_[i]))), titled[-1])
            return [y for y in all_[first:place] if prose(y)] + before, after
        if x.parent.name != "body":
            before = [y for y in all_[:place] if y.name in PROSE and prose(y)] + before
        x, level = x.parent, level + 1
    return before, after


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node."""
    out, held, stack = [], [], [top]
    end = object()

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    while stack:
        x = stack.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is end:
            flush()
        elif x.name == "br":
            held.append(" ")
        elif not x.drop:
            if x.name in BLOCKS:
                flush()
                stack.append(end)
            stack += reversed(x.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """Blocks of a page's article, joined by two line feeds; empty if it has none."""
    if not html:
        return ""
    return "\n\n".join(b for top in content(parse(html)) for b in blocks(top))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text and n_chars (code points) in place of the html.

    A null or empty html, or one without words, gives an empty text. Every page stays, repeated ones too;
    columns that have the new names are replaced. Pages are handled one by one, of any length."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in batch], dtype=object)

    out = with_columns(pages, {text: run(F.coalesce(F.col(html), F.lit("")))}).drop(*({html} - {text}))
    return with_columns(out, {text: F.col(text), "n_chars": F.length(text).cast("long")})
