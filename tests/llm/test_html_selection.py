"""What density selects, with and without elements that a page names as its article."""

import os
import random
import re
import time

import pytest

from quillstream.llm import htmltext

SF = "/root/testdata/sf0.1"
W = " ".join(["Enough words of an article."] * 8)
LINKS = "".join(f"<li><a href='/{i}'>Another story's headline {i}</a>" for i in range(5))
CARDS = "".join(f"<div><a href='/{i}'>Teaser {i} with its title</a><p>What story {i} says.</p></div>" for i in range(5))
NAMED_CARDS = "".join(f"<article><h3><a href='/{i}'>Teaser {i} with its title</a></h3><p>What story {i} says, at some length, as cards do.</p></article>" for i in range(5))


@pytest.mark.parametrize(
    "body, expected",
    [
        (f"<div class='story'><h1>Title</h1><p class='lead'>A lead of one sentence.</p><div class='body'><p>{W}</p><p>{W}</p></div></div>", ["Title", "A lead of one sentence.", W, W]),
        (f"<div class='story'><div><h1>Title</h1></div><div class='lead'>A lead of one sentence.</div><div><div class='body'><p>{W}</p><p>{W}</p></div></div></div>", ["Title", "A lead of one sentence.", W, W]),
        (f"<div class='logo'>The site's own name</div><div><p>A lead of one sentence.</p><div><p>{W}</p><p>{W}</p></div><p>An end.</p></div>", ["A lead of one sentence.", W, W, "An end."]),
        (f"<main><article><h1>Title</h1><p>{W}</p><p>{W}</p></article><div class='more-stories'>{CARDS}</div></main>", ["Title", W, W]),
        (f"<main><h1>Title</h1><article><p>{W}</p><p>{W}</p></article><ul class='headlines'>{LINKS}</ul></main>", ["Title", W, W]),
        (f"<main><h1>Title</h1><p>{W}</p><ul class='headlines'>{LINKS}</ul><p>{W}</p></main>", ["Title", W, W]),
        (f"<article><h1>A</h1><p>{W}</p><p>{W}</p><p>{W}</p></article><article><h2>B</h2><p>A short one.</p></article>", ["A", W, W, W, "B", "A short one."]),
        (f"<div class='story'><h1>Title</h1><p>{W}</p><p>{W}</p></div><div>{NAMED_CARDS}</div>", ["Title", W, W]),
        (f"<article><h1>A</h1><p>{W}</p></article>{NAMED_CARDS}", ["A", W]),
        *(
            (f"<div class='post'><h1>Title</h1><p>{W}</p><p>{W}</p></div><div {mark}><p>{W}</p></div>", ["Title", W, W])
            for mark in ("id='reader-comments'", "class='fb-comments'", "class='subscribe-now'", "class='outbrain'", "class='disclosure-advert'", "id='cookie-wall'", "class='newsletterBox'")
        ),
    ],
)
def test_selection(body, expected):
    assert htmltext.main_text(f"<html><body><nav><a href='/'>Menu</a></nav>{body}<footer>Foot</footer></body></html>") == "\n\n".join(expected)


def plain_subtree(node, least, parents=()):
    """The outermost node around the largest sum that passes the threshold, recursively."""
    below = [x for x in node.children if not isinstance(x, str) and not x.drop]
    return max([node, *(plain_subtree(x, least) for x in below)], key=lambda x: x.total)


def test_the_subtree_of_the_largest_sum_is_picked():
    r = random.Random(4)

    def some(depth):
        name = r.choice(["div", "section", "div", "span", "a href=x"])
        inner = "".join(r.choice([f"<p>{W[: r.randint(0, 220)]}</p>", some(depth - 1) if depth else "words"]) for _ in range(r.randint(1, 4)))
        return f"<{name}>{inner}</{name.split()[0]}>"

    for _ in range(300):
        root = htmltext.parse(f"<body>{some(4)}{some(3)}</body>")
        htmltext.measure(root)
        body = root.children[0]
        best = max(htmltext.descendants(root), key=lambda x: x.total)
        if best in (root, body) or not root.chars:
            continue
        way, x = [], best
        while x is not body:
            way.append(x)
            x = x.parent
        least = min(x.density for x in way)
        top = next(x for x in reversed(way) if x.chars and x.density >= least)
        picked = htmltext.by_density(body, best, least)
        assert picked is (plain_subtree(top, least) if top.total else top)


def test_time_is_linear_in_depth():
    def took(n):
        start = time.process_time()
        assert htmltext.main_text("<body>" + "<div><li>" * n + f"<p>{W}").endswith(W)
        htmltext.main_text("<body><i><div>" + "<b>" * n + "</i></section></p>" * n)
        htmltext.main_text("<body>" + "<article><h2><a>x</a></h2>" * n)
        return time.process_time() - start

    few, many = took(5_000), took(50_000)
    assert many < 25 * max(few, 0.1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_nothing_is_lost_without_named_elements(spark):
    """All test pages name their article; with those names gone, density finds all of it."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(600).collect()]
    for html in pages:
        named = htmltext.main_text(html).split("\n\n")
        bare = htmltext.main_text(re.sub(r"(</?)(article|main)(?=[\s>])", r"\1div", html)).split("\n\n")
        assert set(named) <= set(bare)
