"""Nulls, empty texts and tables, repeated rows and clashing columns, in every operator and pipeline stage."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, htmltext, language, lines, mixing, neardup, neighbours, secrets, suffixes, tokens
from quillstream.llm.queries import vocabulary

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here, but words enough for a shingle or two", "en", None, 5),
    (4, " \n\n ", "de", "b", 4),
    (5, LONG, "de", "b", 7),
    (6, LONG, "de", "b", 7),
    (7, "... !!! 123", None, "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators add, already there.
CLASH = ["n_tokens", "N_Bytes", "leak", "spans", "lang_pred", "score", "class_id", "keep", "n_dropped", "taken", "size", "k", "t", "label", "_key"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit("old").alias(c) for c in CLASH))


def benchmark(spark, rows=((1, "three four five six seven eight nine ten eleven twelve"), (2, None), (None, "one two"), (3, ""), (4, "no id here"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def operators(spark):
    model = language.fit([(t, lang) for _, t, lang, *_ in ROWS if t and lang])
    return {
        "tokens": lambda d: tokens.count_tokens(d, vocabulary()),
        "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark(spark)),
        "leaks": lambda d: decontaminate.find_leaks(d, benchmark(spark)),
        "mixing": mixing.mix,
        "suffixes": suffixes.remove_repeats,
        "suffix report": suffixes.repeat_report,
        "neardup": neardup.classify,
        "neardup drop": neardup.drop_near_duplicates,
        "lines": lines.dedup_lines,
        "secrets": secrets.scan,
        "redact": secrets.redact,
        "language": lambda d: language.identify(d, model),
        "language report": language.language_report,
    }


#: Rows that each leaves of ROWS.
LEFT = {"neardup drop": 7, "decontaminate": 7}


@pytest.mark.parametrize("name", ["tokens", "decontaminate", "leaks", "mixing", "suffixes", "suffix report", "neardup", "neardup drop", "lines", "secrets", "redact", "language", "language report"])
def test_rows_survive(spark, docs, clashing, name):
    f = operators(spark)[name]
    for d in (docs, clashing):
        assert len(f(d).collect()) == LEFT.get(name, len(ROWS))
    assert f(docs.limit(0)).collect() == []
    assert f(clashing.limit(0)).collect() == []


def test_values_of_odd_rows(spark, docs):
    n = {r.doc_id: r for r in tokens.count_tokens(docs, vocabulary()).collect()}
    assert (n[2].n_tokens, n[2].n_bytes, n[3].n_tokens) == (0, 0, 0)
    c = neardup.classify(docs).collect()
    assert {r.class_size for r in c if r.doc_id == 1} == {2} and all(r.keep for r in c if r.doc_id == 1)  # equal rows share a key
    assert {r.class_id for r in c if r.doc_id in (5, 6)} == {5}
    assert {r.class_id for r in c if r.doc_id in (2, 3, 4, 7)} == {2, 3, 4, 7}
    s = {r.doc_id: r for r in suffixes.repeat_report(docs).collect()}
    assert s[5].n_removed == s[5].n_bytes == len(LONG) and s[1].n_removed == 0
    first = {r.doc_id: r.text for r in suffixes.remove_repeats(docs).collect()}
    assert sorted((first[5], first[6])) == ["", LONG] and first[2] is None
    p = {r.doc_id: r for r in language.language_report(docs).collect()}
    assert p[2].lang_pred == p[3].lang_pred == p[7].lang_pred == "und" and p[7].score == 0
    m = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert m[2].taken == m[3].taken == m[4].taken == 0


def test_pipeline_stages_on_odd_rows(spark, docs, clashing, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (docs, clashing):
        for name, stage in corpus_pipeline.STAGES:
            for rows in (d, d.limit(0)):
                out = stage(spark, rows, str(tmp_path))
                got = out.collect()
                if d is clashing and name != corpus_pipeline.STAGES[-1][0]:
                    assert all(r[c] == "old" for r in got for c in CLASH)
                if name != corpus_pipeline.STAGES[-1][0]:
                    assert out.columns == d.columns


def test_near_copies_of_a_source_keep_their_lines(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r, stages = random.Random(3), dict(corpus_pipeline.STAGES)
    some = lambda n: " ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(n))
    site, article, rows = "All rights are with the site", [some(12) for _ in range(10)], []
    for i in range(100):
        copy = list(article)
        words = copy[k := r.randrange(10)].split()
        words[r.randrange(12)] = some(1)
        copy[k] = " ".join(words)
        rows.append((i, "\n".join([site, *copy]), "en", "hot", 0))
    rows += [(100 + i, "\n".join([site, some(40), some(30)]), "en", "hot", 0) for i in range(200)]
    # pages of another source that have little of their own
    stub = [some(30) for _ in range(10)]
    rows += [(500 + i, "\n".join([*stub, some(12)]), "en", "stubs", 0) for i in range(60)]
    d = stages["line_dedup"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    got = {x.doc_id: x.text for x in stages["near_dedup"](spark, d, str(tmp_path)).collect()}
    assert [i for i in got if i < 100] == [0]
    assert got == {i: "\n".join(t.split("\n")[10 if i >= 500 else 1 :]) for i, t, *_ in rows if i == 0 or i >= 100}


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "u", "x"), (2, "", "u", "x"), (3, "<p", None, "x"), (4, "plain &amp; text", "u", "x"), (4, "plain &amp; text", "u", "x")], "page_id long, html string, url string, n_chars string")
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract(pages).orderBy("page_id").collect()]
    assert got == [(1, "", 0), (2, "", 0), (3, "<p", 2), (4, "plain & text", 12), (4, "plain & text", 12)]
    assert htmltext.extract(pages.limit(0)).collect() == []
    clash = pages.withColumn("text", F.lit("old")).withColumn("N_CHARS", F.lit("old")).drop("n_chars")
    assert sorted((r.page_id, r.text, r.n_chars) for r in htmltext.extract(clash).collect()) == sorted(got)
    long = spark.createDataFrame([(1, "<body><article>" + "<p>word &amp; word</p>" * 60_000 + "</article>")], "page_id long, html string")
    assert htmltext.extract(long).first().text == "\n\n".join(["word & word"] * 60_000)


@pytest.mark.parametrize("wrap", ["<div class='content with-sidebar'><article>%s</article></div>", "<div id='page' class='header-fixed'><div>%s</div></div>", "<form id='aspnetForm'><div class='ad'>Buy</div>%s</form>", "<article><section class='share-enabled'>%s</section><div class='share'>Share it</div></article>", "<div class='has-sidebar'><div class='content'>%s</div><div class='sidebar'>Other things</div></div>"])
def test_marked_wrappers_keep_the_article(wrap):
    words = "<p>%s</p>" % " ".join(["Enough words of an article."] * 8)
    page = "<body><nav><a href='/'>Menu</a></nav>%s<form class='search'><label>Find</label></form><footer>Foot</footer></body>"
    assert htmltext.main_text(page % (wrap % (words * 2))) == "\n\n".join([" ".join(["Enough words of an article."] * 8)] * 2)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [float("nan"), 1.0]), (400, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [float("inf"), 0.0]), (4, [1.0]), (1, [1.0, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.neighbour_report(e).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert neighbours.neighbour_report(e.limit(0)).collect() == []
    clash = e.select("*", *(F.lit("old").alias(c) for c in ("id", "v", "list", "rank")))
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.neighbour_report(clash).orderBy("rank").collect()] == got
