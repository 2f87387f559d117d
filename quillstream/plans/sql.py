"""The operators' rules in DuckDB's SQL, for the oracles: written apart from the Spark expressions."""

from __future__ import annotations

from quillstream.functions.lexicon import Lexicon, re2
from quillstream.functions.text import ALERT_LABELS, ENTITIES, GENERIC_TITLES, JUNK_PHRASES, LONG_STOPWORDS, MONOLOGUE_HEADS, MONOLOGUE_MARKS, OUTDATED_PHRASES, OUTLET_SUFFIXES, SECTION_LABELS, SUMMARY_LABELS, TITLE_STOPWORDS, TRACKING_KEYS


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def texts(xs) -> str:
    return "[" + ", ".join(map(text, xs)) + "]"


def headline(c: str, labels: bool = True) -> str:
    out = rf"regexp_replace({c}, '^[0-2]?\d[:.][0-5]\d\s*[-–—:]?\s*', '')"
    if labels:
        out = rf"regexp_replace({out}, '(?i)^(?:{'|'.join(SECTION_LABELS)})\s*[-–—:]?\s*', '')"
    return rf"regexp_replace({out}, '(?i)\s*[-–—|]\s*(?:{'|'.join(OUTLET_SUFFIXES)}).*$', '')"


def title_key(c: str, labels: bool = True) -> str:
    return rf"regexp_replace(lower({headline(c, labels)}), '[^\pL\pN]', '', 'g')"


def words(c: str, stopwords=TITLE_STOPWORDS) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({headline(c)}), '[a-zA-ZğüşıöçĞÜŞİÖÇ0-9]{{3,}}')), lambda x: NOT list_contains({texts(stopwords)}, x))"


def folded_words(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(translate(lower({c}), 'ıöüşçğ', 'iouscg'), '[a-z]{{5,}}')), lambda x: NOT list_contains({texts(LONG_STOPWORDS)}, x))"


def cleaned(c: str) -> str:
    """Decoded, without a leading time and then an alert label, with single blanks."""
    out = c
    for entity, char in ENTITIES.items():
        out = f"replace({out}, {text(entity)}, {text(char)})"
    out = rf"regexp_replace({out}, '^\d{{1,2}}[:.]\d{{2}}(:\d{{2}})?\s*[-–—]?\s*', '')"
    return rf"trim(regexp_replace(regexp_replace({out}, '(?i)^({'|'.join(ALERT_LABELS)})\s*[:|-]?\s*', ''), '[\s\x{{a0}}]+', ' ', 'g'), ' ')"


def json_object(c: str) -> str:
    """The last valid object of fenced blocks, else of braces nested once, else the outermost braces."""
    fenced = rf"list_filter(regexp_extract_all({c}, '(?s)```(?:json)?\s*(\{{.*?\}})\s*```', 1), lambda x: json_valid(x))"
    braces = rf"list_filter(regexp_extract_all({c}, '(?s)\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}'), lambda x: json_valid(x))"
    return rf"coalesce({fenced}[-1], {braces}[-1], regexp_extract({c}, '(?s)\{{.*\}}', 0))"


def brief(c: str) -> str:
    """A model's summary: what its tags hold, unless that is a monologue; else its last attempt or its other lines."""
    heads = "|".join(MONOLOGUE_HEADS)
    return rf"""(SELECT CASE WHEN t = '' THEN '' WHEN tagged <> '' AND NOT contains(tagged, 'Analyze the Request') AND NOT contains(tagged, 'Internal Monologue') THEN tagged
  ELSE regexp_replace(regexp_replace(regexp_replace(CASE WHEN NOT ({" OR ".join(f"contains(told, {text(m)})" for m in MONOLOGUE_MARKS)}) THEN told WHEN len(tries) > 0 THEN trim(tries[-1], ' ')
    ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(told, '\r\n|\n|\r'), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(\d+\.|\*)\s*\*\*({heads})') AND NOT starts_with(x, '```') AND NOT starts_with(x, 'Attempt')), ' ') END,
    '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g'), '(?i)^({"|".join(SUMMARY_LABELS)})[\s\x{{a0}}]*', ''), '^["` ]+|["` ]+$', '', 'g') END
  FROM (SELECT t, trim(regexp_extract(t, '(?is)<summary>(.*?)</summary>', 1), ' ') AS tagged, told, regexp_extract_all(told, 'Attempt\s*\d+:\*?\s*([^\n\r]+)', 1) AS tries
    FROM (SELECT coalesce({c}, '') AS t, regexp_replace(coalesce({c}, ''), '(?is)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g') AS told)))"""


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


def contained(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) = least(len({a}), len({b})))"


def canonical_url(c: str) -> str:
    keys = "|".join(TRACKING_KEYS)
    query = f"list_filter(string_split(regexp_extract({c}, '\\?([^#]*)', 1), '&'), lambda p: contains(p, '=') AND NOT regexp_matches(lower(string_split(p, '=')[1]), '{keys}'))"
    return f"regexp_extract({c}, '^[^:]+://') || lower(regexp_extract({c}, '^[^:]+://([^/?#]*)', 1)) || rtrim(regexp_extract({c}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END"


def is_junk(c: str) -> str:
    t = rf"trim(regexp_replace({c}, '[\s\x{{a0}}]+', ' ', 'g'), ' ')"
    t = rf"regexp_replace({t}, '^\d{{1,2}}\s+[A-ZÇĞİÖŞÜa-zçğıöşü]+\s+\d{{4}}\s*\d{{0,2}}[:.]?\d{{0,2}}\s*[-–—]?\s*', '')"
    t = rf"trim(regexp_replace({t}, '^\d{{1,2}}[:.]\d{{2}}(:\d{{2}})?\s*[-–—]?\s*', ''), ' ')"
    n = f"len(list_filter(string_split({t}, ' '), lambda w: length(w) > 1))"
    low = f"lower({t})"
    plain = f"translate({low}, '’‘`´“”ığüşöç', '''''''''\"\"igusoc')"
    has = lambda x, ps: " OR ".join(f"contains({x}, {text(p)})" for p in ps)
    ends = " OR ".join(f"suffix({low}, {text(g)})" for g in GENERIC_TITLES)
    bare = rf"regexp_matches({t}, '^(\d+\s+[A-Za-zÇĞİÖŞÜçğıöşü]+\s+\d{{4}}|\d+[\s.-]+\d+[\s.-]+\d+|\d{{1,2}}[:.]\d{{2}})+$')"
    return f"(length({t}) < 20 OR {n} < 4 OR {has(low, JUNK_PHRASES)} OR list_contains({texts(GENERIC_TITLES)}, {low}) OR ({n} <= 4 AND ({ends})) OR {bare} OR {has(plain, OUTDATED_PHRASES)})"


def stage1(x: Lexicon) -> str:
    """CTE stage1: id, t (masked), found, is_candidate, aspect."""
    t = f"title || ' ' || summary[1:{x.window}]"
    for m in x.masks:
        t = f"regexp_replace({t}, {text(m)}, ' ', 'g')"
    found = ", ".join(f"CASE WHEN regexp_matches(t, {text(re2(k))}) THEN {text(k)} END" for k in x.keywords)
    has = lambda ws: f"regexp_matches(t, {text(re2(*ws))})"
    flags = {c: has(w) for c, w in x.countries.items()}
    first = next(iter(flags))
    flags[first] = "(" + " OR ".join([flags[first], *(has(x.topics[k]) for k in x.flagging)]) + ")"
    named = ", ".join(f"CASE WHEN {f} THEN {text(c)} END" for c, f in flags.items())
    topic = "CASE " + " ".join(f"WHEN {has(w)} THEN {text(first + ', ' + n)}" for n, w in x.topics.items()) + f" ELSE {text(first + ', ' + x.default_topic)} END"
    return f"""masked AS (SELECT *, {t} AS t FROM articles),
found AS (SELECT *, list_filter([{found}], lambda k: k IS NOT NULL) AS found, list_filter([{named}], lambda k: k IS NOT NULL) AS named, {has(x.union)} AS united FROM masked),
gate AS (SELECT *, len(found) > 0 AND len(list_filter(found, lambda k: NOT list_contains({texts(x.weak)}, lower(k)))) = 0 AS is_candidate FROM found),
stage1 AS (SELECT *, CASE WHEN len(found) = 0 OR is_candidate THEN NULL WHEN united THEN {text(x.union_label)} WHEN len(named) > 1 THEN array_to_string(named, ', ') WHEN named[1] = {text(first)} THEN {topic} ELSE named[1] END AS aspect FROM gate)"""


NEWS = """news AS (SELECT id, source_name, category, title, summary, publish_date, link, CASE WHEN aspect IS NULL THEN 0 ELSE 1 END AS ilgili_mi,
  coalesce(aspect, 'İlgisiz') AS ilgi_kategorisi, CASE WHEN aspect IS NULL THEN 0.0::DOUBLE ELSE 0.95::DOUBLE END AS guven_skoru,
  CASE WHEN aspect IS NULL THEN '' ELSE 'Tespit edildi: ' || aspect END AS gerekce,
  CASE WHEN aspect IS NULL THEN 'Genel (Filtresiz)' ELSE 'Stage 1 (Anahtar Kelime)' END AS relevance_status, coalesce(aspect, 'Genel') AS relevance_aspect FROM stage1)"""


def keyed(table: str, labels: bool = True) -> str:
    key = title_key("title", labels)
    return f"keyed AS (SELECT *, CASE WHEN {key} <> '' THEN 't:' || {key} ELSE 'l:' || link END AS k FROM {table})"


KEYED = keyed("articles")


def fold(table: str, by: str, near: str, replaces: str) -> str:
    """CTE folded: ids that a fold in id order keeps. near: of kept k and new x; replaces: of hit h and new x.

    Each row is a list of one, so that the fold's state, a list of kept rows, has the type of its input."""
    relevant = "ilgili_mi" if table in ("g", "gd") else "0"
    return f"""steps AS (SELECT list([struct_pack(id := id, w := {words('title')}, a := contains(link, 'news.google.com'), r := {relevant}, n := length(title), ts := epoch(strptime(publish_date, '%Y-%m-%d %H:%M:%S')))] ORDER BY id) AS xs FROM {table} GROUP BY {by}),
kept AS (SELECT list_reduce(xs, lambda acc, y: {_step(near, replaces)}, xs[1][1:0]) AS ks FROM steps),
folded AS (SELECT unnest(ks).id AS id FROM kept)"""


def _step(near: str, replaces: str) -> str:
    near, replaces = near.replace("x.", "y[1]."), replaces.replace("x.", "y[1].")
    hit = f"list_filter(acc, lambda k: {near})"
    return f"CASE WHEN len({hit}) = 0 THEN list_append(acc, y[1]) WHEN {replaces.replace('h.', f'{hit}[1].')} THEN list_append(list_filter(acc, lambda z: z.id <> {hit}[1].id), y[1]) ELSE acc END"


UPSERT = """, old AS (SELECT *, id % 2 = 0 AND length(summary) >= 60 AND right(trim(summary, ' '), 3) <> '...' AS keeps FROM (SELECT id, source_name, category, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') AS title, trim(regexp_replace(summary, '\\s+', ' ', 'g'), ' ') AS summary, publish_date, link FROM articles)),
new AS (SELECT id AS ord, category, 'N ' || source_name AS title, CASE WHEN id % 5 = 0 THEN '' ELSE 'new' END AS summary, CASE WHEN id % 7 = 0 THEN '2024-01-03 12:00:00' ELSE '2024-01-05 00:00:00' END AS publish_date, CASE WHEN id % 3 = 0 THEN link || '/new' ELSE link END AS link FROM articles)
SELECT o.id, coalesce(n.title, o.title) AS title, CASE WHEN n.link IS NULL OR o.keeps OR n.summary = '' THEN o.summary ELSE n.summary END AS summary, coalesce(n.publish_date, o.publish_date) AS publish_date, o.link, CAST(CASE WHEN n.link IS NULL AND o.id % 2 = 1 THEN 0 ELSE 1 END AS INTEGER) AS ilgili_mi, CASE WHEN n.link IS NULL AND o.id % 2 = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS guven_skoru, o.category
FROM old o LEFT JOIN new n USING (link)
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY ord), title, summary, publish_date, link, 1, 1.0::DOUBLE, category FROM new WHERE ord % 3 = 0"""
