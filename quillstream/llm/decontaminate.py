"""Benchmark decontamination with a generalised suffix automaton of the test items' words."""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored, with_columns

#: Words of normalised text: only A-Z are lower-cased, all that isn't ASCII belongs to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_word = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return _word.findall(text.translate(LOWER)) if text else []


class SuffixAutomaton:
    """Of several word sequences (words are numbers), in flat arrays. State 0 is the root; link and length as usual.

    While it grows, the arcs of a state are a chain and all arcs stand in one open hash table; freeze() turns them
    into one sorted array of (state, word), which is a tenth of what a dict for each state takes."""

    def __init__(self) -> None:
        self.link, self.length, self.head = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.source, self.word, self.target, self.after = array("i"), array("i"), array("i"), array("i")
        self.slots = array("i", [-1]) * 1024
        self.keys = self.ends = array("q")

    def _slot(self, state: int, w: int) -> int:
        """Where the arc stands, or would."""
        mask, slots, source, word = len(self.slots) - 1, self.slots, self.source, self.word
        at = (state * 0x9E3779B97F4A7C15 + w * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF) >> 32 & mask
        while (arc := slots[at]) >= 0 and (source[arc] != state or word[arc] != w):
            at = at + 1 & mask
        return at

    def _to(self, state: int, w: int) -> int:
        arc = self.slots[self._slot(state, w)]
        return self.target[arc] if arc >= 0 else -1

    def _connect(self, state: int, w: int, target: int) -> None:
        """Adds an arc that isn't there."""
        if 2 * len(self.word) >= len(self.slots):
            self.slots = array("i", [-1]) * (4 * len(self.slots))
            for arc in range(len(self.word)):
                self.slots[self._slot(self.source[arc], self.word[arc])] = arc
        self.slots[self._slot(state, w)] = len(self.word)
        self.after.append(self.head[state])
        self.head[state] = len(self.word)
        self.source.append(state)
        self.word.append(w)
        self.target.append(target)

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.head.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of p's strings with w: q, or a copy of it if q has longer strings too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q])
        arc = self.head[q]
        while arc >= 0:
            self._connect(copy, self.word[arc], self.target[arc])
            arc = self.after[arc]
        self.link[q] = copy
        while p >= 0 and (arc := self.slots[self._slot(p, w)]) >= 0 and self.target[arc] == q:
            self.target[arc] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for w in sequence:
            if (q := self._to(last, w)) >= 0:  # another sequence has it
                last = self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, 0), last
            while p >= 0 and (q := self._to(p, w)) < 0:
                self._connect(p, w, new)
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w, q)
            last = new

    def freeze(self) -> None:
        keys = np.frombuffer(self.source, np.int32).astype(np.int64) << 32 | np.frombuffer(self.word, np.int32) if len(self.word) else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.ends = array("i", np.frombuffer(self.target, np.int32)[order].tobytes() if len(order) else b"")
        self.keys = array("q", keys[order].tobytes())
        self.source = self.word = self.target = self.after = self.head = self.slots = array("i")

    def walk(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The state and length of the longest match that ends with w, after that of (state, matched)."""
        keys = self.keys
        while True:
            at = bisect_left(keys, key := state << 32 | w)
            if at < len(keys) and keys[at] == key:
                return self.ends[at], matched + 1
            if not state:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]

    def shortened(self, state: int, least: int) -> int:
        """The state of the last `least` words of a match of this state, which has so many."""
        while self.length[self.link[state]] >= least:
            state = self.link[state]
        return state


class Items:
    """The frozen automaton of the items, their vocabulary, and the items of each window by its state.

    A window is `window` consecutive words of an item; an item with fewer words is one window. Items without id have
    windows like the others, which no id stands for."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int) -> None:
        self.window, self.names = window, []
        self.ids: dict[str, int] = {}
        self.automaton = SuffixAutomaton()
        flat, ends, owners = array("i"), [0], array("i")
        for item, text in items:
            sequence = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            if sequence:
                self.automaton.add(sequence)
                flat.extend(sequence)
                ends.append(len(flat))
                owners.append(-1 if item is None else len(self.names))
                if item is not None:
                    self.names.append(item)
        self.automaton.freeze()
        at, who = array("q"), array("i")  # windows by state and length, and their items
        for owner, a, b in zip(owners, ends, ends[1:], strict=False):
            state, n = 0, min(window, b - a)
            for i in range(a, b):
                state, _ = self.automaton.walk(state, 0, flat[i])
                if i - a + 1 >= n:
                    state = self.automaton.shortened(state, n)
                    at.append(state * (window + 1) + n)
                    who.append(owner)
        keys, of = np.frombuffer(at, np.int64) if len(at) else np.zeros(0, np.int64), np.frombuffer(who, np.int32) if len(who) else np.zeros(0, np.int32)
        both = np.unique(np.stack([keys, of], axis=1), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
        first = np.flatnonzero(np.r_[True, both[1:, 0] != both[:-1, 0]]) if len(both) else np.zeros(0, np.int64)
        self.keys, self.firsts = array("q", both[first, 0].tobytes()), array("q", np.r_[first, len(both)].astype(np.int64).tobytes())
        self.owners = array("i", both[:, 1].astype(np.int32).tobytes())
        self.sizes = sorted({x % (window + 1) for x in self.keys}, reverse=True)
        w = np.frombuffer(flat, np.int32).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        inner = np.ones(max(len(w) - 1, 0), bool)
        inner[np.array(ends[1:-1], np.int64) - 1] = False
        self.pairs = np.unique((w[:-1] << 32 | w[1:])[inner])

    def nbytes(self) -> int:
        """About what a worker holds."""
        held = (self.automaton.link, self.automaton.length, self.automaton.keys, self.automaton.ends, self.keys, self.firsts, self.owners)
        return sum(x.itemsize * len(x) for x in held) + self.pairs.nbytes + sys.getsizeof(self.ids) + sum(sys.getsizeof(x) + 28 for x in self.ids) + sum(sys.getsizeof(x) + 8 for x in self.names)

    def owners_of(self, state: int, n: int) -> array | None:
        """Places of the items that have the window of n words at this state."""
        at = bisect_left(self.keys, key := state * (self.window + 1) + n)
        return self.owners[self.firsts[at] : self.firsts[at + 1]] if at < len(self.keys) and self.keys[at] == key else None

    def stretches(self, sequence: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of words of which each adjacent pair stands in some item: no match leaves them."""
        known = sequence >= 0
        if len(sequence) < 2 or not len(self.pairs):
            linked = np.zeros(max(len(sequence) - 1, 0), bool)
        else:
            codes = sequence[:-1] << 32 | sequence[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            linked = known[:-1] & known[1:] & (self.pairs[at] == codes)
        starts = np.flatnonzero(known & ~np.r_[False, linked])
        ends = np.flatnonzero(known & ~np.r_[linked, False]) + 1
        long = ends - starts >= self.sizes[-1]
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def match(self, sequence: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words and the items that have windows there."""
        if not self.sizes or not sequence:
            return [], set()
        spans: list[list[int]] = []
        found: set[int] = set()
        coded = np.fromiter((self.ids.get(w, -1) for w in sequence), np.int64, len(sequence))
        for a, b in self.stretches(coded):
            state = matched = 0
            for i, w in enumerate(coded[a:b].tolist(), a + 1):
                state, matched = self.automaton.walk(state, matched, w)
                for n in self.sizes:
                    if n <= matched and (owners := self.owners_of(self.automaton.shortened(state, n), n)):
                        found.update(owners)
                        if spans and i - n <= spans[-1][1]:
                            while len(spans) > 1 and i - n <= spans[-2][1]:
                                spans.pop()
                            spans[-1] = [min(spans[-1][0], i - n), i]
                        else:
                            spans.append([i - n, i])
        return [tuple(x) for x in spans], {self.names[x] for x in found if x >= 0}


#: Words of items that one automaton holds; items beyond it go to further automata, each with its own pass.
SHARD_WORDS = 2_000_000


def shards(benchmark: DataFrame, item: str, text: str, window: int, limit: int):
    """Automata over all items, each over about `limit` words at most, so that what is sent to workers is bounded."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    n = F.length("text") / 2
    total = items.agg(F.sum(n)).first()[0] or 0
    parts = int(total // limit) + 1
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield Items(((r.item, r.text) for r in part.orderBy("item", "text").toLocalIterator()), window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS, name: str = "leak", cut: bool = False) -> DataFrame:
    """docs with leak (or another name): struct<n_words, spans: array<struct<start, end>> of hit words, items: array<string>>,
    and with cut also left: string, the text without what is hit (null if nothing is). It is cut where it is scanned, as a
    second function would need a second Python worker beside each scanning one.

    A null or empty text has no words; items that are null or have no words have no windows; the windows of items
    without id are hit like others, but no id is named for them; repeated items count once. Repeated rows of docs stay. An empty benchmark hits nothing."""
    spark = prepare(docs.sparkSession)
    kind = "n_words long, spans array<struct<start: int, end: int>>, items array<string>" + ", left string" * cut

    def scanner(model: Items):
        held = spark.sparkContext.broadcast(model)

        @F.pandas_udf(kind)
        def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            model = held.value
            for batch in batches:
                texts, *earlier = batch if isinstance(batch, tuple) else [batch]  # a lone column comes as it is
                rows = []
                for t, before in zip(texts, earlier[0] if earlier else [()] * len(texts), strict=True):
                    w = words(t)
                    spans, found = model.match(w)
                    row = (len(w), [{"start": a, "end": b} for a, b in spans], sorted(found))
                    if cut:
                        hit = sorted([*spans, *((x["start"], x["end"]) for x in before)])
                        row = (*row, without(t, hit) if hit else None)
                    rows.append(row)
                yield pd.DataFrame(rows, columns=["n_words", "spans", "items", "left"][: 3 + cut])

        return scan.asNondeterministic()  # so that a filter on its result doesn't run it again

    models = shards(benchmark, item, item_text, window, shard_words)
    first = next(models)
    out = with_columns(docs, {name: scanner(first)(F.coalesce(F.col(text), F.lit("")))})
    for model in models:
        more = scanner(model)(F.coalesce(F.col(text), F.lit("")), *[F.col(f"{name}.spans")] * cut)
        both = with_columns(out, {"__qs_more": more})
        left = [F.col("__qs_more.left").alias("left")] * cut
        out = stored(with_columns(both, {name: F.struct(F.col(f"{name}.n_words").alias("n_words"), F.concat(f"{name}.spans", "__qs_more.spans").alias("spans"), F.array_distinct(F.concat(f"{name}.items", "__qs_more.items")).alias("items"), *left)}).drop("__qs_more"), "leaks")
    return out


def covered(spans: str) -> F.Column:
    """Number of words in any of the spans, which may overlap."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda acc, x: F.struct((acc.n + F.greatest(x.end - F.greatest(x.start, acc.end), F.lit(0))).alias("n"), F.greatest(acc.end, x.end).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc.n.cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, most_covered: float = 0.5, **names: str) -> DataFrame:
    """docs without what they share with the benchmark: every hit word is removed with what stands between
    hit words of a span, and a document with over most_covered of its words hit, or left without any word, goes.

    Columns and clean rows stay as they are; a document without hits stays even if it is null or empty."""
    found = find_leaks(docs, benchmark, text, window=window, name="__qs_leak", cut=True, **names)
    n_hit = covered("__qs_leak.spans")
    kept = found.where((n_hit == 0) | (n_hit < F.col("__qs_leak.n_words")) & (n_hit <= most_covered * F.col("__qs_leak.n_words")))
    return with_columns(kept, {text: F.coalesce("__qs_leak.left", text)}).select(docs.columns)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without its words of the spans and what stands between words of one span."""
    places, kept, at = [m.span() for m in _word.finditer(text.translate(LOWER))], [], 0
    for a, b in spans:
        if places[b - 1][1] > at:
            kept.append(text[at : max(at, places[a][0])])
            at = places[b - 1][1]
    return "".join([*kept, text[at:]])


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    A row for each row of docs, repeated ones too. A null or empty text has no words and isn't contaminated; the
    digest of no items is that of the empty string. Null ids stay null; other columns are not read."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = covered("leak.spans")
    return found.select("doc_id", F.col("leak.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


LEAK_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM item_words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM grams JOIN windows USING (n, gram)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
