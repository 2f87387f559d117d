"""Runs of repeated word sequences by a suffix tree of each text, after Stoye and Gusfield.

A run is a longest stretch of words that repeats with a period, at least twice. Where it ends, its last two periods are
a tandem repeat that branches: both halves start at leaves of the node whose depth is the period, below different
children. At each node only the leaves outside its largest child are looked at, each as the first and as the second
half, so that a leaf is looked at a logarithmic number of times. Each repeat is then rotated to the left as far as it
goes, and those that cover the same words are merged under the smallest period.

The texts of a batch share one tree: words count as equal only within a text, so that no node is of two texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, with_columns

#: Words of a tree, but for a longer text, and (node, leaf) pairs looked at together.
TREE_WORDS, PAIRS = 1 << 17, 1 << 20


def split(rank: np.ndarray, active: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of suffixes by their first 2 * width words from those by width, and the suffixes whose rank others share.

    A rank is the place at which the suffixes of the same words begin; active are all that share one."""
    key = rank[active].astype(np.int64) * len(rank) + rank[active + width]
    order = np.argsort(key, kind="stable")
    at, key = active[order], key[order]
    old, turn = rank[at], np.arange(len(at))
    group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], turn, 0))
    first = np.r_[True, key[1:] != key[:-1]]
    part = np.maximum.accumulate(np.where(first, turn, 0))
    new = rank.copy()
    new[at] = old + part - group
    alone = first & np.r_[first[1:], True]
    return new, at[~alone]


def ranked(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the first word alone."""
    count = np.bincount(symbols)
    rank = (np.cumsum(count) - count)[symbols].astype(np.int32)
    return rank, np.flatnonzero(count[symbols] > 1)


class Tree:
    """The suffix tree of words: leaves in order, and nodes as stretches of them with depths."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, width = symbols, 1
        rank, active = ranked(symbols)
        self.levels = [rank]  # level k: equal where 2^k words are equal
        while len(active):
            rank, active = split(rank, active, width)
            self.levels.append(rank)
            width *= 2
        self.place = rank
        self.leaves = np.empty(len(rank), np.int64)
        self.leaves[rank] = np.arange(len(rank))
        self._nodes(self._common())

    def _common(self) -> np.ndarray:
        """Words that each leaf has in common with the one before."""
        out = np.zeros(len(self.leaves), np.int64)
        at = np.flatnonzero(self.levels[0][self.leaves[1:]] == self.levels[0][self.leaves[:-1]]) + 1
        a, b, n = self.leaves[at - 1], self.leaves[at], np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            n += (self.levels[k][a + n] == self.levels[k][b + n]).astype(np.int64) << k
        out[at] = n
        return out

    def _nodes(self, common: np.ndarray) -> None:
        left, right, depth, owner, open_ = [], [], [], np.full(len(common), -1), []
        last, tops = 0, []
        at = np.flatnonzero(common)
        for t, h in zip(at.tolist(), common[at].tolist(), strict=True):
            first = t - 1
            if t != last + 1:  # between them a leaf that shares nothing with the one before closes all nodes
                for v in open_:
                    right[v] = last
                open_.clear()
            while open_ and depth[open_[-1]] > h:
                v = open_.pop()
                right[v], first = t - 1, left[v]
            if not open_ or depth[open_[-1]] < h:
                open_.append(len(depth))
                left.append(first)
                right.append(0)
                depth.append(h)
            tops.append(open_[-1])
            last = t
        for v in open_:
            right[v] = last
        owner[at] = tops
        self.left, self.right, self.depth = (np.array(x, np.int64) for x in (left, right, depth))
        self.owner = owner

    def smaller_children(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, first leaf and number of leaves of every child but one of the largest of each node."""
        starts = np.flatnonzero(self.owner >= 0)
        node = np.r_[np.arange(len(self.depth)), self.owner[starts]]
        start = np.r_[self.left, starts]
        order = np.lexsort((start, node))
        node, start = node[order], start[order]
        end = np.where(np.r_[node[1:] != node[:-1], True], self.right[node] + 1, np.r_[start[1:], 0])
        size = end - start
        largest_first = np.lexsort((-size, node))
        largest = largest_first[np.r_[True, node[largest_first][1:] != node[largest_first][:-1]]]
        rest = np.ones(len(node), bool)
        rest[largest] = False
        return node[rest], start[rest], size[rest]

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words and periods of branching tandem repeats, some twice."""
        if not len(self.depth):
            return
        node, start, size = self.smaller_children()
        before = np.r_[0, np.cumsum(size)]
        for low in range(0, int(before[-1]), PAIRS):
            turn = np.arange(low, min(low + PAIRS, int(before[-1])))
            child = np.searchsorted(before, turn, "right") - 1
            v = node[child]
            leaf, period = self.leaves[start[child] + turn - before[child]], self.depth[v]
            for first, other in ((leaf, leaf + period), (leaf - period, leaf - period)):
                place = self.place[np.maximum(other, 0)]
                within = (first >= 0) & (self.left[v] <= place) & (place <= self.right[v])
                i, p = first[within], period[within]
                branches = self.symbols[i + p] != self.symbols[i + 2 * p]
                yield i[branches], p[branches]

    def runs(self, shortest: int) -> np.ndarray:
        """Start, end and smallest period of each run of at least shortest words, by start, then period."""
        found = [np.empty((0, 3), np.int64)]
        for i, p in self.repeats():
            first = i.copy()
            for k in range(len(self.levels) - 1, -1, -1):
                at = first - (1 << k)
                same = (at >= 0) & (self.levels[k][np.maximum(at, 0)] == self.levels[k][np.maximum(at, 0) + p])
                first -= same.astype(np.int64) << k
            end = i + 2 * p
            long = end - first >= shortest
            found.append(np.column_stack((first, end, p))[long])
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        if len(rows):
            rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


def _joined(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts one after another, each with words and an end of its own, and where each starts."""
    symbols, first, known = [], [], 0
    for words in texts:
        first.append(len(symbols))
        own: dict = {}
        symbols += [own.setdefault(w, known + len(own)) for w in words]
        known += len(own)
        symbols.append(known)
        known += 1
    return np.array(symbols, np.int64), np.array(first, np.int64)


def runs_of(texts: list[list], shortest: int = 12) -> list[np.ndarray]:
    """Start, length and period of the runs of each list of words.

    Half of a run comes twice at least. A text in which no such stretch recurs has none and goes into no tree."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    symbols, first = _joined(texts)
    if not len(symbols):
        return out
    rank, active = ranked(symbols)
    width = 1
    while 4 * width <= shortest and len(active):
        rank, active = split(rank, active, width)
        width *= 2
    left = np.unique(np.searchsorted(first, active, "right") - 1).tolist()
    if not left:
        return out
    symbols, first = _joined([texts[k] for k in left])
    rows = Tree(symbols).runs(shortest)
    cuts = np.searchsorted(rows[:, 0], np.r_[first, len(symbols)])
    for k, f, low, high in zip(left, first.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        start, end, period = rows[low:high].T
        out[k] = np.column_stack((start - f, end - start, period))
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that are left when each run keeps its first period, joined by blanks."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        keep = np.cumsum(depth[:-1]) == 0
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: str = "text", shortest: int = 12) -> DataFrame:
    """docs with n_words, runs (array of start, length, period in words, by start, then period) and collapsed, the text
    of which each run keeps the first period, words joined by single blanks.

    A run has its smallest period q, at least max(shortest, 2 * q) words, and can't be made longer. A null text has no
    words, no runs and an empty collapsed text. Every row gets its answer, repeated ones too; columns of these names
    are replaced. A task holds one batch of texts, and the tree of at most TREE_WORDS words or of one longer text."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    def tree(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out, held, size = [], [], 0

            def done(held: list) -> list:
                found = runs_of(held, shortest)
                return [(len(w), r[:, 0], r[:, 1], r[:, 2], collapsed(w, r)) for w, r in zip(held, found, strict=True)]

            for t in texts:
                words = words_of(t)
                if held and size + len(words) > TREE_WORDS:
                    out += done(held)
                    held, size = [], 0
                held.append(words)
                size += len(words)
            out += done(held)
            yield pd.DataFrame(out, columns=["n_words", "start", "length", "period", "collapsed"])

    found = with_columns(docs, {"__qs_runs": tree(F.coalesce(F.col(text), F.lit("")))})
    r = F.col("__qs_runs")
    runs = F.arrays_zip(r["start"], r["length"], r["period"])
    return with_columns(found, {"n_words": r["n_words"], "runs": runs, "collapsed": r["collapsed"]}).drop("__qs_runs")


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text of the report: of a tenth of the ids, by checksum, words from some place on are those of one
    period, over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    cut = docs.select("doc_id", "text", words.alias("w"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    a, n = F.pmod("g", F.size("w")).cast("int"), F.size("w")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), a), again), F.lit(1), n), " ")
    return cut.select("doc_id", F.when(F.size("w") > 0, changed).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; four nulls without one), and digests of
    all runs and of the collapsed text. A null id changes no text; a null text has no runs."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_runs(repeating(docs))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("__qs_l", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__qs_l.s").alias("start"),
        (-F.col("__qs_l.l")).alias("length"),
        F.col("__qs_l.p").alias("period"),
        F.floor(-1000 * F.col("__qs_l.l") / F.col("__qs_l.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )


RUNS_SQL = r"""WITH h AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda x, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda z, y: xor(z >> 1, 3988292384 * (z & 1)), xor(x, b)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents),
n AS (SELECT *, h // 10 AS g, len(ws) AS n FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, h % 10 = 0 AND n > 0 AS again FROM n),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT rid, unnest(CASE WHEN again THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END) AS word, unnest(range(n)) AS i FROM p),
same AS (SELECT x.rid, x.i, y.i - x.i AS p FROM t x JOIN t y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i),
stretch AS (SELECT rid, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS part FROM same) GROUP BY rid, p, part HAVING count(*) >= p AND count(*) + p >= 12),
r AS (SELECT rid, start, length, min(p) AS period FROM stretch GROUP BY ALL),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY rid),
longest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) = 1),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = t.rid AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
FROM n LEFT JOIN listed USING (rid) LEFT JOIN longest USING (rid) LEFT JOIN kept USING (rid)"""
