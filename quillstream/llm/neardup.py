"""Near-duplicates by DartMinHash.

The plane of weights and ranks over each element is cut into regions of area one: strips of weight 0-1, 1-2, 2-4, ...
and as many ranks as give that area. A hash of element and region throws a Poisson number of darts into it. Darts
under an element's weight are the document's; each has a coordinate, and the earliest dart of each coordinate is the
signature. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents that share a band are compared by their signatures, and the groups of those that may be similar by their
shingles, exactly. Classes are the connected components of pairs at least as similar as asked for."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored, with_columns
from quillstream.llm.graph import components

#: Words of a shingle, least similarity, bands and rows of a band. Pairs at 0.8 miss all bands once in 20,000.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 25, 5
#: Agreement of signatures from which on a pair is a candidate (five standard deviations below 0.8), and below
#: which even a neighbour of a candidate can't be one.
NEAR, RING = 0.62, 0.35
#: Rows of a bucket that are compared in one task; rows and shingles of a group that is resolved in one task.
BUCKET_ROWS, GROUP_ROWS, GROUP_SHINGLES = 2048, 4096, 4_000_000
#: Rows of a larger group to which all of it is compared in the first round; each round has twice as many as the one
#: before, up to this share of the group.
PIVOTS, PIVOT_SHARE = 64, 1 / 16
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Hashes of the word shingles of texts: of lower-case words; a text with fewer words is one shingle."""

    def __init__(self, size: int = WORDS) -> None:
        self.size, self.hashes = size, _Words()

    def words(self, text: str | None) -> list[str]:
        return _word(text.lower()) if text else []

    def shingles(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order, and how often each occurs."""
        w = np.fromiter(map(self.hashes.__getitem__, words), _U, len(words))
        size = min(self.size, len(w))
        if not size:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        h = w[: len(w) - size + 1] + _U(size)
        for i in range(1, size):
            h = h * _MIX + w[i : len(w) - size + 1 + i]
        h = np.sort(_stir(h))
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.diff(np.r_[first, len(h)])


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


#: Chances of at most 0, 1, 2, ... darts in a region.
_UP_TO = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def throw(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray, owners: np.ndarray, coordinates: int) -> tuple[np.ndarray, ...]:
    """owner, coordinate, rank and name of all darts under the elements' weights with a rank under the limit."""
    out, low, strip = [], 0.0, 0
    while len(elements):
        width = 1.0 if not strip else 2.0 ** (strip - 1)
        regions = np.ceil(limits * width).astype(np.int64)
        at = np.repeat(np.arange(len(elements)), regions)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
        region = _stir(_stir(elements[at] + _U(strip)) ^ (turn.astype(_U) * _U(0x9E3779B97F4A7C15)))
        darts = np.searchsorted(_UP_TO, _uniform(region))
        q = 0
        while len(at):
            has = darts > q
            at, turn, region, darts = at[has], turn[has], region[has], darts[has]
            dart = _stir(region + _U(q + 1))
            rank = (turn + _uniform(_stir(dart ^ _U(1)))) / width
            height = low + width * _uniform(_stir(dart ^ _U(2)))
            own = (rank < limits[at]) & (height < weights[at])
            out.append((owners[at[own]], (_stir(dart[own] ^ _U(3)) % _U(coordinates)).astype(np.int64), rank[own], dart[own]))
            q += 1
        low, strip = low + width, strip + 1
        more = weights > low
        elements, weights, limits, owners = elements[more], weights[more], limits[more], owners[more]
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int) -> np.ndarray:
    """A row of dart names per weighted set (elements, weights); sets must not be empty."""
    found = np.zeros((len(sets), coordinates), _U)
    todo, spread = np.arange(len(sets)), math.log(coordinates) + 4
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owners = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        total = np.bincount(owners, weights, len(todo))
        owner, coordinate, rank, name = throw(elements, weights, (coordinates * spread / total)[owners], owners, coordinates)
        place = owner * coordinates + coordinate
        rows, earliest = np.zeros(len(todo) * coordinates, _U), np.full(len(todo) * coordinates, np.inf)
        np.minimum.at(earliest, place, rank)
        wins = rank == earliest[place]
        rows[place[wins]] = name[wins]
        whole = (earliest < np.inf).reshape(-1, coordinates).all(axis=1)
        found[todo[whole]] = rows.reshape(-1, coordinates)[whole]
        todo, spread = todo[~whole], spread * 2
    return found


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(found), bands))
    for i in range(rows):
        key = _stir(key * _U(5) + found.reshape(len(found), bands, rows)[:, :, i])
    return key.view(np.int64)


def bucket_edges(marks: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges (row, row) that connect all candidate pairs of a bucket, and its leaders, given one-byte signatures.

    Each row that is near to no leader so far becomes one. A row in a leader's ring, near only to rows that are near
    to it, is compared with those too. There are fewer edges than rows."""
    n = len(marks)
    up, edges, leaders, near, ring = list(range(n)), [], [], [], []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(a: int, b: int) -> None:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            edges.append((a, b))

    free = np.ones(n, bool)
    for i in range(n):
        if free[i]:
            agreed = (marks == marks[i]).mean(axis=1)
            close = np.flatnonzero(agreed >= NEAR)
            free[close] = False
            for j in close.tolist():
                join(j, i)
            leaders.append(i)
            near.append(close)
            ring.append(np.flatnonzero((agreed < NEAR) & (agreed >= RING)))
    for close, around in zip(near, ring, strict=True):
        for j in around.tolist():
            if root(j) != root(int(close[0])):
                agreed = (marks[close] == marks[j]).mean(axis=1)
                if agreed[best := int(agreed.argmax())] >= NEAR:
                    join(j, int(close[best]))
    return edges, leaders


def resolve(sets: list[np.ndarray], order: np.ndarray, similar: float) -> list[int]:
    """The class (a place) of each set: components of pairs with Jaccard similarity >= similar.

    Sets are compared with all others in turn, in the given order. A pair is left out if both are in one class or the
    distances to the sets taken so far say that it can't be similar: Jaccard distance obeys the triangle inequality."""
    n = len(sets)
    label, sizes = np.arange(n), np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    lower = np.zeros((n, n), np.float32) if n <= 1024 else None
    mark, done = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(n, bool)
    for p in order.tolist():
        done[p] = True
        may = (label != label[p]) & ~done & (np.minimum(sizes, sizes[p]) >= similar * np.maximum(sizes, sizes[p]) - 1e-9)
        if lower is not None:
            may &= lower[p] <= 1 - similar + 1e-6
        if not may.any():
            continue
        own = ids[starts[p] : starts[p] + sizes[p]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        same = both / (sizes + sizes[p] - both)
        for j in np.flatnonzero(may & (same >= similar - 1e-12)).tolist():
            label[label == max(label[p], label[j])] = min(label[p], label[j])
        if lower is not None:
            np.maximum(lower, np.abs(np.subtract.outer(same, same)).astype(np.float32), out=lower)
    return label.tolist()


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A long key for every row: the id if no two rows share one and none is null; else a hash of id and text."""
    twice = docs.groupBy(F.col(doc_id).alias("i")).count().where("count > 1 or i is null").limit(1).count()
    plain = dict(docs.dtypes)[doc_id] == "bigint" and not twice
    return with_columns(docs, {"__qs_k": F.col(doc_id) if plain else F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))})


def near_classes(rows: DataFrame, weighted: bool = True, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, band_rows: int = ROWS, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """k, label of those rows (k: long, t: string) that are in a class with another key; label is a key of the class.

    weighted: shingles weigh as often as they occur, else once. Texts with the same words are one class without
    further ado; one of them stands for all. Texts without words are in no class."""
    spark = rows.sparkSession

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            kept, sets, names = [], [], []
            for k, t in zip(batch.k, batch.t, strict=True):
                if w := shingler.words(t):
                    elements, n = shingler.shingles(w)
                    kept.append(k)
                    sets.append((elements, n if weighted else np.ones(len(n))))
                    names.append(xxhash.xxh3_128_digest(" ".join(w)))
            if not kept:
                continue
            found = np.concatenate([signatures(sets[i : i + 64], bands * band_rows) for i in range(0, len(sets), 64)])
            marks = (_stir(found) & _U(255)).astype(np.uint8)
            yield pd.DataFrame({"k": kept, "name": names, "keys": list(band_keys(found, bands, band_rows)), "marks": [m.tobytes() for m in marks], "size": [int(x[1].sum()) for x in sets]})

    signed = stored(rows.mapInPandas(sign, "k long, name binary, keys array<long>, marks binary, size long"), "signed")
    texts = stored(signed.groupBy("name").agg(F.min("k").alias("rep"), F.count("*").alias("copies")), "texts")
    copies = signed.select("k", "name").join(texts.where("copies > 1"), "name").select(F.col("k").alias("u"), F.col("rep").alias("v"))
    own = signed.join(texts.select(F.col("rep").alias("k"), "name"), ["name", "k"], "left_semi")
    own = stored(own.select("k", "keys", "marks", "size"), "own")
    each = own.select("k", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    met = stored(each.join(shared, "key"), "met")
    member = met.join(own.select("k", "marks"), "k")
    member = member.withColumn("salt", F.pmod(F.xxhash64("k"), F.ceil(F.col("rows") / bucket_rows)))

    width = bands * band_rows

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["key", "salt"]):
            k, several = part.k.to_numpy(), part.several.to_numpy()
            marks = np.frombuffer(b"".join(part.marks), np.uint8).reshape(-1, width)
            starts = group_starts(part, ["key", "salt"])
            sizes = np.diff(np.r_[starts, len(part)])
            pair = starts[(sizes == 2) & ~several[starts]]  # most buckets: all at once
            pair = pair[(marks[pair] == marks[pair + 1]).mean(axis=1) >= NEAR]
            u, v, m = [k[pair + 1]], [k[pair]], [np.full(len(pair), None)]
            for a, n in zip(*(x[(sizes > 2) | several[starts]].tolist() for x in (starts, sizes)), strict=True):
                edges, leaders = bucket_edges(marks[a : a + n])
                ends = np.array(edges, np.int64).reshape(-1, 2) + a
                u, v, m = [*u, k[ends[:, 0]]], [*v, k[ends[:, 1]]], [*m, np.full(len(edges), None)]
                if several[a]:  # leaders of a salted bucket are compared with one another
                    at = np.array(leaders) + a
                    u, v, m = [*u, k[at]], [*v, part.key.to_numpy()[at]], [*m, part.marks.to_numpy()[at]]
            yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v), "marks": np.concatenate(m)})

    dealt = member.withColumn("several", F.col("rows") > bucket_rows).select("key", "salt", "several", "k", "marks")
    pairs = stored(dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "k").mapInPandas(compare, "u long, v long, marks binary"), "pairs")

    leaders = pairs.where("marks is not null").select(F.col("v").alias("key"), F.col("u").alias("k"), "marks")
    led = leader_edges(leader_blocks(leaders, bucket_rows))
    edges = pairs.where("marks is null and u <> v").select("u", "v").unionByName(led).distinct()
    groups = components(edges)
    hubs = met.groupBy("k").agg(F.sum("rows").alias("hub"))
    groups = groups.join(own.select("k", "size"), groups.node == F.col("k")).select("k", F.col("label").alias("g"), "size").join(hubs, "k")
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    # parts of a heavy group: of bounded rows and about bounded shingles
    parts = F.greatest(F.ceil(F.col("n") / bucket_rows), F.ceil(F.col("shingles") / GROUP_SHINGLES))
    groups = groups.join(sizes, "g").withColumn("heavy", (F.col("n") > group_rows) | (F.col("shingles") > GROUP_SHINGLES)).select("k", "g", "hub", "heavy", "n", parts.alias("parts"))

    @F.pandas_udf("binary")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(words)
        for batch in texts:
            yield pd.Series([_packed(*shingler.shingles(shingler.words(t)), weighted) for t in batch], dtype=object)

    sets = stored(rows.join(groups, "k").select("k", "g", "hub", "heavy", "n", "parts", cut("t").alias("set")), "sets")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, part in grouped(batches, ["g"]):
            part = part.drop_duplicates("k")
            order = np.lexsort((part.k.to_numpy(), -part.hub.to_numpy()))
            label = resolve([np.frombuffer(s, _U) for s in part.set], order, similar)
            keys = part.k.to_numpy()
            own = [(k, keys[x]) for k, x in zip(keys.tolist(), label, strict=True) if keys[x] != k]
            if own:
                yield pd.DataFrame(own, columns=["u", "v"])

    light = sets.where("not heavy").select("g", "k", "hub", "set").repartition("g").sortWithinPartitions("g", "k").mapInPandas(settle, "u long, v long")
    links = copies.unionByName(light)
    if sizes.where((F.col("n") > group_rows) | (F.col("shingles") > GROUP_SHINGLES)).limit(1).count():
        links = links.unionByName(heavy_links(sets.where("heavy").drop("heavy"), similar))
    return components(links).select(F.col("node").alias("k"), "label")


def leader_blocks(leaders: DataFrame, rows: int) -> DataFrame:
    """key, i, j, block, k, marks: the leaders (key, k, marks) of each key in blocks, for each pair (i, j) of blocks."""
    blocks = stored(leaders.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / rows).cast("int").alias("blocks")), "blocks")
    placed = leaders.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "k"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k", "marks")


def leader_edges(placed: DataFrame) -> DataFrame:
    """u, v: each leader and the nearest one of every block, if that may belong to one group with it."""

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, i, j), part in grouped(batches, ["key", "i", "j"]):
            marks, k = np.frombuffer(b"".join(part.marks), np.uint8).reshape(len(part), -1), part.k.to_numpy()
            first = part.block.to_numpy() == i
            mine, others = np.flatnonzero(~first) if i != j else np.arange(len(part)), np.flatnonzero(first)
            u, v = [], []
            for a in mine.tolist():  # to the nearest earlier leader of the other block, or of its own
                to = others if i != j else others[:a]
                if len(to):
                    agreed = (marks[to] == marks[a]).mean(axis=1)
                    best = int(agreed.argmax())
                    if agreed[best] >= RING:
                        u.append(k[a])
                        v.append(k[to[best]])
            if u:
                yield pd.DataFrame({"u": u, "v": v})

    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "k").mapInPandas(lead, "u long, v long")


def _packed(elements: np.ndarray, n: np.ndarray, weighted: bool) -> bytes:
    """A set of shingles; with weights, of shingles and turns, whose Jaccard similarity is the weighted one."""
    if weighted and len(n) and n.max() > 1:
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        elements = np.unique(_stir(np.repeat(elements, n) + turn.astype(_U) * _U(0x9E3779B97F4A7C15)))
    elif weighted:
        elements = np.unique(_stir(elements))
    return elements.tobytes()


def group_starts(part: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where the groups of a frame start that is sorted by `by`."""
    new = np.zeros(max(len(part) - 1, 0), bool)
    for c in by:
        x = part[c].to_numpy()
        new |= x[1:] != x[:-1]
    return np.r_[0, np.flatnonzero(new) + 1] if len(part) else np.zeros(0, np.int64)


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str], rows: int = 4096) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by `by`, in frames that end where a group ends; about `rows` or one group each."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            part = pd.concat(held, ignore_index=True)
            last = int(group_starts(part, by)[-1])
            if last:
                yield part.iloc[:last]
            held, size = [part.iloc[last:]], len(part) - last
    if size:
        yield pd.concat(held, ignore_index=True)


def grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    """Groups of rows that come sorted by `by`: their values and frame."""
    for part in whole_groups(batches, by):
        starts = group_starts(part, by)
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            yield tuple(part[c].iloc[a] for c in by), part.iloc[a:b]


def heavy_links(sets: DataFrame, similar: float) -> DataFrame:
    """u, v: links that connect the classes of groups too large for one task (k, g, hub, n, parts, set).

    In each round some rows of each group, those with most neighbours first, are compared with the whole group,
    which is dealt over many tasks, as are they. A link between two classes has an end outside the group's largest
    class, so rows in that one need no turn of their own; a row that had its turn has all its links. Most groups are
    one class after the first rounds; where none dominates, rounds grow, so that their number stays small. They end
    when no row is left."""
    salt = F.pmod(F.xxhash64("k"), "parts").alias("salt")
    state = stored(sets.select("k", "g", salt, "hub", "n", "parts", F.col("k").alias("label"), F.lit(False).alias("done")), "state")
    links: DataFrame | None = None
    members = sets.select("k", "g", "set", salt, "parts")
    size = PIVOTS

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            own = [np.frombuffer(s, _U) for s in left.set]
            sizes, flat = np.array([len(s) for s in own]), np.concatenate(own)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for k, s in zip(right["pivot"], right["pivot_set"], strict=True):
                pivot = np.frombuffer(s, _U)
                at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
                both = np.add.reduceat((pivot[at] == flat).astype(np.int64), starts)
                same = both / (sizes + len(pivot) - both)
                out += [(j, k) for j in left.k[same >= similar - 1e-12].tolist() if j != k]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    while True:
        largest = state.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
        # so many of each part of a group; packs of them are as large as parts are
        each = F.ceil(F.greatest(F.lit(PIVOTS), F.least(F.lit(size), F.floor(F.col("n") * PIVOT_SHARE))) / F.col("parts"))
        turn = F.row_number().over(Window.partitionBy("g", "salt").orderBy(F.desc("hub"), "k"))
        pivots = state.join(largest, "g").where("not done and label <> top").withColumn("turn", turn).where(F.col("turn") <= each)
        pack = F.floor(F.col("salt") / F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("parts") * each))))
        pivots = stored(pivots.select("k", "g", pack.alias("pack")), "pivots")
        if not pivots.limit(1).count():
            return links if links is not None else state.select(F.col("k").alias("u"), F.col("k").alias("v")).limit(0)
        size *= 2
        theirs = members.join(pivots.select("k", "pack"), "k").select("k", "g", "pack", "set", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).toDF("pivot", "pivot_g", "pivot_pack", "pivot_set", "pivot_salt")
        asked = members.join(pivots.select(F.col("g").alias("pivot_g"), "pack").distinct(), F.col("g") == F.col("pivot_g")).select("k", "g", "salt", "pack", "set")
        found = stored(asked.groupBy("g", "salt", "pack").cogroup(theirs.groupBy("pivot_g", "pivot_salt", "pivot_pack")).applyInPandas(compare, "u long, v long"), "links")
        links = found if links is None else links.unionByName(found)
        label = state.select("k", "label")
        ends = found.join(label, found.u == label.k).select(F.col("label").alias("a"), "v").join(label, F.col("v") == label.k).select(F.col("a").alias("u"), F.col("label").alias("v")).where("u <> v")
        merged = components(ends).select(F.col("node").alias("label"), F.col("label").alias("new"))
        state = state.join(merged, "label", "left").join(pivots.select("k", F.lit(True).alias("now")), "k", "left")
        state = stored(state.select("k", "g", "salt", "hub", "n", "parts", F.coalesce("new", "label").alias("label"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "state")


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: str = "", **options) -> DataFrame:
    """docs with class_id (the smallest id of its class), class_size and keep (whether it is the one that stays).

    prefix goes before the new columns' names. A document without similar ones is a class of its own, as is one without words (null and empty texts). Equal
    rows are of one class; of those with the smallest id exactly one stays. Null ids come last."""
    prepare(docs.sparkSession)
    keyed = _keyed(docs, text, doc_id)
    found = near_classes(keyed.select(F.col("__qs_k").alias("k"), F.col(text).alias("t")), **options).withColumnRenamed("k", "__qs_j")
    light = keyed.select("__qs_k", F.col(doc_id).alias("__qs_i"), (F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")) > 0).alias("__qs_w"))
    light = stored(light.groupBy("__qs_k", "__qs_i", "__qs_w").agg(F.count("*").alias("__qs_n")).join(found, F.col("__qs_k") == F.col("__qs_j"), "left").drop("__qs_j"), "light")
    several = light.where("label is not null")
    per = several.groupBy("label").agg(F.min("__qs_i").alias("class_id"), F.sum("__qs_n").alias("class_size"), F.min_by("__qs_k", F.struct(F.col("__qs_i").isNull(), "__qs_i", "__qs_k")).alias("__qs_first"))
    # stored, so that a class beyond a task's share can be split when it is joined
    joined = several.join(stored(per, "classes"), "label")
    known = joined.select(F.col("__qs_k").alias("__qs_j"), F.col("class_id").alias("__qs_class"), F.col("class_size").alias("__qs_size"), (F.col("__qs_k") == F.col("__qs_first")).alias("__qs_keep"))
    alone = light.where("label is null").select("__qs_k", "__qs_i", F.when(F.col("__qs_w"), F.col("__qs_n")).otherwise(1).cast("long"), F.lit(True))
    known = known.unionByName(alone.toDF(*known.columns))
    out = with_columns(keyed.join(known, F.col("__qs_k") == F.col("__qs_j")), {prefix + "class_id": F.col("__qs_class"), prefix + "class_size": F.col("__qs_size"), prefix + "keep": F.col("__qs_keep")})
    return out.drop("__qs_j", "__qs_class", "__qs_size", "__qs_keep")


def class_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id, class_size.

    A row for each row of docs; repeated ones are of one class. A text without words (null or empty too) is alone: its
    class is its own id, null for a null id, and its size 1. Other columns are not read."""
    return classify(docs.select("doc_id", "text"), **options).select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class, the one with the smallest id; of equal rows one. Documents without words all stay."""
    marked = classify(docs, text, doc_id, prefix="__qs_", **options).where("__qs_keep")
    # only rows with words that are of one key can be equal
    turn = F.row_number().over(Window.partitionBy("__qs_k").orderBy("__qs_class_id"))
    once, several = marked.where("__qs_class_size = 1"), marked.where("__qs_class_size > 1").withColumn("__qs_turn", turn).where("__qs_turn = 1")
    return once.select(docs.columns).unionByName(several.select(docs.columns))
