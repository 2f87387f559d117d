"""Suffix-array dedup: longest-previous-factor arrays over the parts of a corpus that can repeat.

A string of `least` bytes that stands in two places has the same smallest gram hash in both, so every such string
is dealt to the bucket of its smallest gram. Neighbouring strings of one bucket form a segment. Segments that are
equal as a whole are settled by counting; segments of a bucket that differ meet in a suffix array, where the previous
and next smaller positions of each suffix give its longest earlier match, and mirrored its longest later one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored, with_columns

#: Shortest repeated string in bytes, and bytes of a gram.
LEAST, GRAM = 400, 96
#: Bytes of segments in one suffix array, and distinct segments of a bucket from which on it is split by fingerprints.
ARRAY_BYTES, HOT = 1_500_000, 2048
#: Window starts of a part of a hot segment; bytes of a long text that are hashed at once.
PART, SLICE = 16, 1 << 21
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return (np.cumprod(np.r_[_U(1), np.full(n, _BASE, _U)]), np.cumprod(np.r_[_U(1), np.full(n, inverse, _U)]))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hashes:
    """Hashes of all substrings of some bytes, from the sums of their values times powers of a base."""

    def __init__(self, data: np.ndarray) -> None:
        size = max(1 << 16, 1 << int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _stir((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))

    def all(self, size: int) -> np.ndarray:
        """Of every substring of this size."""
        n = len(self.sums) - size
        return _stir((self.sums[size:] - self.sums[:n]) * self.down[:n] + _U(size))


def least_of_windows(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest value of every `size` neighbours."""
    n = len(x) - size + 1
    padded = np.full(-(-len(x) // size) * size, np.iinfo(np.uint64).max, _U)
    padded[: len(x)] = x
    rows = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def segments(text: bytes, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """First window start, number of window starts, bucket, hash and whether it may repeat in itself of each segment of
    a text, in slices. A segment can only repeat in itself if its smallest gram stands in it twice: then the first
    one of its first window isn't the last one of its last window."""
    data, width = np.frombuffer(text, np.uint8), least - gram + 1
    for at in range(0, len(data) - least + 1, SLICE):
        part = data[at : at + SLICE + least - 1]
        h = Hashes(part)
        grams = h.all(gram)
        lowest = least_of_windows(grams, width)
        first = np.r_[0, np.flatnonzero(lowest[1:] != lowest[:-1]) + 1]
        count = np.diff(np.r_[first, len(lowest)])
        if count.max() > width:  # periodic text
            pieces = -(-count // width)
            owner = np.repeat(np.arange(len(first)), pieces)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, left = first[owner] + turn * width, count[owner] - turn * width
            count = np.minimum(left, width)
        twice, windows = np.zeros(len(first), bool), np.lib.stride_tricks.sliding_window_view(grams, width)
        for i in range(0, len(first), 4096):
            a, b = first[i : i + 4096], first[i : i + 4096] + count[i : i + 4096] - 1
            left = a + (windows[a] == lowest[a][:, None]).argmax(axis=1)
            right = b + width - 1 - (windows[b] == lowest[a][:, None])[:, ::-1].argmax(axis=1)
            twice[i : i + 4096] = left != right
        yield first + at, count, lowest[first].view(np.int64), h(first, first + count + least - 1).view(np.int64), twice


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first `depth` symbols at least, and ranks by 1, 2, 4, ... symbols."""
    n = len(symbols)
    ranks, size = [symbols.astype(np.int32) + 1], 1
    order = np.argsort(ranks[0])
    while size < depth:
        r = ranks[-1]
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - size, 0)] = r[size:]
        key = r * np.int64(int(r.max()) + 1) + ahead
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        ranks.append(rank)
        size *= 2
    return order, ranks


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to the depth of the ranks."""
    n, length = len(ranks[0]), np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        same = (x < n) & (y < n)
        same[same] = ranks[level][x[same]] == ranks[level][y[same]]
        length += same * (1 << level)
    return length


def previous_factors(positions: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest match of each suffix with one at an earlier position.

    positions: the suffixes in suffix order; common: the common prefix of each with the one before it (the first: 0).
    From the last position to the first, a suffix's neighbours in what is left of the order are its previous and
    next smaller positions; when it is taken out, they share the smaller of its two prefixes."""
    n = len(positions)
    longest = np.zeros(n, np.int64)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    shared = [*common.tolist(), 0]
    for i in np.argsort(-positions, kind="stable").tolist():
        h, j = before[i], after[i]
        with_h, with_j = shared[i], shared[j] if j >= 0 else 0
        longest[i] = with_h if with_h > with_j else with_j
        if j >= 0:
            before[j] = h
            shared[j] = with_h if with_h < with_j else with_j
        if h >= 0:
            after[h] = j
    return longest


def repeats(texts: list[bytes], least: int = LEAST, first_stays: bool = False) -> list[np.ndarray]:
    """Per text the starts of `least`-byte strings that also start elsewhere in texts, or, if first_stays, earlier."""
    sizes = np.array([len(t) for t in texts])
    symbols = np.full(int(sizes.sum()) + len(texts), 256, np.int32)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for t, a in zip(texts, starts, strict=True):
        symbols[a : a + len(t)] = np.frombuffer(t, np.uint8)
    order, ranks = suffix_order(symbols, least)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    room = starts[owner] + sizes[owner] - np.arange(len(symbols)) >= least
    order = order[room[order]]
    if not len(order):
        return [np.zeros(0, np.int64)] * len(texts)
    common = np.r_[0, common_prefix(ranks, order[:-1], order[1:])]
    near = (common >= least) | np.r_[common[1:] >= least, False]  # the others have no match of this length
    order, common = order[near], common[near]
    longest = previous_factors(order, common)
    if not first_stays:
        longest = np.maximum(longest, previous_factors(-order, common))
    found = np.sort(order[longest >= least])
    return [found[a:b] - s for s, a, b in zip(starts, np.searchsorted(found, starts), np.searchsorted(found, starts + sizes), strict=True)]


def runs(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of this size at the sorted starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > size)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + size).tolist(), strict=True))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc key and text of every row. The id is the key if no two rows share one and none is null; else a hash of id
    and text, under which equal rows are copies of one another."""
    twice = docs.groupBy(F.col(doc_id).alias("i")).count().where("count > 1 or i is null").limit(1).count()
    plain = dict(docs.dtypes)[doc_id] == "bigint" and not twice
    key = F.col(doc_id) if plain else F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return with_columns(docs, {"__qs_k": key})


def repeated_spans(rows: DataFrame, least: int = LEAST, gram: int = GRAM, first_stays: bool = False, hot: int = HOT, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """k, spans (array<struct<a, b>>, in bytes; they may overlap) of the rows (k, t: binary) that have any."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(k, *s) for k, t in zip(batch.k, batch.t, strict=True) if t is not None and len(t) >= least for s in segments(bytes(t), least, gram)]
            if got:
                yield pd.DataFrame({"k": np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1]) for g in got]), **{c: np.concatenate([g[i] for g in got]).astype(kind) for i, (c, kind) in enumerate((("s", "int32"), ("n", "int16"), ("m", "int64"), ("x", "int64"), ("own", "bool")), 1)}})

    every = stored(rows.mapInPandas(cut, "k long, s int, n short, m long, x long, own boolean"), "segments")
    shared = every.groupBy("m").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own").select("m")
    live = stored(every.join(shared, "m", "left_semi"), "live")
    # one row for each distinct segment of a bucket, with its first place
    kinds = live.groupBy("m", "x").agg(F.count("*").alias("c"), F.min(F.struct("k", "s", "n")).alias("at"), F.max("own").alias("own"))
    kinds = stored(kinds, "kinds")
    buckets = kinds.groupBy("m").agg(F.count("*").alias("distinct"), F.min("c").alias("rarest"), F.max("own").alias("own")).where("distinct > 1 or own")
    if not first_stays:
        buckets = buckets.where("rarest = 1")
    repeated = kinds.where("c > 1").select("m", "x", F.col("at.k").alias("k0"), F.col("at.s").alias("s0"))
    whole = live.join(repeated, ["m", "x"])
    if first_stays:
        whole = whole.where("k <> k0 or s <> s0")
    span = F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n") + least - 1).alias("b"))
    whole = whole.select("k", span.alias("span"))
    # texts of the segments that differ
    wanted = kinds.join(buckets.select("m", "distinct"), "m").select("m", "distinct", "at.*")
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("m", "distinct", "s", "n")).alias("of"))
    take = lambda x: F.struct(x["m"], x["distinct"], x["s"], x["n"], F.substring(F.col("t"), x["s"] + 1, x["n"] + least - 1).alias("t"))
    texts = rows.join(lists, "k").select("k", F.explode(F.transform("of", take)).alias("of")).select("k", "of.*")
    texts = stored(texts, "differing")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        size, last = 0, None
        for batch in batches:
            for row in zip(batch.k, batch.s, batch.m, batch.t, strict=True):
                if row[2] != last and size > array_bytes:
                    yield found(held)
                    held, size = [], 0
                last = row[2]
                held.append((row[0], row[1], bytes(row[3])))
                size += len(row[3])
        if held:
            yield found(held)

    def found(held: list) -> pd.DataFrame:
        held.sort(key=lambda x: x[:2])
        out = [(k, s + a, s + b) for (k, s, _), x in zip(held, repeats([t for *_, t in held], least, first_stays), strict=True) for a, b in runs(x, least)]
        return pd.DataFrame(out, columns=["k", "a", "b"]).astype({"k": "int64", "a": "int32", "b": "int32"})

    usual = texts.where(F.col("distinct") <= hot).select("k", "s", "m", "t").repartition("m").sortWithinPartitions("m", "k", "s")
    arrays = usual.mapInPandas(match, "k long, a int, b int").select("k", F.struct("a", "b").alias("span"))
    spans = whole.unionByName(arrays)
    if kinds.groupBy("m").agg(F.count("*").alias("c")).where(F.col("c") > hot).limit(1).count():
        spans = spans.unionByName(hot_spans(texts.where(F.col("distinct") > hot), least, gram, first_stays))
    return spans.groupBy("k").agg(F.collect_list("span").alias("spans"))


def hot_spans(texts: DataFrame, least: int, gram: int, first_stays: bool) -> DataFrame:
    """k, span of repeated strings in the segments (k, m, s, n, t) of buckets too large for one array.

    Segments are cut into parts of a few window starts. Parts that are equal as a whole are settled by counting;
    of the others only those whose common core recurs are compared, window by window. All counts are aggregated
    before the shuffle, so no bucket is ever gathered in one task."""

    @F.pandas_udf("array<struct<s: int, n: int, core: long, x: long>>")
    def parts(t: pd.Series, s: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for text, at, count, lowest in zip(t, s, n, m, strict=True):
            h, starts = Hashes(np.frombuffer(text, np.uint8)), np.arange(count)
            # parts are laid out from the place of the smallest gram, which equal windows share
            places = np.flatnonzero(h.all(gram).view(np.int64) == lowest)
            place = places[np.searchsorted(places, starts)]
            turn = (place - starts) // PART
            first = np.r_[0, np.flatnonzero((turn[1:] != turn[:-1]) | (place[1:] != place[:-1])) + 1]
            end = np.r_[first[1:], count]
            high = place[first] - turn[first] * PART
            core, x = h(high, high - PART + 1 + least).view(np.int64), h(first, end + least - 1).view(np.int64)
            out.append([{"s": int(at + a), "n": int(b - a), "core": int(c), "x": int(y)} for a, b, c, y in zip(first, end, core, x, strict=True)])
        return pd.Series(out, dtype=object)

    cuts = stored(texts.select("k", "m", F.explode(parts("t", "s", "n", "m")).alias("p")).select("k", "m", "p.*"), "parts")
    same = cuts.groupBy("m", "core", "x").agg(F.count("*").alias("c"), F.min(F.struct("k", "s", "n")).alias("at"))
    same = stored(same, "same-parts")
    open_ = same.groupBy("m", "core").agg(F.count("*").alias("distinct")).where("distinct > 1")
    settled = cuts.join(same.where("c > 1").select("m", "core", "x", F.col("at.k").alias("k0"), F.col("at.s").alias("s0")), ["m", "core", "x"])
    if first_stays:
        settled = settled.where("k <> k0 or s <> s0")
    span = F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n") + least - 1).alias("b"))

    @F.pandas_udf("array<long>")
    def windows(t: pd.Series) -> pd.Series:
        return pd.Series([Hashes(np.frombuffer(x, np.uint8)).all(least).view(np.int64).tolist() for x in t], dtype=object)

    compared = same.join(open_, ["m", "core"]).select("m", "at.*")
    near = texts.select("k", "m", F.col("s").alias("from"), F.col("n").alias("starts"), "t")
    near = near.join(compared, (near.k == compared.k) & (near.m == compared.m) & (compared.s >= near["from"]) & (compared.s < near["from"] + near.starts)).select(near.k, compared.s, windows(F.substring("t", compared.s - near["from"] + 1, compared.n + least - 1)).alias("w"))
    each = stored(near.select("k", "s", F.posexplode("w").alias("i", "w")).select("k", (F.col("s") + F.col("i")).alias("s"), "w"), "windows")
    twice = each.groupBy("w").agg(F.count("*").alias("c"), F.min(F.struct("k", "s")).alias("at")).where("c > 1")
    hits = each.join(twice, "w")
    if first_stays:
        hits = hits.where((F.col("k") != F.col("at.k")) | (F.col("s") != F.col("at.s")))
    return settled.select("k", span.alias("span")).unionByName(hits.select("k", F.struct(F.col("s").alias("a"), (F.col("s") + least).cast("int").alias("b")).alias("span")))


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _with_spans(docs: DataFrame, text: str, doc_id: str, **options) -> DataFrame:
    keyed = _keyed(docs, text, doc_id)
    rows = keyed.select(F.col("__qs_k").alias("k"), F.col(text).cast("binary").alias("t"))
    spans = repeated_spans(rows, **options).select(F.col("k").alias("__qs_j"), F.col("spans").alias("__qs_spans"))
    return keyed.join(spans, F.col("__qs_k") == F.col("__qs_j"), "left")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, first_stays: bool = True, **options) -> DataFrame:
    """docs without the strings of `least` bytes that stand at an earlier place too, or, if not first_stays, at any
    other place. Earlier is by id, then by place; where ids repeat or are null, by a hash of id and text in place of
    the id. Of a code point that is cut, the whole stays.

    Null and short texts stay as they are. Rows that agree in id and text are copies of each other, which lose the
    same: all of it if not first_stays, nothing for each other's sake otherwise."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            raw = t.encode()
            inner = lambda i: 0 < i < len(raw) and raw[i] & 0xC0 == 0x80
            whole = []
            for a, b in _merged(s):
                while inner(a):
                    a += 1
                while inner(b):
                    b -= 1
                whole.append((a, max(a, b)))
            out.append(_without(raw, whole).decode())
        return pd.Series(out, dtype=object)

    found = _with_spans(docs, text, doc_id, least=least, first_stays=first_stays, **options)
    return with_columns(found, {text: cut(F.col(text), F.col("__qs_spans"))}).select(docs.columns)


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, if every byte goes that a repeated string covers."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None:
                out.append((0, 0, ""))
                continue
            whole = _merged(s)
            out.append((sum(b - a for a, b in whole), len(whole), hashlib.sha256(_without(bytes(t), whole)).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    found = _with_spans(docs.select("doc_id", "text"), "text", "doc_id", first_stays=False, **options)
    has = F.col("__qs_spans").isNotNull()
    empty = F.array().cast("array<struct<a: int, b: int>>")
    out = with_columns(found, {"__qs_d": digest(F.when(has, F.col("text").cast("binary")), F.coalesce(F.col("__qs_spans"), empty))})
    t = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.when(has, F.col("__qs_d.n_removed")).otherwise(0).cast("long").alias("n_removed"), F.when(has, F.col("__qs_d.n_spans")).otherwise(0).cast("long").alias("n_spans"), F.when(has, F.col("__qs_d.kept_sha256")).otherwise(F.sha2(t, 256)).alias("kept_sha256"))
