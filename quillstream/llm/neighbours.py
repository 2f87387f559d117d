"""Approximate nearest neighbours over balanced posting lists.

Centroids of a balanced tree over a bounded sample own the lists. A vector near the boundary of lists is put into each
of them. The centroids form a graph in memory, which a best-first search walks; of the lists found, those whose
distance is within a ratio of the nearest one's are scanned. The ratio is calibrated on the sample for a recall."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored

#: Most rows and bytes of the sample that centroids are fitted on, rows aimed at for a list. There is a list for every
#: four rows of the sample at most.
SAMPLE, SAMPLE_BYTES, LIST_ROWS = 20_000, 64_000_000, 256
#: Distances that are held at once while the index is built.
HELD = 4_000_000
#: Most copies of a vector, and how much farther than its nearest centroid the others may be.
COPIES, BOUNDARY = 3, 1.1
#: A further list is left out if its centroid is nearer to a chosen one's than this share of its distance to the vector.
APART = 0.3
#: Neighbours of a centroid in the graph, and rows of a list or of its queries that one task compares.
DEGREE, BLOCK = 24, 4096
#: Rows that walk the graph at once: what a step holds is so many rows' neighbours.
ROWS_AT_ONCE = 256
#: Recall that the ratio is calibrated for.
RECALL = 0.98


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def in_blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """squared(a, b), some rows of a at once, so that no more than about HELD distances are there."""
    step = max(1, HELD // max(len(b), 1))
    for i in range(0, len(a), step):
        yield slice(i, i + step), squared(a[i : i + step], b)


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where searches start
    ratio: float = np.inf
    usual: float = 0.0  # distance of a row to its nearest centroid: a query nearer to one counts as at this distance

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each row, nearest first, and their distances, a few rows at once."""
        parts = [self._walk(x[i : i + ROWS_AT_ONCE], width) for i in range(0, len(x), ROWS_AT_ONCE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """search() of a few rows.

        Best-first search of all rows at once: in each round every row's nearest centroids that were not yet opened
        are opened, until a round brings nothing."""
        n, width = len(x), min(width, len(self.centroids))
        if width >= len(self.centroids) // 2 or len(self.centroids) <= 64:  # the graph would be walked as a whole
            d = squared(x, self.centroids)
            at = np.argsort(d, axis=1, kind="stable")[:, :width]
            return at, np.sqrt(np.take_along_axis(d, at, axis=1))
        seen = np.zeros((n, len(self.centroids)), bool)
        found = np.tile(self.entries, (n, 1))
        seen[np.arange(n)[:, None], found] = True
        d = squared(x, self.centroids[self.entries])
        norms, own = (self.centroids**2).sum(1), (x * x).sum(1)
        opened = np.zeros(found.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            found, d, opened = (np.take_along_axis(a, order, axis=1) for a in (found, d, opened))
            row, col = np.nonzero(~opened & ((~opened).cumsum(axis=1) <= 4))
            if not len(row):
                return found, np.sqrt(d)
            opened[row, col] = True
            r, c = np.repeat(row, self.graph.shape[1]), self.graph[found[row, col]].ravel()
            fresh = np.flatnonzero(~seen[r, c])
            code = np.unique(r[fresh] * len(self.centroids) + c[fresh])
            r, c = code // len(self.centroids), code % len(self.centroids)
            seen[r, c] = True
            far = np.maximum(own[r] + norms[c] - 2 * (x[r] * self.centroids[c]).sum(1), 0)
            counts = np.bincount(r, minlength=n)
            place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            more = np.full((n, int(counts.max(initial=0))), np.inf)
            ids, shut = np.zeros(more.shape, found.dtype), np.ones(more.shape, bool)
            more[r, place], ids[r, place], shut[r, place] = far, c, False
            found, d, opened = np.hstack([found, ids]), np.hstack([d, more]), np.hstack([opened, shut])

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each copy of the vectors: the nearest list, and further ones at the boundary.

        A further list is left out if its centroid is very near to a chosen one's, so that copies spread."""
        at, d = self.search(x, 16)
        keep = np.zeros(at.shape, bool)
        keep[:, 0] = True
        for j in range(1, at.shape[1]):
            near = (d[:, j] <= BOUNDARY * d[:, 0]) & (keep.sum(axis=1) < COPIES)
            for i in range(j):
                between = np.sqrt(((self.centroids[at[:, i]] - self.centroids[at[:, j]]) ** 2).sum(1))
                near &= ~keep[:, i] | (between > APART * d[:, j])
            keep[:, j] = near
        row, col = np.nonzero(keep)
        return row, at[row, col]

    def lists_for(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of all lists that queries scan: within the ratio of the nearest one's distance.

        The search widens until its last list is beyond the ratio."""
        rows, lists, todo, width = [], [], np.arange(len(x)), 64
        while len(todo):
            at, d = self.search(x[todo], width)
            inside = d <= self.ratio * np.maximum(d[:, :1], self.usual) + 1e-12
            whole = ~inside[:, -1] | (at.shape[1] == len(self.centroids))
            r, c = np.nonzero(inside & whole[:, None])
            rows.append(todo[r])
            lists.append(at[r, c])
            todo, width = todo[~whole], width * 2
        return np.concatenate(rows), np.concatenate(lists)


def balanced_leaves(x: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of x in groups of equal size, by halving along the line between two far rows."""
    groups = [np.arange(len(x))]
    while len(groups) < leaves:
        groups.sort(key=len)
        g = groups.pop()
        if len(g) < 2:
            groups.append(g)
            break
        a = x[g[rng.integers(len(g))]]
        a = x[g[((x[g] - a) ** 2).sum(1).argmax()]]
        b = x[g[((x[g] - a) ** 2).sum(1).argmax()]]
        order = np.argsort(x[g] @ (b - a), kind="stable")
        groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    return groups


def build(sample: np.ndarray, lists: int, k: int, recall: float = RECALL, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample) // 4))
    centroids = np.stack([sample[g].mean(axis=0) for g in balanced_leaves(sample, lists, rng)])
    own, away = np.zeros(len(sample), np.int64), np.zeros(len(sample))
    for _ in range(4):  # Lloyd's rounds, in which full lists become dearer
        for at, d in in_blocks(sample, centroids):
            own[at], away[at] = d.argmin(axis=1), d.min(axis=1)
        load = np.bincount(own, minlength=len(centroids))
        dear = away.mean() * 0.1 * np.maximum(load / max(load.mean(), 1e-9) - 1, 0)
        for at, d in in_blocks(sample, centroids):
            d += dear
            own[at] = d.argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    c = len(centroids)
    near = np.zeros((c, min(DEGREE, c - 1) if c > 1 else 1), np.int64)
    for at, d in in_blocks(centroids, centroids) if c > 1 else ():
        most = near.shape[1] + 1
        best = np.argpartition(d, most - 1, axis=1)[:, :most]
        order = np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable")
        near[at] = np.take_along_axis(best, order, axis=1)[:, 1:]
    far = rng.integers(0, c, (c, 4))  # long links keep the graph connected
    index = Index(centroids, np.hstack([near, far, (np.arange(c)[:, None] + 1) % c]), np.unique(rng.integers(0, c, min(c, 16))))
    if c > 1:
        calibrate(index, sample, k, recall, rng)
    return index


def calibrate(index: Index, sample: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> None:
    """Sets the ratio at which the sample's own queries find this share of their k nearest."""
    queries = rng.choice(len(sample), min(300, len(sample)), replace=False)
    k = min(k, len(sample) - 1)
    true = np.zeros((len(queries), k), np.int64)
    for at, d in in_blocks(sample[queries], sample):
        d[np.arange(len(d)), queries[at]] = np.inf
        true[at] = np.argpartition(d, k - 1, axis=1)[:, :k]
    row, owner = index.lists_of(sample)
    of = [[] for _ in range(len(sample))]
    for r, o in zip(row.tolist(), owner.tolist(), strict=True):
        of[r].append(o)
    far = np.sqrt(squared(sample[queries], index.centroids))
    index.usual = float(np.median(far.min(axis=1)))
    far /= np.maximum(np.maximum(far.min(axis=1, keepdims=True), index.usual), 1e-12)
    needed = [far[i, of[j]].min() for i in range(len(queries)) for j in true[i].tolist()]
    index.ratio = max(1.0, float(np.quantile(needed, recall))) * (1 + 1e-9)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v: one row per id of the vectors that take part."""
    v = F.col(embedding)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (size["n"] if size else 0))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in v])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, list_rows: int = LIST_ROWS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors (id, v) found for each query (id, v), but for its own id.

    Distances are Euclidean in double precision, ties go to the smaller id. Every vector is in a list. Lists and
    their queries are cut into blocks of bounded size, whatever the lists' sizes, so a vector that many rows share
    loads no single task."""
    spark = prepare(vectors.sparkSession)
    total = vectors.count()
    chance = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) / float(1 << 30)
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    taken = vectors.where(chance < min(SAMPLE, max(SAMPLE_BYTES // (8 * width), 1000)) / max(total, 1)).select("id", "v").toPandas()
    if not len(taken):
        taken = vectors.orderBy("id").limit(1000).toPandas()
    if not len(taken):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(taken.sort_values("id").v)
    index = build(sample, 1 if total <= 4 * list_rows else total // list_rows, k, recall)
    held = spark.sparkContext.broadcast(index)

    def placed(search: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    row, owner = getattr(held.value, search)(_matrix(batch.v))
                    yield pd.DataFrame({"list": owner, "id": batch.id.to_numpy()[row], "v": batch.v.to_numpy()[row]})

        return run

    posted = stored(vectors.mapInPandas(placed("lists_of"), "list int, id long, v array<double>"), "lists")
    sizes = stored(posted.groupBy("list").agg(F.count("*").alias("rows")), "list-sizes")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, q, ids = _matrix(left.v), _matrix(right.v), left.id.to_numpy()
            for a in range(0, len(q), 256):
                rough = squared(q[a : a + 256], x)
                scale = (q[a : a + 256] ** 2).sum(1) + (x * x).sum(1).max()
                for i, d in enumerate(rough):
                    d[ids == right.id.iloc[a + i]] = np.inf
                    bound = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                    at = np.flatnonzero((d <= bound + 1e-9 * scale[i]) & (d < np.inf))
                    exact = np.sqrt(((x[at] - q[a + i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[at], exact))[:k]
                    out.append((right.id.iloc[a + i], ids[at][best], exact[best]))
        return pd.DataFrame({"query_id": np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out]), "vec_id": np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64), "score": np.concatenate([o[2] for o in out]) if out else np.zeros(0)})

    def scanned(asked: DataFrame) -> DataFrame:
        # a row for each list, of which the sample's size bounds the number
        blocks = sizes.join(asked.groupBy("list").agg(F.count("*").alias("asked")), "list")
        blocks = F.broadcast(blocks.select("list", F.ceil(F.col("rows") / block).alias("vs"), F.ceil(F.col("asked") / block).alias("qs")))
        dealt = posted.join(blocks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("vs")).alias("vb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "id", "v")
        sent = asked.join(blocks, "list").select(F.col("list").alias("q_list"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("q_vb"), F.pmod(F.xxhash64("id"), F.col("qs")).alias("q_qb"), "id", "v")
        found = dealt.groupBy("list", "vb", "qb").cogroup(sent.groupBy("q_list", "q_vb", "q_qb")).applyInPandas(compare, "query_id long, vec_id long, score double")
        each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return stored(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")

    found = scanned(stored(queries.mapInPandas(placed("lists_for"), "list int, id long, v array<double>"), "asked"))
    # a query whose lists hold fewer than k vectors gets all lists
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("id"))
    short = stored(queries.join(full, "id", "left_anti"), "short")
    if total > 1 and short.limit(1).count():
        again = short.select(F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))).alias("list"), "id", "v")
        found = found.join(full, found.query_id == full.id, "left_semi").unionByName(scanned(again))
    return found


def neighbour_report(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, **options) -> DataFrame:
    """The 10 nearest of every row whose id is divisible by `every`.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id or, where
    lengths differ, vectors of another length than the commonest. Rows of one id are one vector, the smallest."""
    prepare(embeddings.sparkSession)
    rows = stored(usable(embeddings, vec_id, embedding), "vectors")
    return nearest(rows, rows.where(F.col("id") % every == 0), **options)
