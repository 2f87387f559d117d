"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Once trained, each bucket's embedding times the softmax weights is a row of one score per language, where these are
few; a text's scores are the mean of the rows of its subwords. Rejection and score are calibrated on labelled rows left
out of training, rejection apart for short and long texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, with_columns

#: Buckets of subwords, size of an embedding and most training rows of a language.
BUCKETS, DIM, ROWS_PER_LANG = 1 << 15, 16, 600
#: Most training rows in all, and so most languages: with many, each has fewer rows. Most characters of a row that are learned from:
#: of a longer text, those from a place on that a hash of its id says. (Predictions are of whole texts.)
ROWS, CHARS = 20_000, 2000
#: Passes over the training rows, and those where languages outnumber an embedding's dimensions.
EPOCHS, MANY_EPOCHS = 6, 24
BATCH, RATE = 32, 40.0
#: Share of calibration rows whose evidence may fall below the rejection level, and how much of that level is kept, as
#: the lowest of a few hundred rows says little of the rarest.
REJECTED, KEPT = 0.001, 0.85
#: Up to the first many characters the level of all calibration rows holds, from the last many on that of long ones (of
#: at least LEAST_ROWS of them), and between them one that grows with the logarithm of the length.
SHORT, LONG, LEAST_ROWS = 400, 1600, 100
#: Characters of texts that are scored at once, if they aren't of one text.
SCORED = 1 << 17
_letter = regex.compile(r"\p{L}").search

#: ASCII that isn't a letter counts as a blank; upper case as lower case.
_BYTES = np.full(256, 32, np.uint8)
_BYTES[128:] = np.arange(128, 256)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[65:91] = np.arange(97, 123)
_BYTES[39] = 39
_PAD = b"    "


def subwords(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the byte 2-, 3- and 4-grams that start at each byte of the joined texts, and where each text starts and ends."""
    raw = [t.lower().encode() for t in texts]
    ends = np.cumsum([len(r) + len(_PAD) for r in raw]) + len(_PAD)
    starts = np.r_[len(_PAD), ends[:-1]] - 1  # with the blank before
    b = _BYTES[np.frombuffer(_PAD + _PAD.join(raw) + _PAD + _PAD, np.uint8)].astype(np.uint32)
    two = b[:-1] | b[1:] << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    three = four & np.uint32(0xFFFFFF)
    n = len(four)
    hashed = [((x[:n] + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(17) for k, x in ((1 << 30, two), (2 << 30, three), (0, four))]
    return hashed, starts, ends - len(_PAD)


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray  # a score per bucket and language, or with `head` the buckets' embeddings
    bias: np.ndarray
    sharpness: float = 1.0
    least: float = -np.inf  # rejection level
    least_long: float = -np.inf  # that of texts of LONG characters on
    head: np.ndarray | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.langs)), np.float64)
        i = 0
        while i < len(texts):  # some 40 bytes a character are held at once, in arrays that a worker then keeps
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < SCORED):
                size += len(texts[j])
                j += 1
            grams, starts, ends = subwords(texts[i:j])
            total = np.zeros((j - i, self.rows.shape[1]))
            for g in grams:
                for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    total[k] += self.rows[g[a:b]].sum(axis=0, dtype=np.float64)
            mean = total / (3 * np.maximum(ends - starts, 1))[:, None]
            out[i:j] = (mean if self.head is None else mean @ self.head) + self.bias
            i = j
        return out

    def level(self, chars: int) -> float:
        """The evidence below which a text of so many characters is rejected, without a step anywhere."""
        grown = min(1.0, max(0.0, math.log(max(chars, 1) / SHORT) / math.log(LONG / SHORT)))
        return self.least + grown * (self.least_long - self.least)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, confidence, and whether the evidence (the largest score) is below the level of texts as long; `und`, 0 and true for a text without a letter, or if no language was learned."""
        known = [i for i, t in enumerate(texts) if t and _letter(t)] if self.langs else []
        langs, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if known:
            raw = self.scores([texts[i] for i in known])
            for i, x, p in zip(known, raw, softmax(raw * self.sharpness), strict=True):
                langs[i], score[i] = self.langs[int(p.argmax())], min(1.0, float(p.max()))
                rejected[i] = x.max() < self.level(len(texts[i]))
        return langs, score, rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        grams, (a,), (b,) = subwords([t])
        ids, n = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
        out.append((ids, (n / n.sum()).astype(np.float32)))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of labelled (text, lang) rows; each text counts as a whole and by a short cut of its words."""
    langs = sorted({lang for t, lang in rows if t and lang is not None and _letter(t)})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    place = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    texts, y, held = [], [], []
    for k, (t, lang) in enumerate(rows):
        if not t or lang is None or not _letter(t):
            continue
        w = t.split()
        i = int(rng.integers(0, len(w)))
        cut = " ".join(w[i : i + int(rng.integers(2, 25))])
        for x in (t, cut):
            if _letter(x):
                texts.append(x)
                y.append(place[lang])
                held.append(k % 5 == 4)
    y, held = np.array(y), np.array(held) if len(rows) >= 50 else np.zeros(len(y), bool)
    bags = _counted(texts)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    train = np.flatnonzero(~held)
    epochs = EPOCHS if len(langs) <= DIM else MANY_EPOCHS
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(train)
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            ids = np.concatenate([bags[i][0] for i in part])
            weight = np.concatenate([bags[i][1] for i in part])
            sizes = [len(bags[i][0]) for i in part]
            h = np.add.reduceat(e[ids] * weight[:, None], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            g = softmax(h @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            back = g @ w.T
            w -= np.float32(rate * 0.05) * (h.T @ g)
            bias -= np.float32(0.01) * g.sum(axis=0)
            np.add.at(e, ids, -np.float32(rate) * weight[:, None] * np.repeat(back, sizes, axis=0))
    few = len(langs) <= DIM
    model = Model(langs, np.ascontiguousarray(e @ w) if few else e, bias.astype(np.float64), head=None if few else w.astype(np.float64))
    if held.any():
        calibrate(model, [texts[i] for i in np.flatnonzero(held)], y[held])
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Sharpness of the softmax by likelihood, and the evidence below which short and long texts are rejected: the
    embeddings of subwords that no language has are near zero, so their mean scores are low whatever the softmax says."""
    raw = model.scores(texts)
    loss = lambda s: -np.log(np.maximum(softmax(raw * s)[np.arange(len(y)), y], 1e-12)).mean()
    model.sharpness = float(min(np.geomspace(0.25, 64, 49), key=loss))
    if len(model.langs) > 1:
        best = raw.max(axis=1)
        level = lambda x: max(0.0, float(np.quantile(x, REJECTED))) * KEPT
        long = np.array([len(t) >= SHORT for t in texts])
        model.least = level(best)
        model.least_long = level(best[long]) if long.sum() >= LEAST_ROWS else model.least


def sample(docs: DataFrame, text: str, lang: str, row_id: str, rows_per_lang: int) -> list[tuple[str, str]]:
    """At most about rows_per_lang labelled rows of each language, chosen by a hash of their ids.

    What comes to the driver is bounded by ROWS times CHARS characters, whatever the texts' lengths. Every value of
    `lang` is learned while there are at most ROWS of them, as each takes a row; of more, the commonest."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(row_id).alias("i"))
    counts = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(ROWS).collect()
    if not counts:
        return []
    rows_per_lang = min(rows_per_lang, ROWS // len(counts))
    share = pa.table({"l": [r["l"] for r in counts], "share": [min(1.0, rows_per_lang / r["count"]) for r in counts]})
    share = docs.sparkSession.createDataFrame(share, "l string, share double")  # a list would start Python workers to convert it
    chance = F.pmod(F.xxhash64(F.lit(11), "i", "l"), F.lit(1 << 20)) / float(1 << 20)
    spare = F.greatest(F.length("t") - CHARS, F.lit(0))
    passage = F.substring(F.col("t"), (F.pmod(F.xxhash64(F.lit(13), "i"), spare + 1) + 1).cast("int"), F.lit(CHARS))
    rows = labelled.join(F.broadcast(share), "l").where(chance < F.col("share")).select(passage.alias("t"), "l").toArrow().to_pylist()
    return sorted((r["t"], r["l"]) for r in rows)


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected: evidence below the calibrated level of texts as long,
    or nothing to go by.

    Null and empty texts, and those without a letter, are `und` with score 0. prefix goes before the new names."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, score, rejected = held.value.judge(list(texts))
            yield pd.DataFrame({"lang": langs, "score": score, "rejected": rejected})

    run = run.asNondeterministic()  # so that a filter on its result doesn't run it again
    out = with_columns(docs, {"__qs_id": run(F.coalesce(F.col(text), F.lit("")))})
    return with_columns(out, {prefix + "lang_pred": F.col("__qs_id.lang"), prefix + "score": F.col("__qs_id.score"), prefix + "rejected": F.col("__qs_id.rejected")}).drop("__qs_id")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG) -> Model:
    return fit(sample(docs.where(~held_out(doc_id)), text, lang, doc_id, rows_per_lang))


def language_report(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected.

    A row for each row of docs, repeated ones with equal answers. A text without a letter (null or empty too) is `und`
    with score 0, rejected, as is every text where no row is labelled. Null ids stay null."""
    out = identify(docs.select("doc_id", "text"), learn(docs, rows_per_lang=rows_per_lang))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
