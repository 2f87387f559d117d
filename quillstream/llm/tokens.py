"""Token counts by byte-pair merging with a heap and a linked list.

Tokens are counted, not made: a piece of n bytes of which m adjacent pairs were merged has n - m tokens."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, with_columns

#: How the byte-level vocabulary's library cuts text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode. Python's own \s has the separators \x1c-\x1f besides.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bounds of a worker's memory of counts.
REMEMBERED, LONGEST = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible in Latin-1, else the next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairCounter:
    """Counts tokens of texts as a byte-level BPE vocabulary file (JSON) gives them."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        ids = spec["model"]["vocab"]
        self.first = [ids[s] for s in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pieces = regex.compile(PIECES.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.cuts = regex.compile(f" (?=[^{SPACE}])").split
        self.odd = regex.compile(f" [{SPACE}]").search
        self.words: dict[str, int] = {}
        self.chunks = _Counts(self)

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece: repeatedly merge the adjacent pair of the lowest rank, the leftmost of equals."""
        n = left = len(piece)
        symbols = [self.first[b] for b in piece]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        find, heap = self.merges.get, []
        for i in range(n - 1):
            if found := find(symbols[i] << 32 | symbols[i + 1]):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if found := find(made << 32 | symbols[k]):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := find(symbols[h] << 32 | made)):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return left

    def chunk(self, text: str) -> int:
        """Tokens of a stretch of text that no piece leaves."""
        total = 0
        for piece in self.pieces(text):
            n = self.words.get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(piece) <= LONGEST:
                    if len(self.words) >= REMEMBERED:
                        self.words.clear()
                    self.words[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """A space that stands before a non-space opens a piece, so texts can be cut there."""
        first, *rest = self.cuts(text) if self.odd(text) else text.split(" ")
        return (self.chunk(first) if first else 0) + sum(map(self.chunks.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.added or not self.added.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.added.split(text))) + len(self.added.findall(text))


class _Counts(dict):
    """Counts of chunks that follow a space."""

    def __init__(self, counter: PairCounter) -> None:
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        n = self.counter.chunk(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE file of the `tokenizers` library, read on the driver and sent
    to the workers (its size doesn't depend on the data). A null text counts as an empty one: 0 bytes and
    0 tokens. Columns that already have these names are replaced; row order and repeated rows stay."""
    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PairCounter(spec.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    n = with_columns(docs, {"n_tokens": tokens(F.coalesce(F.col(text), F.lit("")))})
    return with_columns(n, {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": F.col("n_tokens"), "over_limit": F.col("n_tokens") > limit})
