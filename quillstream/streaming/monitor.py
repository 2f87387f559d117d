"""Cycles over arriving items with Structured Streaming."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstream.functions.text import clean_leading_time, day_of, filled, title_words
from quillstream.operators.dedup import INGEST, Rule
from quillstream.schema import RAW_ARTICLE
from quillstream.sources.news_table import NewsTable

POLL = "3 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000


def landed(spark: SparkSession, path: str, schema: str = RAW_ARTICLE, per_batch: int = 1000, form: str = "parquet") -> DataFrame:
    """Items as they land as files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(path)


def cycle(items: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, poll: str | None = None):
    """Runs ingest on each batch: every `poll`, or on all there is and then ends. One query runs a batch at a time,
    so a trigger that comes while one runs waits."""
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return items.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def kept_cycle(items: DataFrame, table: NewsTable, judged: Callable[[DataFrame, DataFrame], DataFrame], as_of: Callable[[int], str], checkpoint: str, writer: str, poll: str | None = None):
    """Cycles whose outcome is kept: judged(batch, stored rows) gives the items that are upserted, as_of(batch's number)
    the moment they count as of.

    A batch is a version of the table under the writer's name and its number, so one that Spark replays after a failure
    is applied once, and one killed midway leaves the version before it."""

    def save(batch: DataFrame, n: int) -> None:
        if not table.applied(writer, n):
            table.upsert(judged(batch, table.read()), as_of(n), writer, n)

    return cycle(items, save, checkpoint, poll)


def daily_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    """Events by day and kind; on a stream, late ones count for as long as the watermark says."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    days = rows.groupBy(F.window("_ts", "1 day"), F.col(by)).agg(F.count("*").alias("events"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), by, "events")


def new_links(items: DataFrame, within: str = "2 days") -> DataFrame:
    """Items of a stream whose source and link haven't come before within the watermark."""
    rows = items.withColumn("_ts", F.try_to_timestamp("publish_date", F.lit("yyyy-MM-dd HH:mm:ss"))).withWatermark("_ts", within)
    return rows.dropDuplicatesWithinWatermark(["source_name", "link"]).drop("_ts")


def new_headlines(items: DataFrame, late: str = "2 days") -> DataFrame:
    """source_name, day, ord of items of a stream that are no near-duplicates of earlier ones of their source and day.

    The state of a source and day is the word sets kept so far; it goes when the watermark, `late` behind the newest date,
    has passed the day. Items older than the watermark are dropped. Within a batch items are seen by ord. State lives in
    RocksDB, which this sets for the session's new queries."""
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = items.withColumn("_ts", F.try_to_timestamp("publish_date", F.lit("yyyy-MM-dd HH:mm:ss"))).withWatermark("_ts", late)
    rows = rows.select("_ts", filled(F.col("source_name")).alias("source_name"), day_of(filled(F.col("publish_date"))).alias("day"), "ord", F.array_join(F.array_sort(title_words(clean_leading_time(F.col("title"), numbers=True))), " ").alias("words"))
    return rows.groupBy("source_name", "day").transformWithStateInPandas(Headlines(), "source_name string, day string, ord long", "Append", "EventTime")


class Arrivals:
    """Distinct word sets in order, of which those fall that are near an earlier one that stays.

    Sets that stay pass by one at a time, and what is near them falls; only the arrivals are held. Words are ordered by how
    many arrivals have them, rarest first and those that none has before all. A set of n words is similar to another only if
    they share one of each one's first n - ceil(similar * n) + 1 words; one that holds another has the other's first."""

    def __init__(self, sets: list[list[str]], rule: Rule) -> None:
        often = Counter(w for words in sets for w in words)
        self.rule, self.rank = rule, {w: k for k, w in enumerate(sorted(often, key=lambda w: (often[w], w)))}
        self.sets = [sorted(self.rank[w] for w in words) for words in sets]
        self.open = bytearray(b"\1" * len(sets))
        self.alike, self.first, self.whole = {}, {}, {}
        for turn, ranks in enumerate(self.sets):
            if len(ranks) >= max(rule.fewest, 1):  # others stay
                for lists, some in ((self.alike, ranks[: self._reach(len(ranks))]), (self.first, ranks[:1]), (self.whole, ranks)):
                    for w in some:
                        lists.setdefault(w, []).append(turn)

    def _reach(self, n: int) -> int:
        return n - math.ceil(self.rule.similar * n - 1e-9) + 1

    def meet(self, words: list[str]) -> None:
        """Lets fall what is near a set that stays."""
        self._meet(sorted(self.rank[w] for w in words if w in self.rank), len(words))

    def _meet(self, ranks: list[int], n: int) -> None:
        own, unknown = set(ranks), n - len(ranks)
        reach = self._reach(n) - unknown
        for k, w in enumerate(ranks):
            lists = self.alike if k < reach else self.first
            if w in lists:
                self._fall(lists, w, own, n)
        if not unknown and ranks[:1] and ranks[0] in self.whole:
            self._fall(self.whole, ranks[0], own, n)

    def _fall(self, lists: dict[int, list[int]], w: int, own: set[int], n: int) -> None:
        similar, subset, inside, closed = self.rule.similar, self.rule.subset, lists is self.whole, 0
        for turn in lists[w]:
            if not self.open[turn]:
                closed += 1
                continue
            other = self.sets[turn]
            m = len(other)
            if (n / m if n < m else m / n) < similar and not (n <= m if inside else m <= n and other[0] == w):
                continue
            both = len(own.intersection(other))
            if both / (n + m - both) >= similar or both == min(n, m) >= subset:
                self.open[turn] = 0
                closed += 1
        if 2 * closed > len(lists[w]):  # what has fallen isn't walked again
            lists[w] = [turn for turn in lists[w] if self.open[turn]]

    def stay(self) -> Iterator[int]:
        """The turns of those that stay, each of which lets later ones fall."""
        for turn, ranks in enumerate(self.sets):
            if self.open[turn]:
                self.open[turn] = 0
                self._meet(ranks, len(ranks))
                yield turn


class Headlines(StatefulProcessor):
    """Keeps headlines of one source and day that aren't near an earlier one.

    `sets` has the words of those kept, as lines in parts of LIST, as each call of the state costs more than a line. A batch
    is seen in slices: a slice is held, what is kept passes by it part by part, then its own rows do. So a batch reads
    what is kept once for each slice, and writes what it adds."""

    LIST, SLICE = 1024, 32_768

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rule = handle, INGEST
        self.sets = handle.getMapState("sets", "part int", "lines string")
        self.size = handle.getValueState("size", "kept long")

    def _parts(self, kept: int) -> Iterator[list[str]]:
        for part in range(-(-kept // self.LIST)):
            yield self.sets.getValue((part,))[0].split("\n")

    def _add(self, lines: list[str], kept: int) -> None:
        part, some = divmod(kept, self.LIST)
        lines = [*self.sets.getValue((part,))[0].split("\n"), *lines] if some and lines else lines
        for k in range(0, len(lines), self.LIST):
            self.sets.updateValue((part + k // self.LIST,), ("\n".join(lines[k : k + self.LIST]),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.size.get()[0] if self.size.exists() else 0
        if not kept:
            over = pd.to_datetime(key[1], errors="coerce")
            after = timerValues.getCurrentWatermarkInMs() + _DAY
            self.handle.registerTimer(after if pd.isna(over) else max(int(over.timestamp() * 1000) + _DAY, after))
        batch, out = pd.concat([some[["ord", "words"]] for some in rows]).sort_values(["ord", "words"]), []
        for at in range(0, len(batch), self.SLICE):
            some = batch[at : at + self.SLICE]
            turns = {line: turn for turn, line in enumerate(dict.fromkeys(some["words"]))}
            arrivals = Arrivals([line.split() for line in turns], self.rule)
            for part in self._parts(kept):
                for line in part:
                    arrivals.meet(line.split())
            stay, seen = set(arrivals.stay()), set()
            for o, line in zip(some["ord"], some["words"]):
                # of equal ones the first, but all that have too few words
                if turns[line] in stay and (line not in seen or len(arrivals.sets[turns[line]]) < self.rule.fewest):
                    out.append((*key, o))
                seen.add(line)
            new = [line for line, turn in turns.items() if line and turn in stay]
            self._add(new, kept)
            kept += len(new)
        self.size.update((kept,))
        yield pd.DataFrame(out, columns=["source_name", "day", "ord"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.sets, self.size):
            state.clear()
        yield pd.DataFrame({"source_name": pd.Series(dtype=str), "day": pd.Series(dtype=str), "ord": pd.Series(dtype="int64")})
