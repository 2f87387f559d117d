"""The stored news as a table of versions: batches that can be replayed, days that are rewritten only if they change.

Rows lie in `data/version=N/publish_day=D`. A version's folder has the days that it changed, all other days stay where an
earlier version wrote them. The log has one file for each version that is complete: the folder of every day, the batch
that made it and the largest id given so far. That file is written last, in one piece. What a killed batch left has no
line in the log, so that no reader sees it and the next try overwrites it; a batch in the log isn't applied again."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import filled
from quillstream.operators import upsert
from quillstream.operators.stages import cut
from quillstream.schema import NEWS

LOG = "version bigint, writer string, batch bigint, largest bigint, day string, data_version bigint"
UNDATED = "undated"


def day_column(date: str = "publish_date") -> Column:
    """The day a row is stored under."""
    day = F.substring(filled(F.col(date)), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(UNDATED)


class NewsTable:
    """Reads and changes the table under a path. One writer changes it at a time, as one query runs a batch at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str = NEWS) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def log(self) -> DataFrame:
        """The lines of all complete versions; none for a table that isn't there yet."""
        if not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def _exists(self, folder: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def days(self, version: int | None = None) -> list:
        """A line of the log for each day of a version, by default the last complete one. Days are few: one a day."""
        log = self.log()
        if version is None:
            version = log.agg(F.max("version")).first()[0]
        return log.where(F.col("version") == version).collect() if version is not None else []

    def applied(self, writer: str, batch: int) -> bool:
        return not self.log().where((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty()

    def read(self, only: set[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the last complete version, or of some days of it, with publish_day: filters on it prune days."""
        return self._rows([d for d in self.days(version) if d.day is not None and (only is None or d.day in only)])

    def _rows(self, days: list) -> DataFrame:
        full = f"{self.schema}, publish_day string"
        if not days:
            return self.spark.createDataFrame([], full)
        folders = [f"{self.path}/data/version={d.data_version}/publish_day={d.day}" for d in days]
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*self.spark.createDataFrame([], full).columns)

    def page(self, shown: int = 50, after: tuple[str, int] | None = None, where: Column | None = None) -> DataFrame:
        """The next `shown` rows by (publish_date, id), newest first, after a row that a page ended with.

        Days are read from the newest on, or from the row's own, one by one until the page is full: a page far behind
        costs what the first one does. Undated rows come last."""
        seek, parts, left = None, [], shown
        if after:
            here = after[0][:10] if re.fullmatch(r"\d{4}-\d{2}-\d{2}", after[0][:10]) else UNDATED
            seek = (F.col("publish_date") < after[0]) | (F.col("publish_date") == after[0]) & (F.col("id") < after[1])
        turn = lambda day: (day != UNDATED, day)
        for d in sorted((d for d in self.days() if d.day is not None), key=lambda d: turn(d.day), reverse=True):
            if not left or after and turn(d.day) > turn(here):
                continue
            rows = self._rows([d])
            rows = rows if where is None else rows.where(where)
            rows = rows.where(seek) if after and d.day == here else rows
            part = cut(rows.orderBy(F.desc("publish_date"), F.desc("id")).limit(left))
            left -= part.count()
            parts.append(part)
        return reduce(DataFrame.unionByName, parts) if parts else self._rows([])

    def _commit(self, rows: DataFrame, changed: set[str], before: list, writer: str, batch: int, largest: int | None = None) -> int:
        """Writes the rows of the changed days as the next version, then its line in the log."""
        version = max((d.version for d in before), default=-1) + 1
        data = f"{self.path}/data/version={version}"
        kinds = self.spark.createDataFrame([], self.schema).schema
        stored = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds), day_column().alias("publish_day"))
        # a day's rows meet in as many files as its size asks for; what a killed batch left in the folder goes
        stored = stored.hint("rebalance", F.col("publish_day"))
        stored.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("publish_day").parquet(data)
        written = self.spark.read.schema(f"{self.schema}, publish_day string").parquet(data) if changed else None
        found = written.groupBy("publish_day").agg(F.max("id").alias("id")).collect() if changed else []
        assert {r.publish_day for r in found} <= changed, "a row of a day that wasn't to change"
        top = max([largest or 0, *(d.largest for d in before), *(r.id for r in found)])
        lines = [(version, writer, batch, top, d.day, d.data_version) for d in before if d.day is not None and d.day not in changed]
        lines += [(version, writer, batch, top, r.publish_day, version) for r in found]
        self.spark.createDataFrame(lines or [(version, writer, batch, top, None, None)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def upsert(self, items: DataFrame, as_of: str, writer: str = "", batch: int | None = None) -> int | None:
        """Upserts items (ord and columns of news) in the order of ord; the new version, or None if this writer's batch
        is in the table already.

        Only days are read and written that have a row with one of the links or get one; of the others only links."""
        if batch is not None and self.applied(writer, batch):
            return None
        before = self.days()
        new = cut(upsert.prepared(items, as_of))
        links = new.select(F.col("link").alias("_l")).distinct()
        held = self._rows([d for d in before if d.day is not None])
        hit = held.select("publish_day", "link").join(links, F.col("link") == F.col("_l"), "left_semi").select("publish_day")
        changed = {r[0] for r in hit.union(new.select(day_column().alias("publish_day"))).distinct().collect()}
        stored = self._rows([d for d in before if d.day in changed]).drop("publish_day")
        largest = max((d.largest for d in before), default=0)
        return self._commit(upsert.merged(stored, new, as_of, largest), changed, before, writer, -1 if batch is None else batch, largest)

    def rewrite(self, change: Callable[[DataFrame], DataFrame], only: set[str] | None = None, writer: str = "", batch: int | None = None) -> int | None:
        """The next version, of which some days (by default all) are change(their rows): purges, labels, verdicts. A
        row's day stays what it was."""
        if batch is not None and self.applied(writer, batch):
            return None
        before = self.days()
        days = [d for d in before if d.day is not None and (only is None or d.day in only)]
        return self._commit(change(self._rows(days).drop("publish_day")), {d.day for d in days}, before, writer, -1 if batch is None else batch)

    def insert(self, rows: DataFrame, writer: str = "", batch: int | None = None) -> int | None:
        """The first version, of rows with ids."""
        if self.days():
            raise ValueError("the table has rows; use upsert")
        changed = {r[0] for r in rows.select(day_column()).distinct().collect()}
        return self._commit(rows, changed, [], writer, -1 if batch is None else batch)

    def forget(self, keep: int = 20) -> list[int]:
        """Deletes data folders that none of the last `keep` versions needs, and says of which versions they were.

        Readers of older versions must have ended. Lines of the log stay: they say which batches were applied."""
        log = self.log()
        newest = [r[0] for r in log.select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
        needed = {r[0] for r in log.where(F.col("version").isin(newest)).select("data_version").distinct().collect()}
        made = {r[0] for r in log.where(F.col("data_version") == F.col("version")).select("version").distinct().collect()}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = sorted(made - needed)
        for v in gone:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={v}")
            folder.getFileSystem(conf).delete(folder, True)
        return gone
