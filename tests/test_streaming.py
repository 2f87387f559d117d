"""Streams over files, run to their end."""

import pytest
from pyspark.sql import functions as F

from quillstream.schema import RAW_ARTICLE
from quillstream.streaming import monitor


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each one keeps state of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


ROWS = [
    (1, "s", "Ankara bugün yoğun kar yağışı altında", "2026-09-01 09:00:00", "u1"),
    (2, "s", "Ankara bugün yoğun kar yağışı altında kaldı", "2026-09-01 09:10:00", "u2"),
    (3, "s", "İzmir körfezinde temizlik çalışması başladı", "2026-09-01 09:20:00", "u1"),
    (4, "t", "Ankara bugün yoğun kar yağışı altında", "2026-09-01 09:30:00", "u1"),
]


def landed(spark, path):
    frame = lambda rows: spark.createDataFrame([(o, "i", s, "c", t, "", "", d, u, None, None) for o, s, t, d, u in rows], RAW_ARTICLE)
    frame(ROWS[:2]).coalesce(1).write.mode("append").parquet(path)
    frame(ROWS[2:]).coalesce(1).write.mode("append").parquet(path)
    return monitor.landed(spark, path, per_batch=1)


def run(query):
    ended = query.awaitTermination(60)
    query.stop()
    assert ended
    assert query.exception() is None


def test_cycles_see_every_batch_once(spark, tmp_path):
    items = landed(spark, str(tmp_path / "in"))
    seen = []
    run(monitor.cycle(items, lambda batch, n: seen.append((n, sorted(r.ord for r in batch.collect()))), str(tmp_path / "ck")))
    assert sorted(o for _, batch in seen for o in batch) == [1, 2, 3, 4] and len(seen) == 2
    run(monitor.cycle(items, lambda batch, n: seen.append(n), str(tmp_path / "ck")))
    assert len(seen) == 2


def test_links_come_once(spark, tmp_path):
    out = monitor.new_links(landed(spark, str(tmp_path / "in")))
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    got = [(r.source_name, r.link) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("s", "u1"), ("s", "u2"), ("t", "u1")]


def test_headlines_keep_state_across_batches(spark, tmp_path):
    out = monitor.new_headlines(landed(spark, str(tmp_path / "in")))
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]


def test_days_close_behind_the_watermark(spark, tmp_path):
    rows = [("2026-09-01 10:00:00", "a"), ("2026-09-01 11:00:00", "a"), ("2026-09-03 00:00:00", "b")]
    spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    out = monitor.daily_counts(events, late="1 hour")
    run(out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("2026-09-01", "a", 2)]
