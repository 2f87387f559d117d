"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled into one stream of words, which is cut into blocks of equal size. The points
k * golden ratio (mod 1) are mapped through the cumulative targets, so every stretch of the schedule holds the
sources in nearly their shares. The r-th slot of a source takes its r-th block, starting anew after the last one;
a source stops when its target is met, its last slot being cut there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored

#: Least words of a block, and most slots of a schedule: larger corpora get larger blocks.
BLOCK_WORDS, SLOTS = 64, 1 << 19
#: A source's stream is shuffled and summed in so many parts, none of which holds more than a sliver of a hot source.
PARTS = 4096
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight, target and place.

    Sources in order of code points, null last, weigh `weights` in turn and share the sum of all sizes; none gets
    over `most` times its size, the rest being shared by weight among the others: target = min(cap, level * weight).
    There is a row for each source only, so one task sorts them."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("place", F.row_number().over(w) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    out = out.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("level", (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above))
    # the first source whose cap isn't reached sets the level of all after it
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("free", free)
    target = F.when(F.struct("ratio", "place") >= F.struct("free.ratio", "free.place"), F.col("free.level") * F.col("weight")).otherwise(F.col("cap"))
    return out.select("source", "source_size", "weight", "place", F.least(F.coalesce(target, F.col("cap")), F.col("cap")).alias("target"))


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """Slots (slot, place, turn, block, words) of the sources in plan (place, source_size, target, blocks).

    slots bounds the points drawn, whatever the corpus. A source that the points have missed at the end takes its
    remaining turns in slots after them (numbered by turn, then place), so that each target is met; a slot that
    comes after its source has met its target is left empty."""
    spark = plan.sparkSession
    plan = plan.withColumn("want", F.floor("target")).where("want > 0")
    all_ = Window.orderBy("place")
    total = F.sum("want").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = plan.withColumn("upto", F.sum("want").over(all_.rowsBetween(Window.unboundedPreceding, 0)) / total)
    ladder = edges.agg(F.array_sort(F.collect_list(F.struct("upto", "place")))).scalar()  # an entry for each source
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    last = F.get("ladder", F.size("ladder") - 1)
    first_over = F.get(F.filter("ladder", lambda x: x.upto > F.col("point")), F.lit(0))
    points = spark.range(slots).withColumn("point", point).withColumn("ladder", ladder)
    drawn = points.select(F.col("id").alias("slot"), F.coalesce(first_over.place, last.place).alias("place"))
    drawn = drawn.withColumn("turn", F.row_number().over(Window.partitionBy("place").orderBy("slot")) - 1)
    # the block of a turn: each pass through the source has the same blocks
    need = edges.select("place", "blocks", "want", "source_size")
    more = need.join(drawn.groupBy("place").agg(F.count("*").alias("drawn")), "place", "left")
    per = F.greatest(F.floor(F.col("source_size") / F.col("blocks")), F.lit(1))
    missing = more.select("place", F.explode(F.sequence(F.coalesce("drawn", F.lit(0)), F.greatest(F.coalesce("drawn", F.lit(0)), F.ceil(F.col("want") / per)))).alias("turn"))
    sources = need.agg(F.max("place") + 1).scalar()
    turns = drawn.unionByName(missing.select((F.lit(slots) + F.col("turn") * sources + F.col("place")).cast("long").alias("slot"), "place", "turn"))
    turns = turns.join(F.broadcast(need), "place").withColumn("block", F.col("turn") % F.col("blocks")).withColumn("epoch", F.floor(F.col("turn") / F.col("blocks")))
    start, end = edge("block"), edge(F.col("block") + 1)
    so_far = F.col("epoch") * F.col("source_size") + start
    return turns.withColumn("words", F.least(end - start, F.col("want") - so_far)).where("words > 0").select("slot", "place", "turn", "block", "words")


def edge(block: str | Column) -> Column:
    """First word of a block in its source's stream."""
    b = F.col(block) if isinstance(block, str) else block
    return F.call_function("div", b * F.col("source_size"), F.col("blocks"))


def stream(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """rows (source, size, h: a random-looking string for each row) with `start`, the row's first word in its source's shuffled stream.

    Two levels of sums: inside the parts of a source, and over its parts."""
    part = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % parts
    rows = rows.withColumn("part", part)
    inside = Window.partitionBy("source", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts_ = rows.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    parts_ = parts_.select(F.col("source").alias("s"), F.col("part").alias("p"), "before")
    joined = rows.join(parts_, rows.source.eqNullSafe(parts_.s) & (rows.part == parts_.p))
    return joined.withColumn("start", F.col("inside") + F.col("before")).drop("s", "p", "inside", "before", "part")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS, slots: int = SLOTS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, first_slot, n_slots.

    first_slot is the place in the schedule at which the mix first takes words of the document (null if it never
    does), n_slots the number of slots that do: a reader that goes by first_slot meets the sources in their shares.

    A null text has no words, a null source is a source of its own (the last). Repeated rows each count. Sources
    without words have target 0. Reruns agree: the shuffle is by MD5 of the id and the size. With no rows or no
    words nothing is taken."""
    spark = prepare(docs.sparkSession)
    h = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.octet_length(text), F.lit(-1)).cast("string")))
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), h.alias("h")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(sizes, weights, most), "plan")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    step = max(block_words, -(-total // slots))
    plan = plan.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.lit(step)), F.lit(1)).cast("long"))
    turns = schedule(plan, int(total // step) + 1)
    # of a block's slots only the last one of the source may be cut, so a block has full turns and at most one cut turn
    plan_ = plan.select("place", "source_size", "blocks").where("source_size > 0")
    taken = turns.join(plan_, "place").withColumn("full", F.col("words") == edge(F.col("block") + 1) - edge("block"))
    taken = taken.groupBy("place", "block").agg(F.count(F.when(F.col("full"), 1)).alias("times"), F.coalesce(F.max(F.when(~F.col("full"), F.col("words"))), F.lit(0)).alias("cut"), F.min(F.when(F.col("full"), F.col("slot"))).alias("first"), F.min(F.when(~F.col("full"), F.col("slot"))).alias("cut_slot"))
    docs_ = stream(rows)
    info = plan.select(F.col("source").alias("s"), "source_size", "target", "place", "blocks")
    docs_ = stored(docs_.join(info, docs_.source.eqNullSafe(info.s)).drop("s", "h"), "streams")
    end = F.col("start") + F.col("size")
    of = lambda word: F.call_function("div", word * F.col("blocks") + F.col("blocks") - 1, F.col("source_size"))
    pieces = docs_.where("size > 0").select("start", "size", "place", "blocks", "source_size", F.explode(F.sequence(F.least(of(F.col("start")), F.col("blocks") - 1), F.least(of(end - 1), F.col("blocks") - 1))).alias("block"))
    b0, b1 = edge("block"), edge(F.col("block") + 1)
    whole = F.greatest(F.least(end, b1) - F.greatest(F.col("start"), b0), F.lit(0))
    part = F.greatest(F.least(end, b0 + F.col("cut")) - F.greatest(F.col("start"), b0), F.lit(0))
    first = F.least(F.when(whole > 0, F.col("first")), F.when(part > 0, F.col("cut_slot")))
    n_slots = F.when(whole > 0, F.col("times")).otherwise(0) + F.when(part > 0, 1).otherwise(0)
    sums = pieces.join(taken, ["place", "block"]).groupBy("place", "start").agg(F.sum(whole * F.col("times") + part).alias("taken"), F.min(first).alias("first_slot"), F.sum(n_slots).alias("n_slots"))
    out = docs_.where("size > 0").join(sums, ["place", "start"], "left").unionByName(docs_.where("size = 0"), allowMissingColumns=True)
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(strlen(text), -1)) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, source_size * 3.0 AS cap, source_size * 3.0 / (place % 3 + 1) AS ratio FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
free AS (SELECT ratio AS r0, place AS p0, level AS l0 FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size::BIGINT AS source_size, least(CASE WHEN (ratio, place) >= (r0, p0) THEN l0 * weight ELSE cap END, cap) AS target FROM l, free),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || h[1:8])::BIGINT % 4096, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
n AS (SELECT greatest(64, (sum(size) + 524287) // 524288)::BIGINT AS step, (sum(size) // greatest(64, (sum(size) + 524287) // 524288))::BIGINT + 1 AS slots FROM d),
p AS (SELECT t.source, s.place, t.source_size, floor(target)::BIGINT AS want, greatest((t.source_size + step - 1) // step, 1) AS blocks FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source, n),
e AS (SELECT *, sum(want) OVER (ORDER BY place) / (sum(want) OVER ())::DOUBLE AS upto FROM p WHERE want > 0),
drawn AS (SELECT slot, coalesce((SELECT min(place) FROM e WHERE upto > ((slot + 1) * 0.6180339887498949::DOUBLE) % 1.0), (SELECT max(place) FROM e)) AS place FROM n, LATERAL (SELECT unnest(range(slots)) AS slot)),
turned AS (SELECT slot, place, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS turn FROM drawn),
missed AS (SELECT slots + turn * (SELECT max(place) + 1 FROM e) + place AS slot, place, turn FROM (
  SELECT place, unnest(range(n_drawn, greatest(n_drawn, ceil(want / greatest(source_size // blocks, 1)::DOUBLE)::BIGINT) + 1)) AS turn
  FROM (SELECT e.*, (SELECT count(*) FROM drawn WHERE drawn.place = e.place) AS n_drawn FROM e)), n),
turns AS (SELECT slot, place, turn, turn % blocks AS block, source_size, blocks, want, (turn // blocks) * source_size + (turn % blocks) * source_size // blocks AS so_far
  FROM (SELECT * FROM turned UNION ALL SELECT * FROM missed) JOIN e USING (place)),
slotted AS (SELECT *, block * source_size // blocks AS b0, block * source_size // blocks + least((block + 1) * source_size // blocks - block * source_size // blocks, want - so_far) AS b1 FROM turns WHERE want > so_far),
visits AS (SELECT o.source, o.start, min(slot) AS first_slot, count(*) AS n_slots
  FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source JOIN slotted x ON x.place = p.place AND x.b0 < o.start + o.size AND o.start < x.b1 WHERE o.size > 0 GROUP BY ALL)
SELECT doc_id, size, t.source_size, target, CASE WHEN t.source_size = 0 THEN 0 ELSE
  (floor(target)::BIGINT // t.source_size) * size + greatest(least(o.start + size, floor(target)::BIGINT % t.source_size) - o.start, 0) END::BIGINT AS taken,
  CASE WHEN size > 0 THEN first_slot END AS first_slot, CASE WHEN size > 0 THEN coalesce(n_slots, 0) ELSE 0 END AS n_slots
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source LEFT JOIN visits v ON o.source IS NOT DISTINCT FROM v.source AND o.start = v.start
"""
