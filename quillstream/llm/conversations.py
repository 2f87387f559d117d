"""Repair of the structure of conversations by a dynamic programme over the turns that stay.

Roles must read as an optional system turn and then user and assistant in alternation, or there is no turn at all. For
each turn that stays, kept or with another role, the programme takes the cheapest last turn that stayed before it: what
is deleted in between costs a difference of prefix sums of deletions, so that for each role a running minimum of cost
less prefix sum is enough; which turns are inserted in between follows from the two roles. Among equal costs the edits
that sort first win.

A conversation may hold a third of all rows, so it is not one task's. Rows are sorted into blocks. A block's edits are
found for each role that may come before it, with the cost and role that they end in, and these short tables are joined
along the conversation; every block then gets its edits. Only a conversation's edits, a letter a turn, meet in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.llm.common import prepare, stored

#: Distinct rows of a block: 2 to this power.
BLOCK_BITS = 10
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: What is inserted between two turns that stay, by the initials of their roles ("": none yet). Edits are letters: Keep,
#: Delete, Rerole and Insert, the last two in lower case where the role is assistant.
BETWEEN = {"": {"s": "", "u": "", "a": "I"}, "s": {"u": "", "a": "I"}, "u": {"u": "i", "a": ""}, "a": {"u": "", "a": "I"}}
AT_END = {"": "", "s": "Ii", "u": "i", "a": ""}
LEGAL = {"su", "ua", "au"}


def better(a: tuple[int, str], b: tuple[int, str] | None) -> bool:
    """Whether cost and edits a come before b."""
    return b is None or a[0] < b[0] or a[0] == b[0] and a[1].upper() < b[1].upper()


class Block:
    """Cheapest edits of consecutive rows for each role before them."""

    def __init__(self, starts: str) -> None:
        # for each start and last role: cost less the deletions so far, edits up to that turn, and rows up to it
        self.paths = {e: {e: (0, "", 0)} for e in ("", *starts)}
        self.deleted = self.rows = self.illegal = 0
        self.first = self.last = None

    def add(self, initial: str, fresh: bool, truncated: bool, n: int) -> None:
        """A row that comes n times in succession; all are deleted but the first one, and it too unless it is fresh."""
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        deleted, rows = self.deleted + DELETE * n, self.rows + n
        for path in self.paths.values() if fresh else ():
            stays: dict[str, tuple[int, str]] = {}
            for role, edit, cost in ((initial, "K", 0), ("u", "R", REROLE), ("a", "r", REROLE)):
                best = None
                for before, (price, edits, upto) in path.items():
                    new = BETWEEN[before].get(role)
                    if new is not None:
                        c = price + INSERT * len(new)
                        if best is None or c <= best[0]:
                            option = (c, edits + "D" * (self.rows - upto) + new)
                            best = option if better(option, best) else best
                if best:
                    c = self.deleted + best[0] + cost + TRUNCATED * truncated + DELETE * (n - 1) - deleted
                    option = (c, best[1] + edit + "D" * (n - 1))
                    stays[role] = option if better(option, stays.get(role)) else stays[role]
            for role, (price, edits) in stays.items():
                old = path.get(role)
                if old is None or price < old[0] or price == old[0] and better((price, edits), (price, old[1] + "D" * (rows - old[2]))):
                    path[role] = (price, edits, rows)
        self.deleted, self.rows = deleted, rows

    def table(self) -> list[tuple[str, str, int, str]]:
        """Role before, last role that stays, cost and edits."""
        return [(e, x, price + self.deleted, edits + "D" * (self.rows - upto)) for e, path in self.paths.items() for x, (price, edits, upto) in path.items()]


BLOCKS = "key string, seg long, place long, illegal long, first string, last string, starts array<string>, ends array<string>, costs array<long>, edits array<string>"


def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows (key, seg, place, initial, fresh, truncated, n), sorted by seg and place."""
    now, block, place, seg = None, None, 0, None

    def row() -> tuple:
        table = block.table()
        return (*reversed(now), place, block.illegal, block.first, block.last, *(list(x) for x in zip(*table, strict=True)))

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.seg, r.key) != now:
                if block:
                    out.append(row())
                # a conversation that starts within the rows of a block has nothing before it
                now, block, seg = (r.seg, r.key), Block("sua" if r.seg != seg else ""), r.seg
            block.add(r.initial, r.fresh, r.truncated, r.n)
            place = r.place
        yield _frame(out)
    if block:
        yield _frame([row()])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in BLOCKS.split(", ")])


PARTS = "key string, seg long, place long, part string, illegal long, cost long, audit string, tail string"


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's edits (part), from blocks sorted by key and seg; the last one of a conversation has its totals."""
    now, blocks, paths, illegal, last = None, [], {}, 0, ""

    def rows() -> list[tuple]:
        best = None
        for x, (cost, edits, _) in paths.items():
            option = (cost + INSERT * len(AT_END[x]), edits + AT_END[x])
            if better(option, best):
                best, end = option, x
        parts, link = [], paths[end][2]
        while link:
            link, part = link
            parts.append(part)
        out = [(now, seg, place, part, None, None, None, None) for (seg, place), part in zip(blocks, reversed(parts), strict=True)]
        return [*out[:-1], (*out[-1][:4], illegal, best[0], best[1].upper(), AT_END[end])]

    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.key != now:
                out += rows() if blocks else []
                now, blocks, paths, illegal, last = r.key, [], {"": (0, "", None)}, 0, None
            illegal += r.illegal + (last is not None and last + r.first not in LEGAL)
            last = r.last
            new: dict[str, tuple] = {}
            for e, x, cost, edits in zip(r.starts, r.ends, r.costs, r.edits, strict=True):
                if e in paths:
                    option = (paths[e][0] + cost, paths[e][1] + edits)
                    if better(option, new.get(x)):
                        new[x] = (*option, (paths[e][2], edits))
            paths = new
            blocks.append((r.seg, r.place))
        yield _parts(out)
    if blocks:
        yield _parts(rows())


def _parts(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in PARTS.split(", ")])
    return frame.astype({"illegal": "Int64", "cost": "Int64"})


def _key() -> Column:
    """Names a conversation, null too."""
    return F.to_json(F.struct("conv_id"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns (conv_id, place, step, turn, role, text; in a conversation sorted by place and step, inserted ones
    with empty text), and a row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and
    audit, the edits' initials. Both have its key, which is never null.

    conversations has conv_id, turn, role and text; further columns take no part. Rows of a conversation come by turn,
    nulls first, then role and text. A null role or text counts as one blank, a null conv_id is a conversation of its
    own. A turn's first fault counts: blank; duplicate, its role and text came before in the conversation; truncated,
    its last character beside white space isn't one of . ! ? - blank and duplicate turns are deleted. A turn of another
    role than system, user and assistant, by its initial, can't stay as it is, nor one without a role. Equal rows are
    counted before they are sorted. gaps is null if it exceeds a long. What is sorted and solved is written to the
    shared folder, so that a lost executor's work is done anew on the same blocks."""
    spark = prepare(conversations.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(_key().alias("key"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    counted = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = lambda: F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.groupBy("key", "role", "text").agg(F.min(order()).alias("first"))
    seen = counted.join(firsts, ["key", "role", "text"])
    is_blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fresh = ~is_blank & F.col("first.turn").eqNullSafe(F.col("turn"))
    facts = seen.select("key", "turn", "role", "text", "n", is_blank.alias("blank"), fresh.alias("fresh"), (fresh & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    by = ["key", "turn", "role", "text"]
    placed = stored(facts.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("seg", F.shiftright("place", BLOCK_BITS))
    narrow = placed.select("key", "seg", "place", F.substring("role", 1, 1).alias("initial"), "fresh", "truncated", "n")
    blocks = narrow.repartition("seg").sortWithinPartitions("seg", "place").mapInPandas(solved, BLOCKS)
    parts = stored(blocks.repartition("key").sortWithinPartitions("key", "seg").mapInPandas(joined, PARTS), "edits")

    # each row's own edit is the one after those of the rows before it in its block
    turn_of = F.sum("n").over(Window.partitionBy("key", "seg").orderBy("place")) - F.col("n")
    edits = parts.select("key", "seg", F.posexplode(F.regexp_extract_all("part", F.lit("[Ii]?[KRrD]"), 0)).alias("k", "edit")).where("edit <> 'D'")
    decided = narrow.select("key", "seg", "place", turn_of.alias("k")).join(edits, ["key", "seg", "k"]).select("place", "edit")
    stays = placed.where("fresh").select("key", "turn", "role", "text", "place").join(decided, "place")
    edit, insert = F.right("edit", F.lit(1)), F.left("edit", F.lit(1))
    role = F.when(edit == "R", "user").when(edit == "r", "assistant").otherwise(F.col("role"))
    none = F.lit(None).cast(conversations.schema["turn"].dataType)
    own = F.struct(F.lit(1).alias("step"), F.col("turn").alias("turn"), role.alias("role"), F.col("text").alias("text"))
    new = lambda letter, step: F.struct(F.lit(step).alias("step"), none.alias("turn"), F.when(letter == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    made = stays.select("key", "place", F.explode(F.when(F.length("edit") == 2, F.array(new(insert, 0), own)).otherwise(F.array(own))).alias("t"))
    tail = parts.where("tail <> ''").select("key", "place", F.posexplode(F.split("tail", "")).alias("k", "letter")).select("key", "place", F.struct((F.col("k") + 2).alias("step"), none.alias("turn"), F.when(F.col("letter") == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")).alias("t"))
    conv_id = F.from_json("key", StructType([conversations.schema["conv_id"]]))["conv_id"].alias("conv_id")
    turns = made.unionByName(tail).select("key", conv_id, "place", "t.*")

    big = lambda c: c.cast("decimal(20,0)")
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by_turn = placed.groupBy("key", "turn").agg(some(F.col("blank")).alias("blank"), (some(~F.col("blank")) - F.count_if("fresh")).alias("duplicate"), F.count_if("truncated").alias("truncated"))
    span = F.coalesce(big(F.max("turn")) - big(F.min("turn")) + 1, F.lit(0)) - F.count("turn")
    counts = by_turn.groupBy("key").agg(span.try_cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    totals = parts.where("cost is not null").select("key", "illegal", "cost", "audit")
    return turns, counts.join(totals, "key").select("*", conv_id)


def digests(turns: DataFrame) -> DataFrame:
    """key and sha256, of each conversation's role:text lines. A conversation streams through one task, as the digest
    needs its bytes in order; no more than a batch of them is held."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        now, h = None, None
        for batch in batches:
            out = []
            for key, line in zip(batch["key"], batch["line"], strict=True):
                if key != now:
                    out += [(now, h.hexdigest())] if h else []
                    now, h = key, sha256()
                    h.update(line.encode())
                else:
                    h.update(b"\n" + line.encode())
            yield pd.DataFrame(out, columns=["key", "sha256"])
        if h:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["key", "sha256"])

    lines = turns.select("key", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "place", "step").select("key", "line").mapInPandas(hashed, "key string, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations of the report: by a checksum of conversation and turn, a twentieth each of the rows is dropped,
    emptied, stripped of . ! ?, repeated or said by the user. Nulls are blanks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations, damaged and repaired: faults, cost, audit and a digest of what is left.
    A conversation of which no row is left has zeros, an empty audit and the digest of an empty text."""
    turns, counts = repair(damaged(conversations))
    all_ = conversations.select("conv_id", _key().alias("key")).distinct()
    found = all_.join(counts.drop("conv_id"), "key", "left").join(digests(turns), "key", "left")
    zero = [F.when(F.col("cost").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


REPAIR_SQL = r"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda x, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda z, y: xor(z >> 1, 3988292384 * (z & 1)), xor(x, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM src),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, (VALUES (1), (2)) t(c) WHERE kind <> 0 AND (c = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
s AS (SELECT *, role[1:1] AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM o),
f AS (SELECT *, NOT blank AND seen > 1 AS dup, NOT blank AND seen = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM s),
edits(edit, before, after, new) AS (SELECT 'D', x, x, '' FROM (VALUES (''), ('s'), ('u'), ('a')) t(x) UNION ALL SELECT e, b, a, n FROM (VALUES ('K'), ('R')) k(e),
  (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'u', 'a'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'u')) t(b, a, n)),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS last, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM f
  UNION ALL SELECT conv_id, i, last, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, last ORDER BY cost, audit) AS place FROM (
    SELECT p.conv_id, f.i, e.after AS last, p.cost + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + 3 * length(new) + CASE WHEN cut AND edit <> 'D' THEN 3 ELSE 0 END AS cost, p.audit || repeat('I', length(new)) || edit AS audit,
      CASE WHEN edit = 'D' THEN p.lines ELSE list_concat(p.lines, CASE new WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE [] END, [CASE WHEN edit = 'K' THEN role WHEN e.after = 'u' THEN 'user' ELSE 'assistant' END || ':' || text]) END AS lines
    FROM dp p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN edits e ON e.before = p.last AND (edit = 'D' OR NOT blank AND NOT dup AND (edit = 'K' AND f.r = e.after OR edit = 'R' AND e.after IN ('u', 'a'))))) WHERE place = 1),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ends AS (SELECT d.conv_id, cost + 3 * length(new) AS cost, audit || repeat('I', length(new)) AS audit, list_concat(lines, CASE new WHEN 'ua' THEN ['user:', 'assistant:'] WHEN 'a' THEN ['assistant:'] ELSE [] END) AS lines
  FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i JOIN (VALUES ('', ''), ('s', 'ua'), ('u', 'a'), ('a', '')) e(last, new) USING (last) QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY cost + 3 * length(new), audit || repeat('I', length(new))) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""
