"""Exact copies by deterministic names of blocks, after Karp, Miller and Rosenberg.

Texts are cut into blocks of a fixed number of characters. Distinct blocks are sorted and numbered: that is their name.
Then adjacent names of a text are paired, distinct pairs sorted and numbered, and so on until a text has one name.
Equal texts have equal names at the same level and no others do: names stand for whole blocks and pairs, not for
hashes of them.

Sorting is dealt by a hash: blocks are sorted by it, and those of one hash by themselves. A name is the place among the
blocks of a part of the hashes, and the part's number. Blocks and pairs are told apart before they are sorted, so one
that a third of all rows share is one row there; where names are joined back, such a key's rows are of a few numbers and
Spark splits them among tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored, with_columns

#: Characters of a block, and parts in which names are sorted.
BLOCK, PARTS = 4096, 1 << 20


def normalised(text: Column) -> Column:
    """text with one blank for each stretch of ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def blocks(text: Column, size: int) -> Column:
    """The consecutive blocks of a text, the last one shorter; an empty text is one empty block."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0))


def numbered(distinct: DataFrame) -> DataFrame:
    """h of distinct rows, each with c, how many rows have it, and name, a number for the first of them.

    Hashes are sorted within parts. Names of one part are its number and multiples of PARTS from there on, so that the
    next c - 1 names of a hash are free for its other rows."""
    hashes = distinct.groupBy("h").agg(F.count("*").alias("c")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    before = F.sum("c").over(Window.partitionBy("part").orderBy("h")) - F.col("c")
    return hashes.select("h", "c", (before * PARTS + F.col("part")).alias("name"))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (row, pos, n, h and the keys) as row, pos, n and the name of their keys.

    Blocks travel once, to be told apart. A hash that only one key has finds its name by itself; the keys of hashes that
    several share, if there are any, are sorted among themselves and joined as they are."""
    distinct = rows.select("h", *keys).distinct()
    names = stored(numbered(distinct), "block-names")
    out = rows.select("row", "pos", "n", "h").join(names.where("c = 1").select("h", "name"), "h").drop("h")
    shared = names.where("c > 1").drop("c")
    if shared.isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy("h").orderBy(*keys)) - 1
    told = distinct.join(shared, "h").select("h", *keys, (F.col("name") + place * PARTS).alias("name"))
    return out.unionByName(rows.join(told, ["h", *keys]).select("row", "pos", "n", "name"))


def identities(texts: DataFrame, size: int = BLOCK, bits: int = 64) -> DataFrame:
    """row, level and name of texts (row, t): level and name are equal where texts are, and nowhere else.

    bits: of the hashes that deal the work; fewer make blocks share them. A text of n blocks takes part in log2(n)
    rounds, each over the names that the one before wrote."""
    h = lambda *keys: F.xxhash64(*keys) if bits == 64 else F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    n = F.greatest(F.ceil(F.length("t") / size), F.lit(1)).cast("int")
    rows = texts.select("row", n.alias("n"), F.posexplode(blocks(F.col("t"), size)).alias("pos", "block")).withColumn("h", h("block"))
    level, out, keys = 0, [], ["block"]
    while True:
        rows = stored(named(rows, keys), "names")
        out.append(rows.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = rows.where("n > 1")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, out)
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = rest.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.ceil(F.max("n") / 2).cast("int").alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        rows, level, keys = pairs.withColumn("h", h("a", "b")), level + 1, ["a", "b"]


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = BLOCK, bits: int = 64) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256: of rows whose texts are equal but for the kind and length of
    white space, the one with the smallest id stays; null ids come last, and of rows with equal ids one stays.

    A null text counts as an empty one. Rows that agree in all columns are rows of their own, of which one stays. Texts
    have any length. Columns of these names are replaced. The rows are written once, numbered, to the shared folder:
    numbers then stay what they are if an executor is lost."""
    prepare(docs.sparkSession)
    row = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.monotonically_increasing_id().alias("number"))
    rows = stored(with_columns(docs, {"__qs_row": row}), "numbered")
    t = normalised(F.col(f"`{text}`"))
    found = identities(rows.select(F.col("__qs_row").alias("row"), t.alias("t")), size, bits)
    groups = found.groupBy("level", "name").agg(F.min("row").alias("keep"), F.count("*").alias("group_size"))
    answer = found.join(groups, ["level", "name"]).select(F.col("row").alias("__qs_found"), F.col("keep").alias("__qs_keep"), F.col("group_size").alias("__qs_size"))
    hashed = rows.withColumn("__qs_sha", F.sha2(t, 256))
    joined = hashed.join(answer, hashed["__qs_row"]["number"] == F.col("__qs_found.number"))
    kept = {"text_sha256": F.col("__qs_sha"), "keep_id": F.col("__qs_keep.id"), "group_size": F.col("__qs_size"), "kept": F.col("__qs_row.number") == F.col("__qs_keep.number")}
    return with_columns(joined, kept).drop("__qs_row", "__qs_sha", "__qs_found", "__qs_keep", "__qs_size")


def copy_report(docs: DataFrame) -> DataFrame:
    return exact_copies(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


COPIES_SQL = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)"""
