"""Exact and near-duplicate removal.

Keys that only need the best row of a group are windows or aggregates. Rules in which a row's fate hangs on what was
kept before it are folds over rows in order: each partition streams its groups, sorted, and holds what is kept of
one group, never the group. Large groups are split by nearness first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.dates import parse_time
from quillstream.functions.text import TITLE_STOPWORDS, bound, contained, day_of, filled, jaccard, title_key, title_words
from quillstream.operators.components import components
from quillstream.operators.filters import is_aggregator, is_promo
from quillstream.operators.stages import cut


def first_of(rows: DataFrame, keys: list, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= n).drop("_turn")


def story_key(strip_labels: bool = True) -> Column:
    """A story's key within a source: its title's, or its link if the title has no letter or digit."""
    key = title_key(F.col("title"), strip_labels)
    return F.when(key != "", F.concat(F.lit("t:"), key)).otherwise(F.concat(F.lit("l:"), filled(F.col("link"))))


def per_link(items: DataFrame) -> DataFrame:
    """The first row of each link of a source, in feed order."""
    return first_of(items, ["source_name", "link"], [F.col("ord")])


def new_stories(items: DataFrame, stored: DataFrame, order: str = "ord") -> DataFrame:
    """items whose source, day and title aren't stored, the first of each; titles without key all stay."""
    key = lambda title: F.concat(F.lit("t"), title_key(title, strip_labels=False))
    keyed = items.withColumn("_t", key(F.col("title"))).withColumn("_d", day_of(F.col("publish_date")))
    # never null, and no filter: what Spark pushed below would compute title and key again
    told = filled(bound(F.col("title"), lambda t: F.when(filled(t) != "", key(t))))
    known = stored.select(F.col("source_name").alias("_ks"), day_of(F.col("publish_date")).alias("_kd"), told.alias("_kt")).distinct()
    new = keyed.join(known, keyed.source_name.eqNullSafe(known["_ks"]) & (keyed["_d"] == known["_kd"]) & (keyed["_t"] == known["_kt"]), "left_anti")
    bare = F.col("_t") == "t"
    same = Window.partitionBy("source_name", "_d", "_t", F.when(bare, F.col(order))).orderBy(order)
    return new.withColumn("_turn", F.row_number().over(same)).where(bare | (F.col("_turn") == 1)).drop("_t", "_d", "_turn")


def for_reading(news: DataFrame) -> DataFrame:
    """The newest row of each story of a source."""
    return first_of(news.withColumn("_k", story_key()), ["source_name", "_k"], [F.desc("publish_date"), F.desc("id")]).drop("_k")


def on_storing(news: DataFrame) -> DataFrame:
    """The first row of each titled story of a source and day, with the first direct link if its own is an
    aggregator's; rows without title key stay."""
    rows = news.withColumn("_k", title_key(F.col("title"))).withColumn("_d", day_of(F.col("publish_date")))
    same = Window.partitionBy("source_name", "_d", "_k")
    first = F.row_number().over(same.orderBy("id"))
    direct = F.min(F.when(~is_aggregator(F.col("link")), F.struct("id", "link"))).over(same)
    link = F.when(is_aggregator(F.col("link")), F.coalesce(direct["link"], F.col("link"))).otherwise(F.col("link"))
    titled = rows.where("_k <> ''").withColumn("_n", first).withColumn("link", link).where("_n = 1").drop("_n")
    return titled.unionByName(rows.where("_k = ''")).drop("_k", "_d")


def best_of_stories(news: DataFrame) -> DataFrame:
    """Of each story of a source and day the row that is relevant, direct, with the longest summary, newest."""
    order = [F.desc(F.coalesce((F.col("ilgili_mi") == 1).cast("int"), F.lit(0))), F.desc((~is_aggregator(F.col("link"))).cast("int")), F.desc(F.length(filled(F.col("summary")))), F.desc("id")]
    keyed = news.withColumn("_k", story_key()).withColumn("_d", day_of(filled(F.col("publish_date"))))
    return first_of(keyed, ["source_name", "_d", "_k"], order).drop("_k", "_d")


def surplus(news: DataFrame) -> DataFrame:
    """duplicates: how many rows there are beyond one of each story of a source and day."""
    counts = news.groupBy("source_name", day_of(filled(F.col("publish_date"))).alias("day"), story_key().alias("k")).count()
    return counts.where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


@dataclass(frozen=True)
class Rule:
    """When two rows are near-duplicates, and which one stays.

    similar: Jaccard similarity of words. soon: a lower one for rows within `minutes`. subset: least size of the
    smaller set where one holds the other. fewest: rows with fewer words are kept unseen. keep: `first`; `direct`
    (a direct link, then relevance, then the longer title stays); `relevant` (relevance, then the longer title)."""

    similar: float
    subset: int = 3
    fewest: int = 0
    soon: float | None = None
    minutes: float = 60
    keep: str = "first"


INGEST = Rule(0.65, subset=1, fewest=3)
HISTORY = Rule(0.60, keep="direct")
ONE_DAY = Rule(0.65, soon=0.50, keep="relevant")


class Kept:
    """What is kept of one group, in order, with an index by word."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.rows, self.words, self.turn = rule, {}, {}, 0

    def add(self, row) -> None:
        self.rows[self.turn] = row
        for w in row.words:
            self.words.setdefault(w, []).append(self.turn)
        self.turn += 1

    def first_near(self, row) -> int | None:
        """The first kept row, in order, that is near; those without a common word can't be."""
        rule, found = self.rule, None
        for k, both in Counter(k for w in row.words for k in self.words.get(w, ()) if k in self.rows).items():
            if found is not None and k > found:
                continue
            other = self.rows[k]
            n, m = len(row.words), len(other.words)
            same = both / (n + m - both)
            near = same >= rule.similar or both == min(n, m) >= rule.subset
            if not near and rule.soon is not None and same >= rule.soon and pd.notna(row.ts) and pd.notna(other.ts):
                near = abs(row.ts - other.ts) / 60 <= rule.minutes
            if near:
                found = k
        return found

    def replaces(self, row, other) -> bool:
        if self.rule.keep == "direct":
            if other.aggregator and not row.aggregator or other.relevant == 0 and row.relevant == 1:
                return True
            return row.size > other.size and row.relevant == other.relevant and not row.aggregator
        if self.rule.keep == "relevant":
            return other.relevant == 0 and row.relevant == 1 or row.size > other.size and row.relevant == other.relevant
        return False

    def see(self, row) -> None:
        k = self.first_near(row) if len(row.words) >= self.rule.fewest else None
        if k is None:
            self.add(row)
        elif self.replaces(row, self.rows[k]):
            del self.rows[k]
            self.add(row)


#: Rows of a group that are still folded as one stream. Larger groups are split by what their rows can be near to; the
#: rows that stay are the same.
WHOLE = 500


#: Longs of a set's mask: a word sets one of their bits.
MASK = 4


def _masks() -> list[Column]:
    bit = "shiftleft(1L, cast(pmod(shiftright(xxhash64(w), 8), 64) AS int))"
    return [F.expr(f"aggregate(words, 0L, (m, w) -> m | if(pmod(xxhash64(w), {MASK}) = {i}, {bit}, 0L))").alias(f"m{i}") for i in range(MASK)]


def _missing(one: str, other: str) -> Column:
    """How many words of a set, at least, another one lacks: bits of its mask that the other's hasn't."""
    return F.expr(" + ".join(f"bit_count({one}m{i} & ~{other}m{i})" for i in range(MASK)))


def _met(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Postings of one side with those of the other's, named with an underscore, of the same word."""
    right = right.select(*(F.col(c).alias("_" + c) for c in right.columns))
    return left.join(right, [F.col(c) == F.col("_" + c) for c in ("key", *more)])


def _ranked(sets: DataFrame) -> DataFrame:
    """sets (g, rep, words, times) with their words ordered by how many sets of their group have them, rarest first, their
    number n and masks."""
    words = sets.select("g", "rep", F.explode("words").alias("w"))
    often = words.groupBy("g", "w").agg(F.count("*").alias("_n")).select(F.col("g").alias("_g"), F.col("w").alias("_w"), "_n")
    ranked = words.join(often, (F.col("g") == F.col("_g")) & (F.col("w") == F.col("_w"))).groupBy("g", "rep").agg(F.array_sort(F.collect_list(F.struct("_n", "w")))["w"].alias("words"))
    return cut(ranked.select("g", "rep", "words", F.size("words").alias("n"), *_masks()).join(sets.select("rep", "times"), "rep"))


def _posted(rows: DataFrame, least: float | None, *more: str) -> DataFrame:
    """A row for each of a set's rarest words, of all if least is None: a hash of group and word, size and masks in place
    of the words themselves, as a set of n words is posted up to n times."""
    first = F.col("n") if least is None else F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1
    out = rows.select("g", "rep", "n", *(f"m{i}" for i in range(MASK)), *more, F.explode(F.slice("words", F.lit(1), first)).alias("w"))
    return out.withColumn("key", F.xxhash64("g", "w")).drop("g", "w")


def near_pairs(ranked: DataFrame, rule: Rule) -> DataFrame:
    """a, b, each pair once: the sets of `_ranked` of a group of which some rows are near, in the order of a set's rep,
    or, for a rule with `soon`, whose words are similar enough for it and some rows close enough in time.

    Sets that are similar enough share one of their rarest words, as many as the bound leaves; a set within another shares
    its rarest one with any of the other's. Rows that must be close in time meet only in bins of that length, their own and
    the neighbouring ones. Masks rule out most pairs that meet; words decide on the others."""
    # at most so many words can be common, and so many must be
    most = F.least(F.col("n") - _missing("", "_"), F.col("_n") - _missing("_", ""))
    may = lambda least: most >= F.lit(least / (1 + least)) * (F.col("n") + F.col("_n")) - 1e-9
    matters = (F.greatest("n", "_n") >= rule.fewest) & (F.least("n", "_n") > 0)
    pair = lambda rows, least: rows.select(F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b"), F.lit(least).alias("least"))
    alike = _posted(ranked, rule.similar)
    out = pair(_met(alike, alike).where((F.col("rep") < F.col("_rep")) & matters & may(rule.similar)), rule.similar)
    small = _posted(ranked.where(F.col("n") >= rule.subset), 1.0)
    within = (F.col("n") <= F.col("_n")) & (F.col("rep") != F.col("_rep")) & (_missing("", "_") == 0)
    out = out.unionByName(pair(_met(small, _posted(ranked, None)).where(within & matters), 2.0))
    if rule.soon is not None:
        seconds = 60 * rule.minutes
        timed = _posted(ranked.select("*", F.explode("times").alias("ts")), rule.soon, "ts").withColumn("bin", F.floor(F.col("ts") / seconds))
        around = timed.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
        close = F.abs(F.col("ts") - F.col("_ts")) <= seconds
        out = out.unionByName(pair(_met(timed, around, "bin").where((F.col("rep") < F.col("_rep")) & close & matters & may(rule.soon)), rule.soon))
    out = cut(out.groupBy("a", "b").agg(F.min("least").alias("least"), (F.max("least") > 1).alias("inside")))
    one = ranked.select(F.col("rep").alias("a"), "g", "words")
    other = ranked.select(F.col("rep").alias("b"), F.col("g").alias("_g"), F.col("words").alias("_words"))
    both, n, m = F.size(F.array_intersect("words", "_words")), F.size("words"), F.size("_words")
    near = (both / (n + m - both) >= F.col("least")) | F.col("inside") & (both == F.least(n, m))
    return out.join(one, "a").join(other, "b").where((F.col("g") == F.col("_g")) & near).select("a", "b")


def _short_cover(ranked: DataFrame, rule: Rule) -> DataFrame:
    """rep of sets of `fewest` words and more that hold an earlier set of fewer words: such a set always stays."""
    size = F.col("n")
    short = _posted(ranked.where((size < rule.fewest) & (size >= rule.subset)).withColumn("held", F.col("words")), 1.0, "held")
    meet = _met(short, _posted(ranked.where(size >= rule.fewest), None)).where((F.col("rep") < F.col("_rep")) & (_missing("", "_") == 0))
    held = meet.select(F.col("_rep").alias("rep"), "held").join(ranked.select("rep", "words"), "rep")
    return held.where(F.size(F.array_except("held", "words")) == 0).select("rep").distinct()


#: Rounds in which rows are decided by their earlier neighbours before what is left is folded.
ROUNDS = 16


def _decided(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a, b), in which b falls if a stays: the nodes that fall, and the pairs that are still open.

    Each round the nodes that none comes before stay, and those they are paired with fall. In most orders few rounds
    decide all; a long chain leaves pairs open."""
    falls = None
    for _ in range(ROUNDS):
        stay = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = cut(pairs.join(stay, "a", "left_semi").select(F.col("b").alias("node")).distinct())
        falls = gone if falls is None else falls.unionByName(gone)
        pairs = cut(pairs.join(gone, F.col("a") == F.col("node"), "left_anti").join(gone, F.col("b") == F.col("node"), "left_anti"))
        if pairs.isEmpty():
            break
    return falls, pairs


def _by_nearness(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """rows (facts with words) of large groups in two parts: those that others can be near to, their group now their
    component, and those that stay because none can.

    Rows with the same words are one node. A row's fate depends only on kept rows that are near it, and so on rows of
    its component; each is folded by itself. Of rules that keep the first, each row with words enough is a node, and most are
    decided without a fold: a row that holds an earlier one of fewer words than `fewest`, which always stays, falls, and
    so do those that are near one that has none before it."""
    few = F.size("words") < rule.fewest
    # whether a set of fewer words can be near none but those that hold it
    plain = rule.fewest <= 1 or rule.subset <= 1 and rule.fewest - 2 < rule.similar * (rule.fewest + 1)
    times = F.collect_set("ts") if rule.soon is not None else F.array().cast("array<double>")  # at most the seconds of a day
    nodes = cut(rows.groupBy("g", "words").agg(F.min("o").alias("rep"), F.count("*").alias("twins"), times.alias("times")))
    ranked = _ranked(nodes)
    if rule.keep == "first" and plain:
        long = ranked.where(~few)
        long = cut(long.join(_short_cover(ranked, rule), "rep", "left_anti")) if rule.fewest > 1 else long
        falls, left = _decided(cut(near_pairs(long, rule)))
        roots = components(left)
        stay = cut(long.select(F.col("rep").alias("node")).join(falls, "node", "left_anti").join(roots, "node", "left"))
        alone = stay.where("root is null").select(F.col("node").alias("o")).unionByName(rows.where(few).select("o"))
        parts = rows.where(~few).join(stay.where("root is not null"), F.col("o") == F.col("node")).withColumn("g", F.col("root").cast("string"))
        return parts.select(rows.columns), alone
    roots = components(near_pairs(ranked, rule))
    placed = nodes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("g").alias("_g"), F.col("words").alias("_words"), "twins", F.col("root").isNull().alias("lone"), F.coalesce("root", "rep").alias("root"))
    both = rows.join(placed, (F.col("g") == F.col("_g")) & (F.col("words") == F.col("_words")))
    apart = F.col("lone") & (F.col("twins") == 1)
    return both.where(~apart).withColumn("g", F.col("root").cast("string")).select(rows.columns), both.where(apart).select("o")


def near_survivors(rows: DataFrame, rule: Rule, by: list[str] | None = None, order: str = "id", stopwords: tuple[str, ...] = TITLE_STOPWORDS, whole: int = WHOLE) -> DataFrame:
    """rows that a near-duplicate fold keeps, per source and day by default. Notices that are promotions stay unseen.

    Rows of a group are seen in order, each against those kept before it. A group of up to `whole` rows is one stream,
    a larger one is split into the components of what can be near to what, each a stream: the rows that stay are the
    same, as a row meets no others. Equal word sets of rules that keep the first are dropped before the shuffle's sort
    by a window over their hash. Rows without words stay. Titles and dates may be null."""
    by = by or ["source_name", "_day"]
    facts = rows.withColumn("_day", day_of(filled(F.col("publish_date"))))
    facts = facts.select(
        F.to_json(F.struct(*(filled(F.col(c).cast("string")).alias(c) for c in by))).alias("g"),
        F.col(order).alias("o"),
        F.array_sort(title_words(F.col("title"), stopwords)).alias("words"),
        (F.coalesce(F.col("ilgili_mi"), F.lit(0)) if "ilgili_mi" in rows.columns else F.lit(0)).alias("relevant"),
        is_aggregator(F.col("link")).alias("aggregator"),
        F.length(filled(F.col("title"))).alias("size"),
        F.unix_timestamp(parse_time(F.col("publish_date"))).cast("double").alias("ts"),
        is_promo().alias("promo") if rule.keep != "first" else F.lit(False).alias("promo"),
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, kept = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.g != group:
                    out += [r.o for r in kept.rows.values()] if kept else []
                    group, kept = row.g, Kept(rule)
                kept.see(row)
            yield pd.DataFrame({"o": pd.Series(out, dtype="int64")})
        if kept:
            yield pd.DataFrame({"o": pd.Series([r.o for r in kept.rows.values()], dtype="int64")})

    seen = facts.where("not promo")
    if rule.keep == "first":  # a later row with the same words never stays; one with few words stays unseen
        twin = F.row_number().over(Window.partitionBy("g", F.xxhash64("words"), "words").orderBy("o"))
        seen = seen.withColumn("twin", twin).where((F.col("twin") == 1) | (F.size("words") < max(rule.fewest, 1)))
        seen = seen.drop("twin")
    large = cut(facts.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("g"))
    split = not large.isEmpty()
    seen = cut(seen) if split else seen  # read once for each part
    passed = facts.where("promo").select("o").unionByName(seen.where(F.size("words") == 0).select("o"))
    seen = seen.where(F.size("words") > 0)
    if split:
        parts, alone = _by_nearness(cut(seen.join(large, "g", "left_semi")), rule)
        seen = seen.join(large, "g", "left_anti").unionByName(parts)
        passed = passed.unionByName(alone)
    ids = seen.repartition("g").sortWithinPartitions("g", "o").mapInPandas(fold, "o long").unionByName(passed)
    return rows.join(ids.withColumnRenamed("o", "_o"), rows[order] == F.col("_o"), "left_semi")


def near_survivors_in_sql(rows: DataFrame, similar: float = 0.65, by: list[str] | None = None, order: str = "id") -> DataFrame:
    """The INGEST fold as one higher-order expression over a collected group; for tests and small groups."""
    by = by or ["source_name", "_day"]
    keyed = rows.withColumn("_day", day_of(filled(F.col("publish_date"))))
    row = F.struct(F.col(order).alias("o"), F.array_sort(title_words(F.col("title"))).alias("w"))
    near = lambda a, b: (jaccard(a, b) >= similar) | contained(a, b)
    step = lambda acc, x: F.when((F.size(x["w"]) >= 3) & F.exists(acc, lambda k: (F.size(k["w"]) > 0) & near(k["w"], x["w"])), acc).otherwise(F.array_append(acc, x))
    none = F.array().cast("array<struct<o: bigint, w: array<string>>>")
    kept = keyed.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("r")).select(F.explode(F.aggregate("r", none, step)).alias("k"))
    return rows.join(kept.select(F.col("k.o").alias("_o")), rows[order] == F.col("_o"), "left_semi")


def sequential_survivors(news: DataFrame) -> DataFrame:
    """The rows an exact purge in id order leaves of each story of a source and day: a row takes the place of the one
    kept if that has an aggregator's link and it a direct one, or that isn't relevant and it is.

    Said with a window and aggregates over the stories' ids, so a story may have any number of rows."""
    facts = news.select(
        F.to_json(F.struct(filled(F.col("source_name")).alias("s"), day_of(filled(F.col("publish_date"))).alias("d"), story_key(strip_labels=False).alias("k"))).alias("g"),
        F.col("id"),
        is_aggregator(F.col("link")).alias("aggregator"),
        F.coalesce(F.col("ilgili_mi"), F.lit(0)).alias("relevant"),
    )

    # A direct and relevant row is never replaced, and replaces all others: the first such one stays. Without one,
    # direct rows and relevant ones take turns, so the first of the last run of one kind stays; rows that are
    # neither replace nothing.
    kind = F.when(~F.col("aggregator") & (F.col("relevant") == 1), 3).when(~F.col("aggregator"), 2).when(F.col("relevant") == 1, 1).otherwise(0)
    kinds = facts.withColumn("kind", kind)
    turn = kinds.where("kind in (1, 2)").withColumn("before", F.lag("kind").over(Window.partitionBy("g").orderBy("id")))
    starts = turn.where("before is null or before <> kind").groupBy("g").agg(F.max("id").alias("start"))
    first = kinds.groupBy("g").agg(F.min("id").alias("first"), F.min(F.when(F.col("kind") == 3, F.col("id"))).alias("best"))
    ids = first.join(starts, "g", "left").select(F.coalesce("best", "start", "first").alias("o"))
    return news.join(ids, news.id == F.col("o"), "left_semi")
