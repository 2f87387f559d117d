"""Secret scans, with DataFrame functions only: three patterns, and character Markov models.

The models hold transitions between characters of random strings and of ordinary identifiers. A string is taken
for a secret if its log-likelihood ratio is large, both as a whole and by character."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import prepare, stored, text_key, with_columns

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs as long as they must be: a shorter run can't hold or hide a longer one, so none is matched in vain.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: kind, pattern, least characters, group they are counted in
KINDS = (("assign", ASSIGN, 8, 2), ("access", ACCESS, 16, 0), ("hex", HEX, 32, 0))
#: What the models judge, and the strings that can hold one.
CANDIDATE, LEAST_CHARS = "[A-Za-z0-9+/_=-]{20,}", 20
#: Documents that can hold any span: others are passed by. Each kind's own pattern decides.
ANY = r"""AKIA[A-Z0-9]{12}|[A-Za-z0-9+/_=-]{20}|(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])"""
#: The models' characters; all others count as the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Least log-likelihood ratio of a secret, in nats: whole and by transition.
LEAST_WHOLE, LEAST_MEAN = 12.0, 0.35

_PARTS = "get set user name account list map index count total value data file path read write open close node tree item order page text line word table column row key group start end time date price rate size type class object string number field form view model state event action handler service client server request response error message config option default parent child first last next previous update delete create insert select filter sort merge join split parse format render load save cache queue worker thread process memory buffer stream record schema query result report summary detail image color width height margin border header footer content title label button panel window frame layout the and for with from this that have been which their would there could about other into more some them these than"


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """word, secret: random strings in four alphabets; identifiers joined from ordinary words in eight styles, and rulers.

    Made from row numbers by hashing, so they are the same in each run."""
    n = spark.range(rows)
    digest = lambda i: F.sha2(F.concat(F.lit(f"{i}:"), F.col("id").cast("string")), 256)
    kind = lambda n: F.col("id") % n
    base64 = F.substring(F.base64(F.unhex(digest(1))), 1, 40)
    random = F.when(kind(4) == 0, base64).when(kind(4) == 1, F.translate(base64, "+/", "-_")).when(kind(4) == 2, F.translate(base64, "+/=", "xK7")).otherwise(F.substring(digest(2), 1, 40))
    parts = _PARTS.split()
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(i), F.col("id")), F.lit(len(xs))) + 1).cast("int"))
    w = [pick(parts, i) for i in range(4)]
    styles = [F.concat_ws("_", *w), F.concat_ws("-", *w), F.concat(w[0], *map(F.initcap, w[1:])), F.concat(*w), F.concat_ws("/", *w), F.concat_ws(".", *w), F.upper(F.concat_ws("_", *w)), F.concat(w[0], F.lit("_"), w[1], F.lit("_"), (F.col("id") % 2100).cast("string")), F.repeat(pick("-=_./+*#", 9), F.lit(40))]
    ordinary = F.element_at(F.array(*styles), (kind(len(styles)) + 1).cast("int"))
    return n.select(random.alias("word"), F.lit(True).alias("secret")).unionByName(n.select(ordinary.alias("word"), F.lit(False).alias("secret")))


def _codes(word: Column) -> Column:
    """Places of the characters in the alphabet, from 0 on."""
    chars = F.split(word, "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.call_function("locate", c, F.lit(ALPHABET)) - 1).otherwise(len(ALPHABET)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row, from samples (word, secret) with one added to each count.

    The size of the table is fixed by the alphabet; null and one-character words add nothing."""
    n = len(ALPHABET) + 1
    codes = samples.where("word is not null and secret is not null").select("secret", _codes(F.col("word")).alias("c"))
    pairs = codes.select("secret", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    counts = {(r.secret, r.a, r.b): r.n for r in pairs.groupBy("secret", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).collect()}
    table = []
    for a in range(n):
        totals = [sum(counts.get((s, a, b), 0) for b in range(n)) + n for s in (True, False)]
        table += [log((counts.get((True, a, b), 0) + 1) / totals[0]) - log((counts.get((False, a, b), 0) + 1) / totals[1]) for b in range(n)]
    return table


def ratio(word: Column, table: list[float]) -> Column:
    """Sum of a word's transitions' log-likelihood ratios."""
    n = len(ALPHABET) + 1
    held = F.split(F.lit(" ".join(map(repr, table))), " ").cast("array<double>")  # one literal, folded once
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    add = lambda acc, c: F.struct((acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(held, acc["last"] * n + c + 1))).alias("sum"), c.alias("last"))
    return F.aggregate(_codes(word), zero, add, lambda acc: acc["sum"])


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern, in order: what stands before each, the match and its group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    return F.zip_with(F.arrays_zip(whole.alias("whole"), part.alias("part")), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m["whole"]).alias("chars"), F.length(m["part"]).alias("counted"), m["whole"].alias("word")))


def scan(docs: DataFrame, text: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """docs with spans: array<struct<start, rank, end, kind>> in order (code points, end exclusive); rank is the
    place of the kind: assign, access, hex, markov.

    samples (word, secret) train the models; labelled_samples() if None. Spans of the models never touch those of
    the patterns. A null or empty text has no spans; equal rows get equal spans, rows without any stay."""
    spark = prepare(docs.sparkSession)
    table = train(labelled_samples(spark) if samples is None else samples)
    keyed = with_columns(docs, {"__qs_key": text_key(text)})
    texts = keyed.select("__qs_key", F.col(text).alias("__qs_text")).where(F.col("__qs_text").rlike(ANY))
    kinds = (*KINDS, ("markov", CANDIDATE, LEAST_CHARS, 0))
    found = F.array(*(F.struct(F.lit(k).alias("rank"), _found(F.col("__qs_text"), pattern, group).alias("m")) for k, (_, pattern, _, group) in enumerate(kinds)))
    each = texts.select("__qs_key", F.explode(found).alias("f")).select("__qs_key", "f.rank", F.posexplode("f.m").alias("i", "m"))
    each = each.select("__qs_key", "rank", "i", "m.gap", "m.chars", "m.counted", F.when(F.col("rank") == 3, F.col("m.word")).alias("word")).dropDuplicates(["__qs_key", "rank", "i"])
    upto = Window.partitionBy("__qs_key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("chars")).over(upto)).withColumn("start", F.col("end") - F.col("chars"))
    least = F.element_at(F.array(*(F.lit(n) for _, _, n, _ in kinds)), F.col("rank") + 1)
    placed = placed.where(F.col("counted") >= least)
    # one pass over the texts: only candidates are scored, base spans go through as they are
    score = F.when(F.col("rank") == 3, ratio(F.col("word"), table))
    random = (score >= LEAST_WHOLE) & (score >= LEAST_MEAN * (F.col("chars") - 1))
    spans = placed.where((F.col("rank") < 3) | random).select("__qs_key", F.struct(F.col("start").cast("int").alias("start"), F.col("rank").cast("int").alias("rank"), F.col("end").cast("int").alias("end")).alias("span"))
    per = spans.groupBy("__qs_key").agg(F.array_sort(F.collect_list("span")).alias("__qs_all"))
    base = F.filter("__qs_all", lambda s: s["rank"] < 3)
    apart = F.filter("__qs_all", lambda s: (s["rank"] < 3) | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    names = F.array(*(F.lit(k) for k, *_ in kinds))
    per = per.select("__qs_key", F.transform(apart, lambda s: F.struct(s["start"], s["rank"], s["end"], F.element_at(names, s["rank"] + 1).alias("kind"))).alias("__qs_spans"))
    # stored, so that copies of one text beyond a task's share can be split from one another when they are joined
    per = stored(per, "spans")
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    return with_columns(keyed.join(per, "__qs_key", "left"), {"spans": F.coalesce(F.col("__qs_spans"), none)}).drop("__qs_key", "__qs_spans")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", samples: DataFrame | None = None) -> DataFrame:
    """docs with each span of the text replaced by `mark`; overlapping spans share one."""
    found = scan(docs, text, samples)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col(text)
    add = lambda acc, s: F.struct(F.when(s["end"] <= acc["at"], acc["out"]).when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    clean = F.aggregate("spans", zero, add, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return with_columns(found, {text: F.when(F.size("spans") > 0, clean).otherwise(t)}).drop("spans")


def secret_report(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text.

    A row for each row of docs, repeated ones too. A null or empty text has no spans: zeros, the digest of the empty
    string and an empty text. Null ids stay null; other columns are not read."""
    found = scan(docs.select("doc_id", "text"), samples=samples)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))

