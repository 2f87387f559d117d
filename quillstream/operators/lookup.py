"""Lookups in small ordered tables: outlet categories, configured sources, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import filled
from quillstream.operators.stages import cut

OTHER = "Diğer / Sınıflandırılmamış"
# Outlets of each category, in order of precedence.
OUTLETS = {
    "Resmi / Ana Akım": ("anadolu ajansı (aa)", "aa", "trt haber", "ihlas haber ajansı (iha)", "i̇hlas haber ajansı (i̇ha)", "iha", "dha | demirören haber ajansı", "dha", "milliyet", "hürriyet", "ntv haber", "ntv", "habertürk", "cnn türk", "cnnturk.com", "bloomberght", "ekonomim"),
    "İktidar Yanlısı": ("a haber", "ahaber", "yeni şafak", "yenisafak.com", "sabah", "türkiye gazetesi", "akşam", "aksam.com.tr", "star - haberler", "star", "ülke tv", "diriliş postası", "türkgün", "superhaber", "bengütürk tv", "bengütürk", "benguturk.com", "bengü türk"),
    "Muhalif": ("sözcü", "sozcu.com.tr", "cumhuriyet", "halk tv", "t24", "t24.com.tr", "birgün", "birgun.net", "gazete duvar", "odatv", "karar", "aydınlık", "yeniçağ", "evrensel", "anka"),
}


def outlet_patterns() -> list[tuple[str, str]]:
    return [(p, c) for c, patterns in OUTLETS.items() for p in patterns]


def with_category(rows: DataFrame, patterns: list[tuple[str, str]] | DataFrame | None = None, source: str = "source_name", category: str = "category", other: str = OTHER) -> DataFrame:
    """rows with `resolved`: the category of the pattern that the source is, else of the first that holds it or is
    held by it, else the row's own unless that is the other one.

    patterns is a short list, literals of one expression that is resolved once for each distinct source, or a table
    (ord, pattern, category) of any length, joined by grams."""
    low = lambda c: F.trim(F.lower(filled(c)))
    own = F.when(filled(F.col(category)).isin("", other), F.lit(other)).otherwise(F.col(category))
    if isinstance(patterns, DataFrame):
        ranked = patterns.select("pattern", F.struct("ord", "category").alias("ord"))
        same = ranked.groupBy(F.col("pattern").alias("_e")).agg(F.min("ord")["category"].alias("_exact"))
        part = first_within(rows.select(low(F.col(source)).alias("name")), ranked).select(F.col("name").alias("_s"), F.col("found.category").alias("_part"))
        names = part.join(same, F.col("_s") == F.col("_e"), "left").select("_s", F.coalesce("_exact", "_part").alias("_found"))
        out = rows.join(names, low(rows[source]) == names["_s"], "left")
        return out.withColumn("resolved", F.coalesce("_found", own)).drop("_s", "_found")
    patterns = outlet_patterns() if patterns is None else patterns
    name = low(F.col("_s"))
    exact, part = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p, c in reversed(patterns):
        exact = F.when(name == p, F.lit(c)).otherwise(exact)
        part = F.when(F.contains(name, F.lit(p)) | F.contains(F.lit(p), name), F.lit(c)).otherwise(part)
    names = rows.select(F.col(source).alias("_s")).distinct().withColumn("_found", F.coalesce(exact, part))
    out = rows.join(names, rows[source].eqNullSafe(names["_s"]), "left")
    return out.withColumn("resolved", F.coalesce("_found", own)).drop("_s", "_found")


def _grams(text: Column, q: int) -> Column:
    """The distinct stretches of up to q characters of a text."""
    at = lambda i: F.array(*(F.substring(text, i, F.lit(n)) for n in range(1, q + 1)))
    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), at))))


def first_within(names: DataFrame, patterns: DataFrame, q: int = 3) -> DataFrame:
    """name and found, the least `ord` of patterns (pattern, ord) that a name holds or that hold it; null if none does.

    Either one is found by the rarest of its q-grams among all grams of the other; what is shorter is its own gram. So
    there is no bound on patterns, and each pair that shares that gram is compared once. An empty text is in every one.
    ord may be a struct, of which further fields come along."""
    n = names.select("name").distinct()
    p = patterns.groupBy("pattern").agg(F.min("ord").alias("ord"))
    ng = cut(n.select("name", F.explode(_grams(F.col("name"), q)).alias("g")))
    pg = cut(p.select("pattern", "ord", F.explode(_grams(F.col("pattern"), q)).alias("g")))
    often = ng.select("g").unionByName(pg.select("g")).groupBy("g").agg(F.count("*").alias("k"))

    def by_rarest(side: DataFrame, text: str) -> DataFrame:
        whole = side.where(F.length("g") == F.least(F.length(text), F.lit(q)))
        others = [c for c in side.columns if c not in (text, "g")]
        return whole.join(often, "g").groupBy(text).agg(F.min(F.struct("k", "g"))["g"].alias("g"), *(F.min(c).alias(c) for c in others))

    held = by_rarest(pg, "pattern").join(ng, "g").where(F.contains("name", "pattern"))
    holding = by_rarest(ng, "name").join(pg, "g").where(F.contains("pattern", "name"))
    found = held.select("name", "ord").unionByName(holding.select("name", "ord")).groupBy("name").agg(F.min("ord").alias("found"))
    any_, blank = p.agg(F.min("ord")).scalar(), p.where("pattern = ''").agg(F.min("ord")).scalar()
    best = F.array_min(F.array_compact(F.array(F.col("found"), blank, F.when(F.col("name") == "", any_))))
    return n.join(found, "name", "left").select("name", best.alias("found"))


def with_source(rows: DataFrame, sources: DataFrame, raw: str = "raw_source", other: str = OTHER) -> DataFrame:
    """rows with source_name and category of the first configured source (ord, name, category) whose name holds the
    raw name or is held by it, in lower case; else the raw name and the other category. Any number of sources."""
    patterns = sources.where("name is not null").select(F.lower("name").alias("pattern"), F.struct("ord", "name", "category").alias("ord"))
    low = lambda c: F.lower(filled(c))
    seen = first_within(rows.select(low(F.col(raw)).alias("name")), patterns).select(F.col("name").alias("_r"), F.col("found.name").alias("_n"), F.col("found.category").alias("_c"))
    out = rows.join(seen, low(rows[raw]) == seen["_r"], "left")
    return out.withColumn("source_name", F.coalesce("_n", F.trim(filled(F.col(raw))))).withColumn("category", F.coalesce("_c", F.lit(other))).drop("_r", "_n", "_c")


def with_provenance(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with veri_kaynagi: RSS if the configured source (name, type) of exactly this name is one, else Scraping."""
    config = sources.groupBy(F.col("name").alias("_n")).agg(F.min_by("type", "ord").alias("_t"))
    out = rows.join(F.broadcast(config), rows.source_name == config["_n"], "left")
    return out.withColumn("veri_kaynagi", F.when(F.contains(filled(F.col("_t")), F.lit("rss")), "RSS").otherwise("Scraping")).drop("_n", "_t")
