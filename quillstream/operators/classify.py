"""Relevance and topics by lexicon: Column expressions over title and summary, no Python on the way."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.lexicon import Lexicon, Phrases, edged, java
from quillstream.functions.text import bound, filled

STAGE_1, STAGE_2, GENERAL, NOT_RELEVANT = "Stage 1 (Anahtar Kelime)", "Stage 2 (LLM)", "Genel (Filtresiz)", "İlgisiz"
STRICT_STAGE = "Stage 1 (Kavram Tespiti)"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def lead(title: Column, summary: Column, window: int = 350) -> Column:
    """The title and the first characters of the summary."""
    return F.concat(filled(title), F.lit(" "), F.substring(filled(summary), 1, window))


def masked(text: Column, masks: tuple[str, ...]) -> Column:
    """text with each false friend replaced by a blank, in the order of the list."""
    return reduce(lambda t, m: F.regexp_replace(t, edged(m), " "), masks, text)


def keywords_in(text: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords found, in the order of the list, repeated ones too, in one pass over the text."""
    phrases = Phrases(keywords)
    return bound(phrases.found(text), lambda found: phrases.listed(found, keywords))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(java(*words)) if words else F.lit(False)


def with_stage1(items: DataFrame, lexicon: Lexicon, title: str = "title", summary: str = "summary") -> DataFrame:
    """items with stage1: struct<is_relevant, stage, is_candidate, aspect, matched array<string>, explanation>."""
    empty = F.array().cast("array<string>")
    weak = F.array(*map(F.lit, lexicon.weak)) if lexicon.weak else empty
    first = next(iter(lexicon.countries))

    phrases = Phrases([*lexicon.keywords, *(w for words in (*lexicon.countries.values(), *lexicon.topics.values(), lexicon.union) for w in words)])

    def facts(hits: Column) -> Column:
        flags = {c: phrases.any(hits, words) for c, words in lexicon.countries.items()}
        flags[first] = flags[first] | _any(phrases.any(hits, lexicon.topics[x]) for x in lexicon.flagging)
        topic = F.lit(lexicon.default_topic)
        for name, words in reversed(lexicon.topics.items()):
            topic = F.when(phrases.any(hits, words), F.lit(name)).otherwise(topic)
        named = F.array_compact(F.array(*(F.when(f, F.lit(c)) for c, f in flags.items())))
        full = F.struct(phrases.listed(hits, lexicon.keywords).alias("found"), named.alias("named"), phrases.any(hits, lexicon.union).alias("union"), topic.alias("topic"))
        none = F.struct(empty.alias("found"), empty.alias("named"), F.lit(False).alias("union"), F.lit("").alias("topic"))
        return F.when(phrases.any(hits, lexicon.keywords), full).otherwise(none)  # countries and topics only matter beside a keyword

    def judged(f: Column) -> Column:
        found, named, n = f["found"], f["named"], F.size(f["named"])
        only_weak = (F.size(found) > 0) & F.forall(found, lambda k: F.array_contains(weak, F.lower(k)))
        union = f["union"] | _any(F.array_contains(found, F.lit(k)) for k in lexicon.union if k in lexicon.keywords)
        one = F.get(named, F.lit(0))
        aspect = F.when(union, F.lit(lexicon.union_label)).when(n > 1, F.array_join(named, ", ")).when(n == 1, F.when(one == first, F.concat(F.lit(first + ", "), f["topic"])).otherwise(one))
        return F.struct(found.alias("found"), only_weak.alias("weak"), F.when((F.size(found) > 0) & ~only_weak, aspect).alias("aspect"))

    def result(j: Column) -> Column:
        yes, found = j["aspect"].isNotNull(), j["found"]
        said = F.when(yes, F.concat(F.lit("Tespit edildi: "), j["aspect"])).when(j["weak"], F.concat(F.lit("Zayıf anahtar kelime (LLM doğrulaması gerekli): "), F.array_join(F.slice(found, 1, 3), ", "))).otherwise("")
        return F.struct(yes.alias("is_relevant"), F.when(yes, F.lit(STAGE_1)).alias("stage"), j["weak"].alias("is_candidate"), j["aspect"].alias("aspect"), F.when(yes | j["weak"], F.slice(found, 1, 5)).otherwise(empty).alias("matched"), said.alias("explanation"))

    text = masked(lead(F.col(title), F.col(summary), lexicon.window), lexicon.masks)
    return items.withColumn("stage1", bound(bound(bound(bound(text, phrases.found), facts), judged), result))


LABELS = ("ilgili_mi", "ilgi_kategorisi", "guven_skoru", "gerekce", "relevance_status", "relevance_aspect", "llm_relevance_explanation")


def labelled(items: DataFrame) -> DataFrame:
    """items with stage1 and the stored labels of relevant and other items; candidates wait as others do."""
    yes = F.col("stage1.is_relevant")
    pick = lambda a, b: F.when(yes, a).otherwise(F.lit(b))
    values = (pick(1, 0), pick(F.col("stage1.aspect"), NOT_RELEVANT), pick(0.95, 0.0), pick(F.col("stage1.explanation"), ""), pick(F.col("stage1.stage"), GENERAL), pick(F.col("stage1.aspect"), "Genel"), pick(F.col("stage1.explanation"), ""))
    return items.withColumns(dict(zip(LABELS, values, strict=True)))


def with_stage2(items: DataFrame, verdicts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """labelled items, of which candidates take the verdict of a provider.

    verdicts(candidates with id, title, summary) gives id, relevant, category, confidence, reason; no row means not
    relevant, as does a missing provider. A negative verdict has the category of what isn't relevant; the default
    confidence is 1 for a positive one and 0 for a negative."""
    if verdicts is None:
        return items
    given = verdicts(items.where("stage1.is_candidate").select("id", "title", "summary")).select(F.col("id").alias("_v"), "relevant", F.col("category").alias("_c"), "confidence", "reason")
    out = items.join(given, items.id == F.col("_v"), "left")
    judged, yes = F.col("stage1.is_candidate") & F.col("_v").isNotNull(), F.coalesce("relevant", F.lit(False))
    category = F.when(yes, filled(F.col("_c"))).otherwise(NOT_RELEVANT)
    new = (yes.cast("int"), category, F.coalesce("confidence", F.when(yes, 1.0).otherwise(0.0)), filled(F.col("reason")), F.when(yes, STAGE_2).otherwise(GENERAL), F.when(yes, category).otherwise("Genel"), filled(F.col("reason")))
    return out.withColumns({k: F.when(judged, v).otherwise(F.col(k)) for k, v in zip(LABELS, new, strict=True)}).drop("_v", "relevant", "_c", "confidence", "reason")


def reclassified(news: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A stored table judged anew: flag, category, aspect, status and explanation change, score and reason stay."""
    rows = with_stage1(news, lexicon)
    yes = F.col("stage1.is_relevant")
    return rows.withColumns({
        "ilgili_mi": yes.cast("int"),
        "ilgi_kategorisi": F.when(yes, F.col("stage1.aspect")).otherwise(NOT_RELEVANT),
        "relevance_status": F.when(yes, F.col("stage1.stage")).otherwise(GENERAL),
        "relevance_aspect": F.when(yes, F.col("stage1.aspect")).otherwise("Genel"),
        "llm_relevance_explanation": F.when(yes, F.col("stage1.explanation")).otherwise(""),
    }).drop("stage1")


def strictly_relabelled(news: DataFrame, words: tuple[str, ...], vetoes: tuple[str, ...], cues: tuple[str, ...], aspects: dict[str, tuple[str, ...]], default: str, window: int = 250) -> DataFrame:
    """A table in which only news of one country are relevant: by a word in the title, or in the first characters of
    the summary if the title has a cue (as a substring). A veto pattern in the title rules a row out. The aspect is
    the first one of which the title has a substring."""
    title, low = filled(F.col("title")), F.lower(filled(F.col("title")))
    has = lambda xs: _any(F.contains(low, F.lit(x)) for x in xs)
    veto = _any(title.rlike(edged(v)) for v in vetoes)
    yes = ~veto & (has_any(title, words) | has_any(F.substring(filled(F.col("summary")), 1, window), words) & has(cues))
    aspect = F.lit(default)
    for name, parts in reversed(aspects.items()):
        aspect = F.when(has(parts), F.lit(name)).otherwise(aspect)
    status = {"relevance_status": F.when(yes, STRICT_STAGE).otherwise(F.col("relevance_status"))} if "relevance_status" in news.columns else {}
    return news.withColumns({"ilgili_mi": yes.cast("int"), "ilgi_kategorisi": F.when(yes, aspect).otherwise(NOT_RELEVANT), **status})


def briefs(news: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Relevant rows whose summary needs one, with the text to summarise; with a provider (id, brief), the new summaries."""
    from quillstream.functions.text import needs_brief

    rows = news.where("ilgili_mi = 1").select("id", "title", F.when(needs_brief(F.col("summary")), filled(F.col("title"))).otherwise(F.col("summary")).alias("content"))
    return rows if provider is None else provider(rows)
