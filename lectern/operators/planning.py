"""Episode plans: a parsed script's chapters as spoken units, packed into chunks between an intro and an outro.

A script is one row until its chunks come out as rows, so planning shuffles nothing; only the look at the cache joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import kernels
from lectern.functions import patterns as P
from lectern.functions.text import pronounced, sentences, spoken_date, strip, word_count
from lectern.operators.packing import fit, pack


def _filled(template: str, **parts: Column) -> Column:
    """A template with its places filled, all at once, so that what fills one place is not filled again."""
    out, rest = [], template
    while rest:
        spots = [(rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest]
        at, key = min(spots) if spots else (len(rest), "")
        out.append(F.lit(rest[:at]))
        if key:
            out.append(F.coalesce(parts[key], F.lit("")))
        rest = rest[at + len(key) + 2 :] if key else ""
    return F.concat(*out) if out else F.lit("")


def intro(meta: Column, template: str = P.INTRO, research: str = ", research") -> Column:
    """The spoken opening: title, byline or `research` by kind, and date; verbatim editions have one of their own."""
    author, site, article = strip(meta["author"]), strip(meta["site"]), meta["kind"] == "article"
    byline = (
        F.when((author != "") & (site != ""), F.concat(F.lit(", by "), author, F.lit(" at "), site))
        .when(author != "", F.concat(F.lit(", by "), author)).when(site != "", F.concat(F.lit(", from "), site)).otherwise("")
    )
    phrase = F.when(article, byline).when(meta["kind"] == "research", research).otherwise("")
    day = F.when(strip(meta["date"]) != "", spoken_date(meta["date"])).otherwise("")
    when = F.when(day == "", "").otherwise(F.concat(F.when(article, ", published ").otherwise(" from "), day))
    made = lambda t: _filled(t, title=meta["title"], kind_phrase=phrase, date_phrase=when)
    return F.when(meta["edition"] == "verbatim", made(P.VERBATIM_INTRO)).otherwise(made(template)) if template == P.INTRO else made(template)


def outro(meta: Column, template: str = P.OUTRO) -> Column:
    """The spoken close; an empty template has none."""
    return _filled(template, title=meta["title"])


def chapter_units(heading: Column, paragraphs: Column, target_words: int, max_chars: int) -> Column:
    """A chapter as units to pack: long paragraphs in pieces, the heading before the first, each within `max_chars`."""
    cut = lambda p: F.when((word_count(p) > target_words) | (F.length(p) > max_chars), fit(p, max_chars)).otherwise(F.array(p))
    pieces = F.flatten(F.transform(paragraphs, cut))
    headed = F.transform(pieces, lambda u, i: F.when(i > 0, u).when(u != "", F.concat(heading, F.lit("\n\n"), u)).otherwise(heading))
    return F.flatten(F.transform(F.when(F.size(pieces) > 0, headed).otherwise(F.array(heading)), lambda u: fit(u, max_chars)))


def chunks(scripts: DataFrame, engine: str, model: str, voice: str, lexicon: dict[str, str] | None = None, style: str = "", speed: float = 1.0, rate: int = 24000, intro_template: str = P.INTRO, outro_template: str = P.OUTRO) -> DataFrame:
    """Parsed scripts as chunks: script_id, title, index (from 0), chapter_index, chapter, kind (intro, content, outro),
    text, words, cache_key and notes (chapters whose markup was cleaned). A script without chapters has its intro."""
    max_chars, target = P.LIMITS[engine]
    said = lambda t: pronounced(t, P.LEXICON if lexicon is None else lexicon)
    rows = scripts.withColumn("flat", kernels.cleaned_all(F.flatten(F.transform("chapters", lambda c: c["paragraphs"]))))
    before = lambda i: F.aggregate(F.slice("chapters", F.lit(1), i), F.lit(0), lambda n, c: n + F.size(c["paragraphs"]))
    own = lambda c, i: F.slice("flat", before(i) + 1, F.size(c["paragraphs"]))
    spoken = lambda c, i: F.filter(F.transform(own(c, i), lambda p: said(p["text"])), lambda p: p.rlike(r"(?U)\S"))
    touched = lambda c, i: F.exists(own(c, i), lambda p: (p["touched"] != "") & p["text"].rlike(r"(?U)\S"))
    rows = rows.withColumn("told", F.transform("chapters", lambda c, i: F.struct(c["title"].alias("title"), said(c["title"]).alias("heading"), spoken(c, i).alias("paragraphs"), touched(c, i).alias("touched"))))
    rows = rows.withColumn("units", F.transform("told", lambda c: chapter_units(c["heading"], c["paragraphs"], target, max_chars)))
    part = lambda i, kind, text: F.struct(i.cast("int").alias("chapter_index"), F.lit(kind).alias("kind"), text.alias("text"))
    body = F.flatten(F.transform("units", lambda u, i: F.transform(pack(u, target, max_chars), lambda t: part(i, "content", t))))
    edge = lambda i, kind, text: F.when(text != "", F.transform(fit(said(text), max_chars), lambda t: part(i, kind, t))).otherwise(F.array().cast("array<struct<chapter_index:int,kind:string,text:string>>"))
    last, some = F.size("chapters") - 1, F.size("chapters") > 0
    opening, closing = edge(F.lit(0), "intro", intro(F.col("meta"), intro_template)), edge(last, "outro", F.when(some, outro(F.col("meta"), outro_template)).otherwise(""))
    rows = rows.select("script_id", "meta.title", "told", F.posexplode_outer(F.concat(opening, body, closing)).alias("index", "c")).where("index IS NOT NULL")
    chapter = F.coalesce(F.get(F.col("told"), F.col("c.chapter_index"))["title"], "title")
    key = kernels.cache_key(F.lit(engine), F.lit(model), F.lit(voice), F.lit(style), F.lit(float(speed)), F.lit(rate), F.col("c.text"))
    notes = F.coalesce(F.get(F.col("told"), F.col("c.chapter_index"))["touched"], F.lit(False))
    return rows.select("script_id", "title", "index", "c.chapter_index", chapter.alias("chapter"), "c.kind", "c.text", word_count(F.col("c.text")).alias("words"), key.alias("cache_key"), notes.alias("cleaned"))


def chapter_plans(planned: DataFrame) -> DataFrame:
    """(script_id, chapter_index, chapter, words, chunks) of the chunks of `chunks`, intro and outro in their chapters."""
    return planned.groupBy("script_id", "chapter_index").agg(F.first("chapter").alias("chapter"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("chunks"))


def rolled_up(planned: DataFrame, usd_per_minute: Column, cache: DataFrame | None = None) -> DataFrame:
    """(script_id, title, words, chunks, cached, seconds, usd): what a render takes, and how much of it a cache
    (cache_key) has already."""
    rows = planned.withColumn("hit", F.lit(0))
    if cache is not None:
        rows = planned.join(cache.select("cache_key", F.lit(1).alias("hit")).dropDuplicates(["cache_key"]), "cache_key", "left")
    total = rows.groupBy("script_id").agg(F.first("title").alias("title"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("hit"), F.lit(0)).alias("cached"))
    seconds = F.col("words") / P.WORDS_PER_MINUTE * 60.0
    return total.withColumn("seconds", seconds).withColumn("usd", usd_per_minute * seconds / 60.0)


def bisectable(text: Column) -> Column:
    """A blocked text as the units to halve: its paragraphs if there are several, else its sentences, else itself."""
    parts = F.filter(F.transform(F.split(strip(text), r"(?U)\n\s*\n"), strip), lambda p: p != "")
    said = sentences(text)
    return F.when(F.size(parts) > 1, parts).when(F.size(said) > 0, said).otherwise(F.array(text))


def excerpt(text: Column, limit: int = P.EXCERPT) -> Column:
    """A text on one line for messages, cut with three points."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, limit - 3), r"(?U)\s+\z", "")
    return F.when(F.length(flat) > limit, F.concat(cut, F.lit("..."))).otherwise(flat)
