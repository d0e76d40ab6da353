"""Narration scripts: frontmatter, numbered lines, paragraphs and chapters, parsed and written again.

A script is one row, and everything about it is an expression over the array of its own lines: no line is exploded
and nothing is shuffled. Where a state runs through the lines (fences, chapters) it is counted from the short list
of the lines that change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions.text import strip, word_count

#: A top-level key with its value and the indented lines below it.
_ENTRY = r"""(?m)^[^\s#\-][^\n]*(?:\n(?:[ \t]+[^\n]*|[ \t]*(?=\n[ \t])))*"""
_KEYED = r"""(?s)^([^\s:#"'\[\]{},&*!|>%@`-][^:\n]*?)[ \t]*:(?:[ \t\n]+(.*))?$"""
_BROKEN = (
    r"""(?s)^"(?:[^"\\]|\\.)*$""", r"""(?s)^'(?:[^']|'')*$""", r"""(?s)^[\[{](?!.*[\]}]\s*(?:#.*)?$)""",
    r"""(?s)^[^"'\[{|>#].*?:(?:\s|$)""", r"^[@`%]",
)
_NOTHING = ("", "~", "null", "Null", "NULL")
_FALSE = (*_NOTHING, "0", "0.0", "false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF", "[]", "{}")
_TRUE = ("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON")


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def unwrapped(value: Column) -> Column:
    """What a YAML scalar says: without quotes, comment or block mark, on one line."""
    text = F.trim(value)
    double = F.replace(F.replace(F.regexp_extract(text, r'(?s)^"((?:[^"\\]|\\.)*)"', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(F.regexp_extract(text, r"(?s)^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)(^|\s)#.*$", ""), r"^[|>][+-]?[0-9]?\s*", "")
    said = F.when(text.startswith('"'), double).when(text.startswith("'"), single).otherwise(plain)
    return F.trim(F.regexp_replace(said, r"\s*\n\s*", " "))


def frontmatter(scripts: DataFrame) -> DataFrame:
    """`scripts` (script_id, text) with `raw` (plain line ends), `head` (lines of frontmatter, 0 without a sound one),
    `fault` (why there is no mapping, or null), and `meta`: its keys as written, the last of equal ones."""
    raw = F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    rows = scripts.withColumn("raw", raw).withColumn("block", F.regexp_extract(F.concat("raw", F.lit("\n")), P.FRONTMATTER, 0))
    rows = rows.withColumn("entries", F.regexp_extract_all(F.regexp_extract("block", P.FRONTMATTER, 1), F.lit(_ENTRY), F.lit(0)))
    rows = rows.withColumn("stray", F.regexp_extract("block", P.FRONTMATTER, 1).rlike(r"(?m)^-(?:[ \t]|$)"))
    pair = lambda e: F.struct(F.trim(F.regexp_extract(e, _KEYED, 1)).alias("key"), F.regexp_extract(e, _KEYED, 2).alias("value"))
    rows = rows.withColumn("pairs", F.transform("entries", pair))
    bad = lambda p: (p["key"] == "") | F.exists(F.array(*[F.trim(p["value"]).rlike(b) for b in _BROKEN]), lambda x: x)
    lone = (F.size("entries") == 1) & ~F.element_at("entries", 1).rlike(r":(?:\s|$)")
    fault = (
        F.when(F.col("block") == "", "missing").when(F.col("stray") & (F.size("entries") == 0), "not-a-mapping")
        .when((F.size("entries") > 0) & ~F.col("stray") & F.try_element_at("entries", F.lit(1)).isNotNull() & lone, "not-a-mapping")
        .when(F.col("stray") | F.exists("pairs", bad), "a line is no key and value")
    )
    rows = rows.withColumn("fault", fault)
    last = F.filter("pairs", lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["key"] == p["key"]))
    meta = F.when(F.col("fault").isNull(), F.map_from_arrays(F.transform(last, lambda p: p["key"]), F.transform(last, lambda p: p["value"])))
    head = F.when(F.col("fault").isNull(), _newlines(F.col("block"))).otherwise(0)
    return rows.withColumn("meta", meta).withColumn("head", head).drop("block", "entries", "stray", "pairs")


def as_text(meta: Column, key: str) -> Column:
    """A key's scalar as text: empty where the key is missing, `None` where it says nothing."""
    raw = F.trim(F.try_element_at(meta, F.lit(key)))
    word = F.when(raw.isin(*_NOTHING), "None").when(raw.isin(*_TRUE), "True").when(raw.isin("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"), "False")
    return F.when(raw.isNull(), "").otherwise(F.coalesce(word, unwrapped(raw)))


def chosen(meta: Column, key: str) -> Column:
    """A key's scalar as text, or its default where it is missing, empty, zero or false."""
    raw = F.trim(F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit("")))
    text = F.when(raw.isin(*_FALSE), "").otherwise(F.when(raw.isin(*_TRUE), "True").otherwise(unwrapped(raw)))
    return F.when(text == "", P.DEFAULTS.get(key, "")).otherwise(text)


def is_first_version(meta: Column) -> Column:
    """Whether `narration` is the number one (a quoted one is not)."""
    raw = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(meta, F.lit("narration")), F.lit("")), r"(?s)(^|\s)#.*$", ""))
    return raw.isin(*_TRUE) | raw.rlike(r"^\+?(?:0*1|1\.0*|0x0*1|0b0*1)$")


def with_lines(rows: DataFrame) -> DataFrame:
    """Rows of `frontmatter` with `lines`: (line, text, marker, fenced, level, title, chapter) of every body line.

    `level` is the heading's number of #, `chapter` counts the ## headings up to the line."""
    rows = rows.withColumn("all_lines", F.split("raw", "\n", -1)).withColumn("body", F.slice("all_lines", F.col("head") + 1, F.size("all_lines")))
    places = lambda test: F.filter(F.transform("body", lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("markers", places(lambda x, i: x.rlike(P.FENCE)))
    fenced = lambda i: F.size(F.filter("markers", lambda m: m < i)) % 2 == 1
    marker = lambda i: F.array_contains("markers", i)
    rows = rows.withColumn("heads", places(lambda x, i: x.startswith("##") & (F.regexp_extract(x, P.HEADING, 1) == "##") & ~marker(i) & ~fenced(i)))

    def line(x: Column, i: Column) -> Column:
        level = F.when(x.startswith("#") & ~marker(i) & ~fenced(i), F.length(F.regexp_extract(x, P.HEADING, 1))).otherwise(0)
        chapter = F.size(F.filter("heads", lambda h: h <= i))
        title = F.when(level > 0, strip(F.regexp_extract(x, P.HEADING, 2))).otherwise("")
        return F.struct((i + 1 + F.col("head")).alias("line"), x.alias("text"), marker(i).alias("marker"), (fenced(i) & ~marker(i)).alias("fenced"), level.alias("level"), title.alias("title"), chapter.alias("chapter"))

    return rows.withColumn("lines", F.transform("body", line)).drop("body", "markers", "heads")


def is_prose(x: Column) -> Column:
    """Whether a line of `lines` belongs to a paragraph: neither blank, fenced nor a chapter's heading."""
    return ~x["marker"] & ~x["fenced"] & (x["level"] != 2) & x["text"].rlike(r"(?U)\S")


def with_paragraphs(rows: DataFrame) -> DataFrame:
    """Rows of `with_lines` with `paragraphs`: (line, chapter, text, words) of every run of neighbouring prose lines."""
    rows = rows.withColumn("prose", F.transform("lines", is_prose))
    edge = lambda step: F.filter(F.transform("prose", lambda p, i: F.when(p & ~F.coalesce(F.get("prose", i + step), F.lit(False)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", edge(-1)).withColumn("ends", edge(1))

    def paragraph(a: Column, b: Column) -> Column:
        first = F.get("lines", a)
        text = F.array_join(F.transform(F.slice("lines", a + 1, b - a + 1), lambda x: x["text"]), " ")
        return F.struct(first["line"].alias("line"), first["chapter"].alias("chapter"), text.alias("text"), word_count(text).alias("words"))

    return rows.withColumn("paragraphs", F.zip_with("starts", "ends", paragraph)).drop("prose", "starts", "ends")


def with_chapters(rows: DataFrame) -> DataFrame:
    """Rows of `with_paragraphs` with `chapters`: (line, title, words, paragraphs); words are title's and paragraphs'."""

    def chapter(h: Column) -> Column:
        own = F.filter("paragraphs", lambda p: p["chapter"] == h["chapter"])
        words = F.aggregate(own, word_count(h["title"]), lambda n, p: n + p["words"])
        return F.struct(h["line"].alias("line"), h["title"].alias("title"), words.alias("words"), F.transform(own, lambda p: p["text"]).alias("paragraphs"))

    return rows.withColumn("chapters", F.transform(F.filter("lines", lambda x: x["level"] == 2), chapter))


def parsed(scripts: DataFrame) -> DataFrame:
    """Scripts (script_id, text) as (script_id, meta, preamble, chapters, words): the lenient reading, which never fails.

    `meta` is a struct with defaults; a paragraph's lines are stripped and joined; a heading of another level is
    prose; a ## heading without a title is no chapter but prose, too; words leave the preamble out."""
    rows = frontmatter(scripts)
    whole = F.concat("raw", F.lit("\n"))
    body = F.substring(whole, F.length(F.regexp_extract(whole, P.FRONTMATTER, 0)) + 1, F.length("raw") + 1)
    rows = with_lines(rows.withColumn("raw", F.regexp_replace(body, r"\n\z", "")).withColumn("head", F.lit(0)))
    plain = F.transform("lines", lambda x: F.when((x["level"] == 2) & (x["title"] == ""), x.withField("level", F.lit(9))).otherwise(x))
    untitled = lambda x: F.size(F.filter("lines", lambda y: (y["level"] == 2) & (y["title"] == "") & (y["line"] <= x["line"])))
    rows = rows.withColumn("lines", F.transform(plain, lambda x: x.withField("chapter", x["chapter"] - untitled(x))))
    rows = with_paragraphs(rows)
    tidy = lambda p: p.withField("text", strip(F.regexp_replace(p["text"], r"(?U)\s*\n\s*", " ")))
    rows = with_chapters(rows.withColumn("paragraphs", F.transform("paragraphs", tidy)))
    preamble = F.array_join(F.transform(F.filter("paragraphs", lambda p: p["chapter"] == 0), lambda p: p["text"]), "\n\n")
    first = F.col("meta")
    number = F.when(is_first_version(first), 1).otherwise(F.coalesce(as_text(first, "narration").try_cast("double").cast("int"), F.lit(0)))
    minutes = F.trim(F.try_element_at(first, F.lit("target_minutes")))
    meta = F.struct(
        number.alias("narration"),
        *[as_text(first, k).alias(k) for k in ("title", "source", "source_blob", "date", "author", "site")],
        *[chosen(first, k).alias(k) for k in P.DEFAULTS],
        F.when(minutes.rlike(r"^[0-9]"), unwrapped(minutes).try_cast("double").cast("int")).otherwise(unwrapped(minutes).try_cast("int")).alias("target_minutes"),
        as_text(first, "cover").alias("cover"),
    )
    total = F.aggregate("chapters", F.lit(0), lambda n, c: n + c["words"])
    return rows.select("script_id", meta.alias("meta"), preamble.alias("preamble"), F.transform("chapters", lambda c: F.struct(c["title"].alias("title"), c["words"].alias("words"), c["paragraphs"].alias("paragraphs"))).alias("chapters"), total.alias("words"))


def scalar(value: Column) -> Column:
    """Text as a YAML scalar: plain where that reads back as the same text, else in single quotes."""
    risky = (value == "") | value.rlike(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|:(?:\s|$)|\s#|\s$|^[-+.]?[0-9]") | value.isin(*_FALSE, *_TRUE) | value.rlike(r"^(?:=|<<)$")
    return F.when(risky, F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(value)


def serialised(scripts: DataFrame) -> DataFrame:
    """Parsed scripts (script_id, meta, chapters) as (script_id, text): frontmatter without empty keys, then chapters."""
    meta, empty = F.col("meta"), F.lit(None).cast("string")
    some = lambda k: F.when(meta[k] != "", F.concat(F.lit(f"{k}: "), scalar(meta[k]))).otherwise(empty)
    keys = [F.concat(F.lit("narration: "), meta["narration"].cast("string")), F.concat(F.lit("title: "), scalar(meta["title"]))]
    keys += [some(k) for k in ("source", "source_blob", "date", "author", "site")]
    keys += [F.concat(F.lit(f"{k}: "), scalar(meta[k])) for k in P.DEFAULTS]
    keys += [F.concat(F.lit("target_minutes: "), meta["target_minutes"].cast("string")), some("cover")]
    part = lambda c: F.concat(F.array(F.concat(F.lit("## "), c["title"])), c["paragraphs"])
    body = F.array_join(F.flatten(F.transform("chapters", part)), "\n\n")
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *keys), F.lit("\n---\n"), F.when(body != "", F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise(""))
    return scripts.select("script_id", F.regexp_replace(text, r"(?U)\s+\z", "\n").alias("text"))
