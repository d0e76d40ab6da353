"""Rules that turn Markdown blocks into spoken chapters and a report of what was left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import patterns as P
from lectern.functions import text as X
from lectern.functions.kernels import cleaned_markup
from lectern.functions.markup import blocks, outline
from lectern.operators import scripts


def _sentence(text: Column) -> Column:
    return F.when((text == "") | text.rlike(r"[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def _each(text: Column, pattern: str, group: int, said: Callable[[Column], Column]) -> Column:
    """The text with what `said` makes of a group in the place of every match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(gaps, F.concat(F.transform(found, said), F.array(F.lit(""))), lambda g, t: F.concat(g, t))
    return F.when(F.size(found) > 0, F.array_join(pairs, "")).otherwise(text)


def inline(text: Column) -> Column:
    """Inline Markdown as it is read: code by its own rules, the texts of links, images that say something, no math,
    footnote marks or tags."""
    figure = lambda alt: F.when((F.length(F.trim(alt)) >= 3) & ~F.lower(F.trim(alt)).isin(*P.GENERIC_ALT), F.concat(F.lit("Figure: "), F.trim(alt), F.lit("."))).otherwise("")
    out = _each(F.regexp_replace(text, r"\s*\n\s*", " "), P.CODE_SPAN, 2, X.spoken_code)
    out = F.regexp_replace(F.regexp_replace(out, P.INLINE_MATH, ""), P.FOOTNOTE, "")
    return F.regexp_replace(F.regexp_replace(_each(out, P.IMAGE, 1, figure), P.ANCHOR, "$1"), P.INLINE_TAG, " ")


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(line, r"^\s*\|", ""), r"\|\s*$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|", -1), lambda c: X.spoken(inline(F.regexp_replace(c, r"\\\|", "|"))))


def _row(head: Column, cells: Column) -> Column:
    """A table's row as a sentence: its first cell, then the others after their columns' names."""
    named = F.transform(cells, lambda c, i: F.when((c != "") & (i > 0), F.concat_ws(" ", F.nullif(F.get(head, i), F.lit("")), c)))
    rest = F.array_join(F.filter(named, lambda c: c.isNotNull()), ", ")
    label = cells[0]
    return (
        F.when((label != "") & (rest != ""), F.concat(label, F.lit(": "), rest, F.lit(".")))
        .when(label != "", _sentence(label)).when(rest != "", F.concat(rest, F.lit("."))).otherwise("")
    )


def _opening(text: Column, most: int) -> Column:
    return F.substring(F.split(F.trim(text), "\n")[0], 1, most)


def _described(what: Column, text: Column) -> Column:
    return F.concat(what, F.when(F.trim(text) != "", F.concat(F.lit(": "), _opening(text, 60))).otherwise(""))


def normalised(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, doc_title, chapter, title, pos, nth, text) of what is spoken, and (doc_id, line, type, detail) of what is left out.

    `docs` has doc_id, text and, if there, `path`, whose name is the title of a text that gives none. Text before the
    first chapter has the document's title; a document with nothing to say says so. All windows share one exchange."""
    whole = Window.partitionBy("doc_id")
    order = whole.orderBy("pos")
    rows = blocks(docs).withColumn("inline", inline(F.col("text")))
    kind = F.col("type")
    plain = cleaned_markup(F.when(kind.isin("heading", "paragraph", "item"), F.col("inline")).otherwise(""))["text"]
    rows = rows.withColumn("plain", F.regexp_replace(X.spoken(plain), P.TASK_BOX, ""))
    heading, level = kind == "heading", F.col("level")
    named = F.max(F.when(kind == "doc", F.col("info"))).over(whole)
    front = F.max(F.when((kind == "doc") & (F.col("text") != ""), F.col("text"))).over(whole)
    nth = F.sum((heading & (level == 1)).cast("int")).over(order)
    rows = rows.withColumn("front", front).withColumn("title_row", heading & (level == 1) & (nth == 1))
    first = F.max(F.when(F.col("title_row") & (F.col("plain") != ""), F.col("plain"))).over(whole)
    rows = rows.withColumn("doc_title", F.coalesce("front", first, X.file_title(named))).withColumn("opens", heading & (level <= 2) & ~(F.col("title_row") & F.col("front").isNull()))
    source = heading & (level == 2) & F.col("plain").rlike(P.SKIPPED)
    skip = F.when(heading & (level <= 2), source)
    rows = rows.withColumn("skipped", F.coalesce(F.last(skip, ignorenulls=True).over(order), F.lit(False))).withColumn("source", source)
    rows = rows.withColumn("opens", F.col("opens") & ~F.col("source"))
    rows = rows.withColumn("chapter", F.sum(F.col("opens").cast("int")).over(order))
    rows = rows.withColumn("lines", F.when(kind == "table", F.split("text", "\n"))).withColumn("head", _cells(F.get("lines", F.lit(0))))
    rows = rows.withColumn("body", F.transform(F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0))), _cells))
    n_rows = F.coalesce(F.size("body"), F.lit(0))
    n_columns = F.greatest(F.size("head"), F.coalesce(F.array_max(F.transform("body", F.size)), F.lit(0)))
    read_out, table = (n_rows > 0) & (n_rows <= P.TABLE_ROWS) & (n_columns <= P.TABLE_COLUMNS), kind == "table"
    names = F.array_join(F.filter("head", lambda h: h != ""), ", ")
    names = F.when(names != "", names).otherwise(F.concat(n_columns.cast("string"), F.lit(" columns")))
    summary = F.concat(F.lit("The table with columns "), names, F.lit(" has "), n_rows.cast("string"), F.lit(" rows; see the written report for details."))
    said = (
        F.when(kind == "paragraph", F.array("plain")).when((kind == "item") | (heading & (level > 2)), F.array(_sentence(F.col("plain"))))
        .when(table & read_out, F.transform("body", lambda c: X.spoken(_row(F.col("head"), c)))).when(table & (n_rows > 0), F.array(summary))
        .otherwise(F.array().cast("array<string>"))
    )
    rows = rows.withColumn("said", F.when(F.col("skipped"), F.array().cast("array<string>")).otherwise(F.filter(said, lambda t: t != "")))
    silent = (kind == "doc") & (F.sum(F.size("said")).over(whole) == 0)
    rows = rows.withColumn("said", F.when(silent, F.array(F.lit("No spoken content found."))).otherwise(F.col("said")))
    heads = F.last(F.when(F.col("opens"), F.coalesce(F.nullif("plain", F.lit("")), "doc_title")), ignorenulls=True).over(order)
    rows = rows.withColumn("title", F.coalesce(heads, "doc_title"))
    spoken = rows.select("doc_id", "doc_title", "chapter", "title", "pos", F.posexplode("said").alias("nth", "text"))

    gone = lambda what, detail: F.struct(F.lit(what).alias("type"), detail.alias("detail"))
    text, info = F.col("text"), F.col("info")
    prose = F.when(kind.isin("heading", "paragraph", "item", "table"), F.regexp_replace(text, P.CODE_SPAN, "")).otherwise("")
    maths = F.transform(F.regexp_extract_all(prose, F.lit(P.INLINE_MATH), F.lit(1)), lambda m: gone("math", F.substring(F.trim(m), 1, 80)))
    notes = F.transform(F.regexp_extract_all(prose, F.lit(P.FOOTNOTE), F.lit(0)), lambda m: gone("footnote", F.lit("footnote")))
    fence = F.when(info != "", F.concat(info, F.lit(" block"))).otherwise("code block")
    block = (
        F.when(kind == "math", gone("math", F.substring(text, 1, 80))).when(kind == "footnote", gone("footnote", F.lit("footnote definition")))
        .when(F.col("source"), gone("sources_section", F.col("plain"))).when(F.col("skipped"), F.lit(None))
        .when((kind == "fence") & (F.lower(info) == "mermaid"), gone("mermaid", F.when(text != "", F.substring(F.split(text, "\n")[0], 1, 80)).otherwise("diagram")))
        .when(kind == "fence", gone("fence", _described(fence, text))).when(kind == "code", gone("fence", _described(F.lit("indented code block"), text)))
        .when(kind == "html_comment", gone("html_comment", F.substring(F.trim(text), 1, 80))).when(table & (n_rows == 0), gone("fence", F.lit("empty table")))
        .when(table & ~read_out, gone("large_table", F.concat(n_rows.cast("string"), F.lit(" rows x "), n_columns.cast("string"), F.lit(" columns"))))
    )
    parts = F.filter(F.concat(F.filter(F.concat(maths, notes), lambda g: ~F.col("skipped") | F.col("source")), F.array(block)), lambda g: g.isNotNull())
    left_out = rows.select("doc_id", "line", F.explode(parts).alias("g")).select("doc_id", "line", "g.type", "g.detail")
    return spoken, left_out


def narrated(docs: DataFrame) -> DataFrame:
    """(script_id, text): the verbatim script of every document, its chapters in order and none empty."""
    spoken, _ = normalised(docs)
    turn = F.struct("pos", "nth", "text")
    chapters = spoken.groupBy("doc_id", "doc_title", "chapter").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(turn)).alias("turns"))
    one = F.struct("chapter", "title", F.transform("turns", lambda t: t["text"]).alias("paragraphs"))
    made = chapters.groupBy(F.col("doc_id").alias("script_id")).agg(F.array_sort(F.collect_list(one)).alias("chapters"), F.first("doc_title").alias("title"))
    blank = F.lit("")
    meta = F.struct(
        F.lit(1).alias("narration"), F.col("title"), *[blank.alias(k) for k in ("source", "source_blob", "date", "author", "site")],
        *[F.lit(v).alias(k) for k, v in P.DEFAULTS.items()], F.lit(None).cast("int").alias("target_minutes"), blank.alias("cover"),
    )
    return scripts.serialised(made.select("script_id", meta.alias("meta"), "chapters"))


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, heading, following): article headings outside navigation, with the next prose of 40 characters."""
    rows = outline(pages).where("NOT excluded")
    prose = F.when(F.col("tag").isin("p", "li", "blockquote") & (F.length("text") >= 40), F.col("text"))
    after = Window.partitionBy("page_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("following", F.first(prose, ignorenulls=True).over(after))
    return rows.where("tag IN ('h1', 'h2', 'h3') AND text <> ''").select("page_id", "pos", "tag", F.col("text").alias("heading"), F.coalesce("following", F.lit("")).alias("following"))


def article_words(pages: DataFrame) -> DataFrame:
    """(page_id, words, long_enough): words of paragraphs inside the article, and whether they reach 150."""
    rows = outline(pages).where("NOT excluded AND in_article AND tag IN ('p', 'li', 'blockquote')")
    words = rows.groupBy("page_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"))
    every = pages.select("page_id").join(words, "page_id", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    return every.withColumn("long_enough", F.col("words") >= 150)
