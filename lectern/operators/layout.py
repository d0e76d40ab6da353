"""Page layout of extracted text lines: body size, running heads, columns and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import word_count

# Share of the page in its running-head bands, gap between columns, sizes against the body's.
BAND, COLUMN_GAP, BIG, SMALL = 0.08, 60.0, 1.15, 0.85


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the size with most words; of equals, the one met first."""
    per = lines.groupBy("doc_id", "size").agg(F.sum(F.greatest(F.lit(1), word_count(F.col("text")))).alias("w"), F.min("line_no").alias("first"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("first"))).alias("body"))


def running_heads(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """`lines` with `dropped`: in a band, and repeated there by its letters or a page number."""
    rows = lines.join(boxes.select("doc_id", "page", F.col("y0").alias("p0"), F.col("y1").alias("p1")), ["doc_id", "page"], "left")
    height = F.col("p1") - F.col("p0")
    in_band = F.coalesce((height > 0) & ((F.col("y1") >= F.col("p1") - BAND * height) | (F.col("y0") <= F.col("p0") + BAND * height)), F.lit(False))
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    rows = rows.withColumn("band", in_band).withColumn("letters", letters)
    times = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "band", "letters"))
    number = F.trim("text").rlike(r"^(?:[Pp]age\s+)?\d+(?:\s*(?:/|of)\s*\d+)?$")
    return rows.withColumn("dropped", F.col("band") & (((F.length("letters") >= 4) & (times >= 2)) | number)).drop("band", "letters", "p0", "p1")


def column_starts(edges: Column) -> Column:
    """Left edges as column starts: a new one where the gap to the last start, not the last edge, exceeds the limit."""
    step = lambda s, x: F.when((F.size(s) == 0) | (x - F.coalesce(F.try_element_at(s, F.lit(-1)), x) > COLUMN_GAP), F.concat(s, F.array(x))).otherwise(s)
    return F.aggregate(F.array_sort(edges), F.array().cast("array<double>"), step)


def reading_order(lines: DataFrame) -> DataFrame:
    """`lines` with `column` and `rank`: by page, column, top and left, ties in the order met."""
    edges = lines.groupBy("doc_id", "page", "box").agg(F.min("x0").alias("x0")).groupBy("doc_id", "page").agg(column_starts(F.collect_list("x0")).alias("starts"))
    rows = lines.join(edges, ["doc_id", "page"])
    column = F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("x0") + 1)) - 1, F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("page", "column", F.desc("y1"), "x0", "line_no")
    return rows.withColumn("column", column).withColumn("rank", F.row_number().over(order)).drop("starts")


def font_headings(lines: DataFrame) -> DataFrame:
    """Lines that their size, or bold numbering, makes headings: (doc_id, line_no, level, text)."""
    rows = lines.join(body_size(lines), "doc_id")
    numbered = F.col("text").rlike(r"^\d+(?:\.\d+)*\.?\s+\S")
    small = F.col("bold") & (F.abs(F.col("size") - F.col("body")) < 0.05 * F.col("body") + 0.051) & (word_count(F.col("text")) <= 12) & ~F.rtrim("text").rlike(r"[.:;]$") & numbered
    found = rows.where((F.col("size") >= BIG * F.col("body")) | small).withColumn("top", F.max("size").over(Window.partitionBy("doc_id")))
    level = F.when((F.col("size") >= F.col("top") - 0.051) & ~F.col("text").rlike(r"^\d+\.\d+"), 1).otherwise(2)
    return found.select("doc_id", "line_no", level.alias("level"), F.regexp_replace("text", r"^\d+(?:\.\d+)*\.?\s+", "").alias("text"))
