"""Arrays as audio signals: silence, runs, resampling, chapter offsets and closed-form tone lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import word_count

# Fixed values at 24 kHz, in samples: tone and pause of a word, pause after a sentence end, gaps between chunks and chapters.
RATE, WORD, SENTENCE_END, CHUNK_GAP, CHAPTER_GAP, INTRO_GAP = 24_000, 9_600, 7_200, 12_000, 28_800, 9_600


def tone_samples(text: Column) -> Column:
    """Samples of the synthetic tone of a text: a tone and a pause for each word, longer after a sentence end."""
    ends = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"[.?!;:]$")))
    return word_count(text) * WORD + ends * SENTENCE_END


def frame_levels(signals: DataFrame, width: int) -> DataFrame:
    """(id, frame, rms) over fixed frames; the last frame is filled up with zeros."""
    rows = signals.select("id", F.posexplode("samples").alias("i", "x"))
    return rows.groupBy("id", F.floor(F.col("i") / width).cast("int").alias("frame")).agg(F.sqrt(F.sum(F.col("x").cast("double") * F.col("x")) / width).alias("rms"))


def silent_runs(levels: DataFrame, threshold: float) -> DataFrame:
    """(id, first_frame, frames) of every run of frames under the threshold."""
    order = Window.partitionBy("id").orderBy("frame")
    runs = levels.where(F.col("rms") < threshold).withColumn("run", F.col("frame") - F.row_number().over(order))
    return runs.groupBy("id", "run").agg(F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("frames")).drop("run")


def resampled(signals: DataFrame, length: int) -> DataFrame:
    """(id, k, value): linear interpolation at `length` places from the first sample to the last."""
    n = F.size("samples")
    place = F.col("k") * (n - 1) / F.lit(float(max(1, length - 1)))
    low = F.least(F.floor(place).cast("int"), n - 1)
    a, b = F.element_at("samples", low + 1).cast("double"), F.element_at("samples", F.least(low + 2, n)).cast("double")
    rows = signals.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return rows.select("id", "k", (a + (b - a) * (place - low)).alias("value"))


def chapter_offsets(chapters: DataFrame) -> DataFrame:
    """`chapters` (episode, chapter, samples) with start and end samples: a gap before each chapter but the first,
    and each ends where the next begins."""
    order = Window.partitionBy("episode").orderBy("chapter")
    before = F.coalesce(F.sum(F.col("samples") + CHAPTER_GAP).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chapters.withColumn("start_sample", before)
    total = F.col("start_sample") + F.col("samples")
    return rows.withColumn("end_sample", F.coalesce(F.lead("start_sample").over(order), total))
