"""Quality gates over synthesis attempts: pace, silence, and the best attempt of each chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words a minute that fail hard and soft, seconds of silence, shares of the episode's median, chunks a median needs.
HARD, SOFT, SILENCE, MEDIAN_SHARE, MEDIAN_CHUNKS, IDEAL = (60, 300), (90, 240), 4.0, (0.65, 1.5), 3, 150


def pace(words: Column, seconds: Column) -> Column:
    """Words a minute; 0 where there is no time."""
    return F.when(seconds > 0, words / (seconds / 60)).otherwise(0.0)


def hard_reason(wpm: Column, silence: Column, size: Column) -> Column:
    """The first hard reason against a chunk, or null."""
    return F.when((size <= 0) | (size % 2 != 0), "pcm").when((wpm < HARD[0]) | (wpm > HARD[1]), "pace").when(silence > SILENCE, "silence")


def soft_gated(chunks: DataFrame) -> DataFrame:
    """`chunks` (episode, chunk, wpm) with the episode's median, if it has enough chunks, and the soft reason."""
    whole = Window.partitionBy("episode")
    median = F.when(F.count(F.lit(1)).over(whole) >= MEDIAN_CHUNKS, F.percentile("wpm", 0.5).over(whole))
    low, high = MEDIAN_SHARE
    reason = F.when((F.col("wpm") < SOFT[0]) | (F.col("wpm") > SOFT[1]), "pace").when(
        (F.col("median") > 0) & ((F.col("wpm") < low * F.col("median")) | (F.col("wpm") > high * F.col("median"))), "median"
    )
    return chunks.withColumn("median", median).withColumn("soft", reason)


def best_attempts(attempts: DataFrame) -> DataFrame:
    """The attempt of each chunk nearest to the ideal pace; the earlier of equals."""
    order = Window.partitionBy("episode", "chunk").orderBy(F.abs(F.col("wpm") - IDEAL), "attempt")
    return attempts.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
