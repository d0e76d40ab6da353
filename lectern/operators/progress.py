"""The state of runs from their progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """The last event of each run and stage: (run, stage, ts, seq, value)."""
    return events.groupBy("run", "stage").agg(F.max_by(F.struct("ts", "seq", "value"), F.struct("ts", "seq")).alias("e")).select("run", "stage", "e.*")


def concurrency(events: DataFrame) -> DataFrame:
    """(run, max_parallel, in_flight): from starts (+1) and finishes (-1) in order; a finish without a start counts as none."""
    order = Window.partitionBy("run").orderBy("ts", "seq")
    rows = events.withColumn("open", F.sum("delta").over(order))
    return rows.groupBy("run").agg(F.max(F.greatest("open", F.lit(0))).alias("max_parallel"), F.greatest(F.max_by("open", F.struct("ts", "seq")), F.lit(0)).alias("in_flight"))


def eta_seconds(queued, mean, parallel, mean_live):
    """Seconds left: the queue's share of each lane, and what the running chunks still need."""
    return queued * mean / F.greatest(parallel, F.lit(1)) + F.greatest(F.lit(0.0), mean - mean_live)


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """(run, start, events, total) of each run's sessions."""
    ts = F.col("ts").cast("timestamp")
    return events.groupBy("run", F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select("run", F.col("s.start").alias("start"), "events", "total")
