"""Keyed tables of episodes, cached chunks and deliveries: retention, replacement, eviction and retry state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import canonical_title, strip


def cache_plan(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks the cache has, with what it has, and those still to be made."""
    return chunks.join(cache, "cache_key"), chunks.join(cache.select("cache_key"), "cache_key", "left_anti")


def pruned(entries: DataFrame, limit: int, oldest: Column | None) -> DataFrame:
    """Entries (key, bytes, last_used) with `removed`: the aged, and the oldest until what is left fits the limit.

    What stays is a suffix by age, so the test is whether the entries from this one to the newest exceed the
    limit. Sums are taken within days first, so that no task orders the whole table."""
    day = F.to_date("last_used")
    per_day = entries.groupBy(day.alias("day")).agg(F.sum("bytes").alias("day_bytes"))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    after = per_day.withColumn("after", F.coalesce(F.sum("day_bytes").over(later), F.lit(0))).drop("day_bytes")
    rows = entries.withColumn("day", day).join(after, "day")
    newer = Window.partitionBy("day").orderBy(F.desc("last_used"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    over = F.sum("bytes").over(newer) + F.col("after") > limit
    aged = F.col("last_used") < oldest if oldest is not None else F.lit(False)
    return rows.withColumn("removed", over | aged).drop("day", "after")


def retained(episodes: DataFrame, now: Column, days: int, most: int, feed: str) -> DataFrame:
    """Episodes (feed, episode_id, created_at) with `kept`: young enough, and then among the newest of their feed."""
    age = (F.unix_micros(now) - F.unix_micros("created_at")) / 86_400_000_000
    rows = episodes.withColumn("young", (age <= days) if days >= 0 else F.lit(True))
    order = Window.partitionBy(feed, "young").orderBy(F.desc("created_at"), "episode_id")
    kept = F.col("young") & ((F.row_number().over(order) <= most) if most >= 0 else F.lit(True))
    return rows.withColumn("kept", kept).drop("young")


def superseded(published: DataFrame, feed: str) -> DataFrame:
    """Publications (feed, episode_id, title, publish_seq) with `superseded`: a later one has the same canonical title."""
    title = canonical_title(F.col("title"))
    rows = published.withColumn("canonical", F.when(strip(title) != "", title))
    order = Window.partitionBy(feed, "canonical").orderBy(F.desc("publish_seq"))
    return rows.withColumn("superseded", F.col("canonical").isNotNull() & (F.row_number().over(order) > 1)).drop("canonical")


def guid(episode_id: Column, sha256: Column) -> Column:
    """A feed item's id: the episode's and the first eight digits of its audio's digest."""
    return F.concat(episode_id, F.lit("@"), F.substring(sha256, 1, 8))


def outbox(attempts: DataFrame) -> DataFrame:
    """Deliveries still pending from a log (episode_id, at, seq, ok, error): those whose last attempt failed, with
    the failures since the last success, the first of them, and the last error."""
    order = Window.partitionBy("episode_id").orderBy(F.desc("at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    open_ = attempts.withColumn("done", F.max(F.col("ok").cast("int")).over(order)).where("done = 0")
    return open_.groupBy("episode_id").agg(F.count(F.lit(1)).alias("attempts"), F.min("at").alias("queued_at"), F.max_by("error", F.struct("at", "seq")).alias("last_error"))
