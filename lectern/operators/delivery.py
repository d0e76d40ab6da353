"""What a run does and reports: its stages, waits, targets and counts, and what leaves or stays in a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import patterns as P


def lexicon_digests(entries: DataFrame) -> DataFrame:
    """(lexicon, sha256) of entries (lexicon, term, spoken): the digest of `term TAB spoken` lines in order of terms."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("term", "spoken"))), lambda e: F.concat(e["term"], F.lit("\t"), e["spoken"]))
    return entries.groupBy("lexicon").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def stages(kind: Column, edition: Column, dry_run: Column, publish: Column) -> Column:
    """The stages of a run: briefs and full editions of a `url` or `pdf` are written first (no edition means brief),
    a dry run ends with the plan, and the last stage is for what is published."""
    written = kind.isin("url", "pdf") & F.coalesce(edition, F.lit("brief")).isin("brief", "full")
    applies = {"write": written, "publish": publish & ~dry_run} | dict.fromkeys(("synthesize", "gates", "master", "save"), ~dry_run)
    return F.array_compact(F.array(*[F.when(applies[s], s) if s in applies else F.lit(s) for s in P.STAGES]))


def wait_seconds(attempt: Column, asked: Column, draw: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """The wait before the next attempt: `draw` (0 to 1) of a span that doubles up to `most`, or longer if asked for."""
    span = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    return F.greatest(F.lit(0.0), draw * span, asked)


def target_minutes(edition: Column, source_words: Column) -> Column:
    """The minutes that a writer aims at: fixed for a brief, else by the words of the source, up to a limit."""
    minutes = F.ceil(F.lit(P.SOURCE_SHARE) * source_words / P.WORDS_A_MINUTE)
    return F.when(edition == "brief", P.BRIEF_MINUTES).otherwise(F.least(F.lit(P.MOST_MINUTES), minutes)).cast("int")


def length_fits(actual: Column, expected: Column) -> Column:
    """Whether a file's seconds are within the tolerance of what its samples make."""
    return F.abs(actual - expected) <= P.LENGTH_SECONDS + P.LENGTH_SHARE * expected


def tone_pitch(word: Column) -> Column:
    """The pitch of a word's tone in Hz, by the checksum of its UTF-8 bytes."""
    return P.PITCH + F.pmod(F.crc32(word.cast("binary")), F.lit(P.PITCHES)) * P.PITCH_STEP


def outline_warns(found: Column, restored: Column, missing: Column) -> Column:
    """Whether a page had three outline headings or more, none was restored and some are missing (arrays)."""
    some = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    return (F.coalesce(found, F.lit(0)) >= 3) & ~some(restored) & some(missing)


def synthesis_counts(chunks: DataFrame) -> DataFrame:
    """Per episode of chunks (episode, cached, attempts): how many the cache had, how many were made, and repeated attempts."""
    again = F.when(~F.col("cached"), F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(0)
    return chunks.groupBy("episode").agg(F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("made"), F.sum(again).alias("retries"))


def token_usage(attempts: DataFrame) -> DataFrame:
    """Per script of a writer's attempts (script, input_tokens, output_tokens): how many, and their tokens."""
    return attempts.groupBy("script").agg(F.count(F.lit(1)).alias("attempts"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def cache_stats(files: DataFrame) -> DataFrame:
    """One row of files (key, kind `wav` or `json`, bytes): entries with audio, and the bytes of these and their sidecars."""
    entries = files.groupBy("key").agg(F.max(F.col("kind") == "wav").alias("held"), F.sum("bytes").alias("bytes")).where("held")
    return entries.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def unpublished(episodes: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The episodes that stay in the feed once those of `removed` (episode_id) are gone, and the removals that name none."""
    ids = removed.select("episode_id")
    return episodes.join(ids, "episode_id", "left_anti"), ids.join(episodes.select("episode_id"), "episode_id", "left_anti")


def marked_published(manifests: DataFrame, delivered: DataFrame) -> DataFrame:
    """The manifests with `published` set where `delivered` (episode_id) names them; a mark once set stays."""
    marks = delivered.select("episode_id").distinct().withColumn("now", F.lit(True))
    rows = manifests.join(marks, "episode_id", "left")
    return rows.withColumn("published", F.coalesce("published", F.lit(False)) | F.coalesce("now", F.lit(False))).drop("now").select(manifests.columns)


def replacement_notice(superseded: Column, replaced: Column) -> Column:
    """What to tell listeners when a publication replaced audio that they may have: superseded episodes, or its own."""
    listed = F.concat(F.lit("Superseded "), F.size(superseded).cast("string"), F.lit(" same-title feed episode(s): "), F.array_join(superseded, ", "), F.lit(f". {P.STALE_AUDIO}"))
    return F.when(F.size(superseded) > 0, listed).when(replaced, f"Replaced this episode's earlier feed audio. {P.STALE_AUDIO}").otherwise("")


def stage_seconds(marks: DataFrame) -> DataFrame:
    """(run, stage, seconds) from marks (run, stage, ts, started): from a stage's first start to its last end; null
    while one of them is missing."""
    first, last = F.min(F.when(F.col("started"), F.unix_micros(F.col("ts").cast("timestamp")))), F.max(F.when(~F.col("started"), F.unix_micros(F.col("ts").cast("timestamp"))))
    return marks.groupBy("run", "stage").agg(((last - first) / 1_000_000).alias("seconds"))
