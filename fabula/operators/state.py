"""Restartable work: what is done, what is cached, and what a changed state invalidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fabula.functions.text import strip

SIGNATURE = ("chunk_count", "speaker_id", "max_chars", "pause_sec", "use_accent", "chunks_hash")


def pending(work: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows of work without output yet: an anti join, broadcast only if Spark finds ``done`` small."""
    return work.join(done.select(*on).distinct(), on, "left_anti")


def with_cached_chunks(chapters: DataFrame, cache: DataFrame, computed: Column, key: str = "chapter_key", most: str = "max_chars") -> DataFrame:
    """chapters with ``chunks``: cached for the same key and limit, else computed.

    Blank chunks of the cache are dropped; a cache entry without any other chunk
    counts as none.
    """
    held = cache.select(key, most, F.filter("chunks", lambda c: strip(c) != "").alias("__cached")).where(F.size("__cached") > 0)
    held = held.groupBy(key, most).agg(F.min("__cached").alias("__cached"))
    return chapters.join(held, [key, most], "left").withColumn("chunks", F.coalesce("__cached", computed)).withColumn("from_cache", F.col("__cached").isNotNull()).drop("__cached")


def invalidated(current: DataFrame, previous: DataFrame, key: str = "chapter_key", signature: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """current with ``stale``: whether an earlier state differs in the signature; without one parts stay."""
    old = previous.select(key, F.struct(*signature).alias("__old"))
    return current.join(old, key, "left").withColumn("stale", F.col("__old").isNotNull() & ~F.col("__old").eqNullSafe(F.struct(*signature))).drop("__old")


def parts_to_make(chunks: DataFrame, parts: DataFrame, skips: DataFrame, on: list[str]) -> DataFrame:
    """Chunks that are neither marked as skipped nor made."""
    return pending(pending(chunks, skips, on), parts, on)


def with_profile(chunks: DataFrame, profiles: DataFrame, on: str = "type") -> DataFrame:
    """chunks with their voice profile's columns and ``known``; profiles are a small table of unique types."""
    named = profiles.withColumn("known", F.lit(True))
    return chunks.join(named, on, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def tone_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks of each tone that isn't blank."""
    tone = F.trim("post_tone")
    return chunks.where(tone != "").groupBy(tone.alias("post_tone")).agg(F.count("*").alias("n"))


def chapter_counts(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks, characters and toned chunks of each group."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.coalesce(F.trim("post_tone") != "", F.lit(False))).alias("n_toned"))


def ordered_text(df: DataFrame, by: list[str], order: str, text: str, separator: str) -> DataFrame:
    """The texts of each group joined in order; a group is one chapter or book."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), separator).alias(text))


def playlist(parts: Column, silence: Column, pause_sec: float) -> Column:
    """Parts as lines of a playlist, with silence between them if there is a pause and more than one part."""
    line = lambda p: F.concat(F.lit("file '"), p, F.lit("'"))
    last = F.size(parts) - 1
    between = F.flatten(F.transform(parts, lambda p, i: F.when(i < last, F.array(line(p), line(silence))).otherwise(F.array(line(p)))))
    return between if pause_sec > 0 else F.transform(parts, line)
