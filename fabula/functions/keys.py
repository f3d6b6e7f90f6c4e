"""Content keys and profile values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fabula.functions.text import strip


def chapter_key(title: Column, text: Column) -> Column:
    """16 hex digits that stand for a chapter's title and text."""
    return F.left(F.sha1(F.concat(title, F.lit("\n"), text)), F.lit(16))


def chunks_hash(chunks: Column) -> Column:
    """A digest of a chapter's chunks and their order."""
    return F.sha1(F.array_join(chunks, "\n<chunk>\n"))


def profile_tone(post_tone: Column, pitch_shift: Column) -> Column:
    """The tone of a voice profile, also by its older name; blank is null."""
    return F.nullif(strip(F.coalesce(F.nullif(post_tone, F.lit("")), pitch_shift)), F.lit(""))
