"""Synthesis: what is tried for each chunk, run by an engine that the caller supplies.

Neural engines aren't part of this library.  ``plan`` says what each rung of a
ladder would speak; ``synthesize`` runs a ladder with any object that has
``speak(text, markup) -> wav bytes`` and raises on failure.  ``ToneDouble`` is a
test double that makes short tones, not speech.
"""

from __future__ import annotations

import io
import math
import struct
import time
import uuid
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fabula.functions import text as T


class Engine(Protocol):
    def speak(self, text: str | None, markup: str | None) -> bytes: ...


class ToneDouble:
    """Makes 1 ms of tone for each character; refuses what ``refuses`` says."""

    def __init__(self, sample_rate: int = 48000, refuses: Callable[[str], bool] = lambda t: False):
        self.sample_rate, self.refuses = sample_rate, refuses

    def speak(self, text: str | None, markup: str | None) -> bytes:
        said = markup if markup is not None else text or ""
        if self.refuses(said):
            raise ValueError("refused")
        n = len(said) * self.sample_rate // 1000
        return wav_bytes(b"".join(struct.pack("<h", int(8000 * math.sin(i / 20))) for i in range(n)), self.sample_rate)


def wav_bytes(frames: bytes, sample_rate: int) -> bytes:
    """Mono 16-bit audio as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sample_rate)
        w.writeframes(frames)
    return out.getvalue()


def silence(seconds: float, sample_rate: int) -> bytes:
    return wav_bytes(b"\0\0" * round(seconds * sample_rate), sample_rate)


def sample_rate(wav: bytes) -> int:
    with wave.open(io.BytesIO(wav)) as w:
        return w.getframerate()


def joined(parts: list[bytes], pause_sec: float) -> bytes:
    """Parts in order with silence between them; no parts is an error."""
    if not parts:
        raise ValueError("nothing to join")
    rate = sample_rate(parts[0])
    frames = []
    for part in parts:
        with wave.open(io.BytesIO(part)) as w:
            if w.getframerate() != rate:
                raise ValueError("parts differ in sample rate")
            frames.append(w.readframes(w.getnframes()))
    gap = b"\0\0" * round(pause_sec * rate) if pause_sec > 0 and len(frames) > 1 else b""
    return wav_bytes(gap.join(frames), rate)


def plan(chunks: DataFrame, symbols: str, ladder: str = "markup") -> DataFrame:
    """chunks (text, ssml) with try_markup, try_text, try_allowed: what each rung speaks, null for rungs left out.

    markup: clean the text; empty is skipped; markup only if cleaning changed
    nothing; then the text; then its allowed characters, if they differ and
    aren't empty.  plain: normalise for the second engine, then the text and its
    allowed characters.  again: like plain, but the allowed characters are tried
    also where they are the text itself.  none: the markup or else the text, once.
    """
    if ladder == "none":
        return chunks.withColumn("try_markup", F.col("ssml")).withColumn("try_text", F.when(F.col("ssml").isNull(), T.strip("text"))).withColumn("try_allowed", F.lit(None).cast("string"))
    clean = T.tts_clean("text") if ladder == "markup" else T.speaker_normalize("text")
    allowed = T.allowed_only(F.col("try_text"), symbols, keep_space=ladder != "markup")
    rows = chunks.withColumn("try_text", F.nullif(clean, F.lit("")))
    rows = rows.withColumn("try_markup", F.when((F.col("try_text") == T.strip("text")) & F.lit(ladder == "markup"), F.nullif("ssml", F.lit(""))))
    return rows.withColumn("try_allowed", F.when((allowed != "") & ((allowed != F.col("try_text")) | F.lit(ladder == "again")), allowed))


def synthesize(planned: DataFrame, engine: Callable[[], Engine], on_error: str = "reject", tone: Callable[[bytes, str], bytes] | None = None) -> DataFrame:
    """planned with wav, attempt (the rung that worked), error, and seconds that it took.

    ``engine`` is called once in each Python worker.  Failed chunks have a null
    wav and the last error, or end the job with on_error "raise".  A tone
    function changes the audio of chunks that have a post_tone.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voice = _worker_held(name, engine)
        for batch in batches:
            wavs, rungs, errors, seconds = [], [], [], []
            for row in batch.itertuples(index=False):
                wav = rung = error = None
                began = time.perf_counter()
                for rung_ in ("markup", "text", "allowed"):
                    said = getattr(row, f"try_{rung_}")
                    if wav is not None or not isinstance(said, str):
                        continue
                    try:
                        wav, rung, error = voice.speak(None if rung_ == "markup" else said, said if rung_ == "markup" else None), rung_, None
                    except Exception as e:  # an engine may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                if wav is None and error is not None and on_error == "raise":
                    raise RuntimeError(error)
                shift = getattr(row, "post_tone", None)
                if wav is not None and tone is not None and isinstance(shift, str) and shift.strip():
                    wav = tone(wav, shift.strip())
                wavs.append(wav)
                rungs.append(rung)
                errors.append(error)
                seconds.append(time.perf_counter() - began)
            yield batch.assign(wav=wavs, attempt=rungs, error=errors, seconds=seconds)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planned.schema.fields)
    return planned.mapInPandas(run, f"{fields}, wav binary, attempt string, error string, seconds double")


_HELD: dict[str, object] = {}


def _worker_held(name: str, make: Callable[[], object]):
    """What ``make`` makes, kept by the Python worker for the tasks that follow."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def elapsed(synthesized: DataFrame, by: list[str]) -> DataFrame:
    """by, n_chunks, seconds: the time that the chunks of each group took."""
    return synthesized.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum("seconds").alias("seconds"))


def sample_rates(content: Column) -> Column:
    """The sample rate of WAV files; null where the content is none."""

    def rate(raw: bytes | None) -> int | None:
        try:
            return None if raw is None else sample_rate(raw)
        except (wave.Error, EOFError):
            return None

    @F.pandas_udf("long")
    def rates(rows: pd.Series) -> pd.Series:
        return rows.map(rate).astype("Int64")

    return rates(content)


def rejected(synthesized: DataFrame) -> DataFrame:
    """Chunks without audio, with the reason."""
    return synthesized.where("wav is null").withColumn("reason", F.coalesce("error", F.lit("empty after cleaning")))


def join_chapters(synthesized: DataFrame, by: list[str], order: str, pause_sec: float) -> DataFrame:
    """The audio of each chapter: by, wav, n_parts.  A chapter's audio is one value, so it is made in one task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in synthesized.schema.fields if f.name in by)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows[by].head(1).assign(wav=[joined(list(rows["wav"]), pause_sec)], n_parts=[len(rows)])

    return synthesized.where("wav is not null").select(*by, order, "wav").groupBy(*by).applyInPandas(one, f"{fields}, wav binary, n_parts long")


def accented(df: DataFrame, engine: Callable[[], Callable[[str], str]], column: str = "paragraph") -> DataFrame:
    """df with ``accented``: the normalised paragraph through a stress marker, null where it is empty."""
    name = uuid.uuid4().hex

    @F.pandas_udf("string")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        process = _worker_held(name, engine)
        for batch in batches:
            yield batch.map(lambda t: process(t) if isinstance(t, str) and t else None)

    return df.withColumn("accented", mark(T.stress_normalize(column)))
