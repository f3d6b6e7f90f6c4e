"""Pitch and tempo expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REFERENCE_HZ = 200.0
_SPEC = r"(?i)^\s*([+-]?\p{Nd}+(?:\.\p{Nd}+)?)\s*(%|hz)\s*$"


def pitch_factor(spec: Column | str, reference: float = REFERENCE_HZ) -> Column:
    """The factor of a shift such as ``-5%`` or ``+3 hz``; null if it isn't one.

    Factors of 0 and less have no meaning and give null for both units.
    """
    spec = F.col(spec) if isinstance(spec, str) else spec
    value = F.nullif(F.regexp_extract(spec, _SPEC, 1), F.lit("")).cast("double")
    percent = F.regexp_extract(spec, _SPEC, 2) == "%"
    factor = F.when(percent, 1 + value / 100).otherwise((F.lit(reference) + value) / F.lit(reference))
    return F.when((F.lit(reference) > 0) | percent, F.when(factor > 0, factor))


def tempo_chain(factor: Column | str) -> Column:
    """Factors in [0.5, 2] whose product is the given positive one."""
    x = (F.col(factor) if isinstance(factor, str) else factor).cast("double")
    slack = 1e-9
    up = F.greatest(F.ceil(F.log2(x / (2 * (1 + slack / 2)))), F.lit(0)).cast("int")
    down = F.greatest(F.ceil(F.log2(0.5 * (1 - 2 * slack) / x)), F.lit(0)).cast("int")
    rest = x / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    chain = F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(rest))
    return F.when(x > 0, chain)


def tone_filter(spec: Column | str, sample_rate: int) -> Column:
    """The audio filter of a pitch shift at constant tempo; ``copy`` for no shift, null for a bad spec."""
    factor = pitch_factor(spec)
    tempo = F.array_join(F.transform(tempo_chain(1 / factor), lambda x: F.format_string("atempo=%.6f", x)), ",")
    made = F.concat(F.format_string(f"asetrate={sample_rate}*%.9f", factor), F.lit(f",aresample={sample_rate},"), tempo)
    return F.when(F.abs(factor - 1) < 1e-6, "copy").otherwise(made)
