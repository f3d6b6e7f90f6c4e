"""Whole numbers as Russian words, in column expressions.

Numbers are strings of digits of any length: they are cut into groups of three,
so nothing overflows.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, functions as F

# The words of numbers.
UNITS = ("", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять")
UNITS_FEMININE = ("", "одна", "две", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять")
TEENS = (
    "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать",
    "восемнадцать", "девятнадцать",
)
TENS = ("", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто")
HUNDREDS = ("", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот")
SCALES = (("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов"))
ZERO, MINUS = "ноль", "минус"


def under_thousand(n: int, feminine: bool) -> str:
    """0 to 999 in words; 0 is empty."""
    rest = n % 100
    small = [TEENS[rest - 10]] if 10 <= rest <= 19 else [TENS[rest // 10], (UNITS_FEMININE if feminine else UNITS)[rest % 10]]
    return " ".join(w for w in [HUNDREDS[n // 100], *small] if w)


def plural(n: int) -> int:
    """Which of the three forms of a noun follows n."""
    if n % 100 in range(11, 15):
        return 2
    return 0 if n % 10 == 1 else 1 if n % 10 in (2, 3, 4) else 2


def _groups() -> tuple[list[str], list[str], list[list[str]]]:
    """Words of every group of three digits: masculine, feminine, and the noun of each scale."""
    every = range(1000)
    return [under_thousand(n, False) for n in every], [under_thousand(n, True) for n in every], [[s[plural(n)] for n in range(100)] for s in SCALES]


_MASCULINE, _FEMININE, _NOUNS = _groups()
_OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_AS_ASCII = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)


def _table(words: list[str]) -> Column:
    return F.split(F.lit("|".join(words)), "[|]")


def digits_to_words(digits: Column) -> Column:
    """A string of digits in words.  Groups beyond the billions keep their words but have no noun."""
    plain = F.ltrim(F.translate(digits, _OTHER_DIGITS, _AS_ASCII), F.lit("0"))
    groups = F.ceil(F.length(plain) / 3).cast("int")
    padded = F.lpad(plain, groups * 3, F.lit("0"))

    def words(i: Column) -> Column:
        n = F.substring(padded, i * 3 + 1, F.lit(3)).cast("int")
        scale = groups - 1 - i
        said = F.when(scale == 1, F.get(_table(_FEMININE), n)).otherwise(F.get(_table(_MASCULINE), n))
        noun = F.lit("")
        for k, forms in enumerate(_NOUNS, 1):
            noun = F.when(scale == k, F.get(_table(forms), n % 100)).otherwise(noun)
        return F.when(n == 0, "").when(noun == "", said).otherwise(F.concat(said, F.lit(" "), noun))

    spoken = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), groups - 1), words), lambda w: w != ""), " ")
    return F.when(plain == "", ZERO).otherwise(spoken)


def integer_to_words(n: Column) -> Column:
    """A whole number (any integral type or decimal of scale 0) in words."""
    text = n.cast("string")
    return F.when(text.startswith("-"), F.concat(F.lit(MINUS + " "), digits_to_words(F.ltrim(text, F.lit("-"))))).otherwise(digits_to_words(text))


def numbers_to_words(t: Column | str, digits: str = r"\p{Nd}") -> Column:
    """Every run of digits in a text in words; what is around it stays.

    ``digits``, for a class of a regular expression, says which digits are meant.
    """
    t = F.col(t) if isinstance(t, str) else t
    parts = F.regexp_extract_all(t, F.lit(rf"([{digits}]+|[^{digits}]+)"), 1)
    said = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(rf"^[{digits}]"), digits_to_words(p)).otherwise(p)), "")
    return F.when(t.rlike(rf"[{digits}]"), said).otherwise(t)


def spell(text: str) -> str:
    """``numbers_to_words`` of one text, for Arrow functions."""

    def words(digits: str) -> str:
        plain = "".join(str(unicodedata.digit(c)) for c in digits).lstrip("0")
        padded = plain.zfill(-(-len(plain) // 3) * 3)
        groups = [int(padded[i : i + 3]) for i in range(0, len(padded), 3)]
        said = []
        for scale, n in zip(range(len(groups) - 1, -1, -1), groups):
            if n:
                said.append(under_thousand(n, scale == 1))
                said += [SCALES[scale - 1][plural(n)]] if 1 <= scale <= len(SCALES) else []
        return " ".join(said) or ZERO

    return re.sub(r"\d+", lambda m: words(m[0]), text)
