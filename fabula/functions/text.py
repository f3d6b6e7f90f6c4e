"""Text functions on columns: white space, punctuation, markup, names and titles.

Lengths are code points.  White space is Unicode's, spelled out because the
regular expressions of the JVM know only the ASCII part by ``\\s``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

WS = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]"
#: A character of a word, and an edge of words; the JVM's own take marks in, and leave number signs like ² out.
#: 𐐀 is a letter anyway: only with such a character in a pattern the JVM looks behind by code points.
WORD = r"[\p{L}\p{N}_𐐀]"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"

# Words that take no commas around them.
COMMA_WORDS = (
    "блин", "бля", "блядь", "сука", "короче", "типа", "вроде", "значит", "походу", "похоже", "слушай", "слышь",
    "кстати", "вообще", "реально", "честно", "блинчик",
)
_WITH_IOTA = "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > len(c.title()) and c.title() != c)
HEADING = r"^(Том\p{Z}+\p{Nd}+\p{Z}+)?Глава\p{Z}+\p{Nd}+(\p{Z}*[-–—:]\p{Z}+.+)?\p{Z}*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(t: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(t), rf"^{WS}++|{WS}++\z", "")


def compact(t: Column | str) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_col(t), rf"{WS}+", " "))


def compact_wide(t: Column | str) -> Column:
    """``compact`` that also removes zero-width spaces and word joiners."""
    return compact(F.translate(_col(t), "\u00a0\u202f\u2009\u200a\u2007\u2060\u200b", "     "))


def fold_dashes(t: Column | str) -> Column:
    return F.translate(_col(t), "—–", "--")


def fold_marks(t: Column | str) -> Column:
    """``?!`` and ``!?`` as ``?``, in one pass from the left."""
    return F.regexp_replace(_col(t), r"\?!|!\?", "?")


def fold_yo(t: Column | str) -> Column:
    return F.translate(_col(t), "Ёё", "Ее")


def strip_commas(t: Column | str, words: Iterable[str] = COMMA_WORDS) -> Column:
    """Commas before and after each of the words removed, word by word; then runs of blanks as one space.

    The control characters 1 and 2 go, as they do in the SQL, which marks words by them.
    """
    out = _col(t)
    for word in words:
        w = rf"(?=\Q{word}\E){EDGE}\Q{word}\E{EDGE}"  # the word first, as it fails sooner than the edge
        out = F.regexp_replace(out, rf"(?iu),{WS}*({w})", " $1")
        out = F.regexp_replace(out, rf"(?iu)({w}){WS}*,{WS}*", "$1 ")
    return F.regexp_replace(F.translate(out, "\x01\x02", ""), "[ \t]{2,}", " ")


def normalize(t: Column | str, words: Iterable[str] = COMMA_WORDS) -> Column:
    """Dashes, then commas, then marks."""
    return fold_marks(strip_commas(fold_dashes(t), words))


def terminal(t: Column | str) -> Column:
    """Ends in one of ``.!?…``: a last ``,:;`` becomes a full stop, else one is added."""
    t = _col(t)
    last = F.right(t, F.lit(1))
    return F.when(last.isin(",", ":", ";"), F.concat(F.left(t, F.length(t) - 1), F.lit("."))).when(last.isin(".", "!", "?", "…"), t).otherwise(F.concat(t, F.lit(".")))


def capitalize(t: Column | str) -> Column:
    """The first character in upper case, the rest as it is."""
    t = _col(t)
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t)))


def capitalize_letter(t: Column | str) -> Column:
    """The first character as one capital letter: ẞ for ß, and letters whose capital takes several stay as they are."""
    t = _col(t)
    first = F.left(t, F.lit(1))
    # title case has the one-letter capitals of Greek letters with an iota below
    one = F.translate(first, "ß" + _WITH_IOTA, "ẞ" + "".join(c.title() for c in _WITH_IOTA))
    return F.concat(F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(one), F.substring(t, F.lit(2), F.length(t)))


def kind(t: Column | str) -> Column:
    """question, exclamation or line, by the last character."""
    last = F.right(_col(t), F.lit(1))
    return F.when(last == "?", "question").when(last == "!", "exclamation").otherwise("line")


def mark_question(t: Column | str) -> Column:
    """The last word of a question between asterisks."""
    return F.regexp_replace(_col(t), rf"([A-Za-zА-Яа-яЁё0-9-]+){WS}*\?\z", r"*$1*?")


def escape(t: Column | str) -> Column:
    t = F.replace(_col(t), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def speech_markup(t: Column | str, pitch: Column, rate: Column) -> Column:
    """Markup with prosody; null if neither pitch nor rate is set, ``medium`` for the one that isn't."""
    p, r = F.nullif(strip(pitch), F.lit("")), F.nullif(strip(rate), F.lit(""))
    medium = F.lit("medium")
    whole = F.concat(F.lit('<speak><p><prosody pitch="'), F.coalesce(p, medium), F.lit('" rate="'), F.coalesce(r, medium), F.lit('">'), escape(t), F.lit("</prosody></p></speak>"))
    return F.when(p.isNotNull() | r.isNotNull(), whole)


def plain_markup(t: Column | str) -> Column:
    return F.concat(F.lit("<speak><p>"), escape(t), F.lit("</p></speak>"))


def tts_clean(t: Column | str) -> Column:
    """For synthesis: compact; lines of asterisks become empty; no double quotes."""
    t = strip(F.regexp_replace(compact(t), rf"^\*+(?:{WS}+\*+)*[.!?…]*\z", ""))
    return F.replace(t, F.lit('"'), F.lit(""))


def allowed_only(t: Column | str, symbols: str, keep_space: bool = False) -> Column:
    """Lower case, only the given characters, compact; without symbols the text as it is."""
    t = _col(t)
    if not symbols:
        return t
    ok = F.array(*[F.lit(c) for c in dict.fromkeys(symbols)])
    chars = F.split(F.lower(t), "")
    good = lambda c: F.array_contains(ok, c) | (c.rlike(rf"^{WS}$") if keep_space else F.lit(False))
    return compact(F.array_join(F.filter(chars, good), ""))


def speaker_normalize(t: Column | str) -> Column:
    """For the second engine: no asterisks and quotes, plain dashes and dots."""
    t = F.translate(strip(t), '*«»"„“”‘’', "")
    t = F.translate(t, "—–…", "--.")
    t = F.replace(F.replace(t, F.lit("..."), F.lit(".")), F.lit(". . ."), F.lit("."))
    return compact(F.regexp_replace(t, r"\.{3,}", "."))


def stress_normalize(t: Column | str) -> Column:
    """For stress marking: straight quotes, compact."""
    return compact(F.translate(_col(t), "„“”«»‘’", "\"\"\"\"\"''"))


def safe_name(t: Column | str, most: int = 120) -> Column:
    """A file name: no reserved characters, no dots or spaces at the ends, ``chapter`` if nothing is left."""
    s = F.btrim(F.regexp_replace(compact(t), r'[\\/:*?"<>|]', "_"), F.lit(". "))
    return F.rtrim(F.left(F.when(s == "", "chapter").otherwise(s), F.lit(most)), F.lit(". "))


def short_title(t: Column | str) -> Column:
    """``Глава N rest`` from the first such place in a title; others compact."""
    t = compact(t)
    found = rf"(?iuU)(глава{WS}+\p{{Nd}}+){WS}*[:.]?{WS}*(.*)\z"
    head = F.initcap(F.lower(F.regexp_extract(t, found, 1)))
    short = strip(F.concat(head, F.lit(" "), strip(F.regexp_extract(t, found, 2))))
    return F.when(t.rlike(found), short).otherwise(t)


def heading_normalize(t: Column | str) -> Column:
    return strip(F.regexp_replace(fold_dashes(compact(t)), rf"{WS}*-{WS}*", " - "))


def is_heading(t: Column | str) -> Column:
    """Whether a normalised paragraph is a chapter heading."""
    return _col(t).rlike(HEADING)


def unescape_newlines(t: Column | str) -> Column:
    t = F.replace(_col(t), F.lit("\\r\\n"), F.lit("\n"))
    return F.replace(F.replace(t, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\n"))


def clean_wrappers(t: Column | str) -> Column:
    """Without byte order marks, one leading backtick and outer white space."""
    return strip(F.regexp_replace(F.regexp_replace(_col(t), "^\ufeff+", ""), "^`", ""))


def isolate_headings(t: Column | str) -> Column:
    """Chapter markers that follow other text on a line as paragraphs of their own."""
    marker = rf"(?<!\n){WS}+((?:Том{WS}+\p{{Nd}}+{WS}+)?Глава{WS}+\p{{Nd}}+{WS}*[-–—:]{WS}*[^\n]{{1,120}})"
    # a marker keeps no white space at its end, as its paragraph is stripped
    marked = F.regexp_replace(_col(t), marker, "\n\n$1\x02\n\n")
    return F.regexp_replace(F.regexp_replace(marked, rf"{WS}*\x02", ""), r"\n{3,}", "\n\n")


def fold_newlines(t: Column | str) -> Column:
    """Line breaks with the white space around them as one space, stripped."""
    return strip(F.regexp_replace(_col(t), rf"{WS}*\n{WS}*", " "))


def unify_newlines(t: Column | str) -> Column:
    return F.replace(F.replace(_col(t), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def chunk_line(kind_: Column | str, t: Column | str) -> Column:
    return F.format_string("[%s]: %s", _col(kind_), _col(t))
