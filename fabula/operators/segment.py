"""Segmentation: paragraphs, lines, sentences, and packing into bounded chunks.

Splits and greedy packing are column expressions; the balanced split carries
three variables from unit to unit and runs on Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from fabula.functions.numbers import spell
from fabula.functions.text import WS, compact, strip, unify_newlines

SENTENCE_A = rf"(?<=[.!?…]){WS}+"
SENTENCE_B = rf"(.+?(?:[.!?…](?={WS}+|$|[A-ZА-ЯЁ])|$))"
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def paragraphs(t: Column) -> Column:
    """Pieces between blank lines (which may hold white space), stripped."""
    return _filled(F.split(t, rf"\n{WS}*\n"))


def plain_paragraphs(t: Column) -> Column:
    """Pieces between doubled line breaks only, line breaks unified first."""
    return _filled(F.split(F.regexp_replace(unify_newlines(t), r"\n{3,}", "\n\n"), "\n\n"))


def lines(t: Column) -> Column:
    return _filled(F.split(t, LINE))


def sentences(t: Column) -> Column:
    """Pieces after terminal marks that white space follows."""
    return _filled(F.split(t, SENTENCE_A))


def sentences_tight(t: Column) -> Column:
    """Pieces up to a terminal mark that white space, the end or a capital follows."""
    return _filled(F.regexp_extract_all(t, F.lit(SENTENCE_B), 1))


_STATE = "struct<done:array<string>,open:string>"


def _fold(units: Column, step) -> Column:
    """Folds units over (finished pieces, open piece); the open piece ends the list."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    close = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))
    return F.aggregate(units, empty, step, close)


def _state(done: Column, opened: Column) -> Column:
    return F.struct(done.alias("done"), opened.alias("open"))


def _joined(state: Column, unit: Column) -> Column:
    return F.when(state["open"] == "", unit).otherwise(F.concat(state["open"], F.lit(" "), unit))


def _closed(state: Column) -> Column:
    return F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))


def _check(most: int) -> None:
    if most <= 0:
        raise ValueError("most must be positive")


def _word_pieces(most: int, gap: str) -> str:
    """Alternatives that match, from left to right, the chunks of words that one of the characters ``gap`` parts.

    The rest of a cut word, then as many whole words as fit (over blanks, but over
    no other gap), then as much of a longer word as fits.
    """
    word = f"[^{gap}]"
    over = "".join(c for c in gap if c != " ")
    within = f"[^{over}]" if over else "(?s:.)"
    whole = rf"{word}(?:{within}{{0,{most - 2}}}{word})?" if most > 1 else word
    return rf"(?<={word}){word}{{1,{most}}}|{whole}(?=[{gap}]|\z)|{word}{{{most}}}"


def pack_words(t: Column, most: int) -> Column:
    """Words packed up to ``most`` characters; longer words are cut, and their pieces stay alone.

    One pass of a regular expression: greedy matching takes what greedy packing does.
    """
    _check(most)
    return F.regexp_extract_all(compact(t), F.lit(_word_pieces(most, " ")), 0)


def pack_sentences(t: Column, most: int) -> Column:
    """A text in pieces of up to ``most`` characters at sentence ends, at words where a sentence is longer.

    Sentence ends become line breaks, which a compact text has none of; whole
    sentences that fit are taken first, else the words of one sentence.
    """
    _check(most)
    t = compact(t)
    marked = F.regexp_replace(t, "(?<=[.!?…]) ", "\n")
    whole = rf"(?:\A|(?<=\n))(?s:.{{1,{most}}})(?=\n|\z)"
    pieces = F.regexp_extract_all(marked, F.lit(rf"{whole}|{_word_pieces(most, ' ' + chr(92) + 'n')}"), 0)
    return F.when(F.length(t) <= most, F.array(t)).otherwise(F.transform(pieces, lambda p: F.translate(p, "\n", " ")))


def pack_neighbors(chunks: Column, most: int) -> Column:
    """Neighbouring chunks joined while they fit."""
    _check(most)

    def step(s: Column, x: Column) -> Column:
        return F.when(F.length(_joined(s, x)) <= most, _state(s["done"], _joined(s, x))).otherwise(_state(_closed(s), x))

    return _fold(_filled(chunks), step)


def words_within(text: str, most: int) -> list[str]:
    """``pack_words`` of one text, for Arrow functions."""
    out, held = [], ""
    for word in text.split():
        both = f"{held} {word}".strip()
        if len(both) <= most:
            held = both
        else:
            out += [held] if held else []
            cut = [word[i : i + most] for i in range(0, len(word), most)] if len(word) > most else []
            out += cut
            held = "" if cut else word
    return out + ([held] if held else [])


def balance(units: list[str], most: int) -> list[str]:
    """Units in about equal chunks of up to ``most`` characters.

    The number of chunks is the least that could hold the text; each aims at an
    equal share of what is left.  Ends when the units do, even if fewer chunks
    result than were planned.
    """
    units = [p for u in units for p in ([u] if len(u) <= most else words_within(u, most))]
    if len(units) < 2:
        return units
    left = sum(map(len, units)) + len(units) - 1
    planned = max(1, -(-left // most))
    out, at = [], 0
    for k in range(planned, 0, -1):
        if at == len(units):
            return out
        share = max(1, -(-left // k))
        first, size = at, len(units[at])
        at += 1
        while at < len(units) and size < share and size + 1 + len(units[at]) <= most:
            size += 1 + len(units[at])
            at += 1
        out.append(" ".join(units[first:at]))
        left -= size
    rest = " ".join(units[at:])
    return out + (words_within(rest, most) if len(rest) > most else [rest] if rest else [])


def balanced(units: Column, most: int) -> Column:
    """``balance`` of an array of sentences."""
    _check(most)
    return _arrays(lambda u: balance(list(u), most))(units)


def packed(chunks: list[str], most: int) -> list[str]:
    """``pack_neighbors`` of a list, for Arrow functions."""
    out: list[str] = []
    for x in chunks:
        if out and len(out[-1]) + 1 + len(x) <= most:
            out[-1] = f"{out[-1]} {x}"
        else:
            out.append(x)
    return out


_WIDE = str.maketrans(dict.fromkeys("\u00a0\u202f\u2009\u200a\u2007", " ") | dict.fromkeys("\u2060\u200b"))
_TIGHT = re.compile(r".+?(?:[.!?…](?=\s+|$|[A-ZА-ЯЁ])|$)")


def _even(space: str) -> str:
    return " ".join(space.translate(_WIDE).split())


def _paragraph(text: str, most: int) -> list[str]:
    """The chunks of a paragraph before neighbours are joined."""
    text = _even(text)
    units = [u for u in map(str.strip, _TIGHT.findall(text)) if u]
    if not units:
        return words_within(text, most)
    return [text] if len(text) <= most else balance(units, most)


def chunked(text: str, most: int) -> list[str]:
    """``chunk_text`` of one text, for Arrow functions."""
    paras = filter(None, map(str.strip, re.split(r"\n\s*\n", text.strip())))
    return packed([c for p in paras for c in _paragraph(p, most)], most)


def _arrays(function):
    """A column of lists made by a function of each value; nulls stay."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else function(x))

    return run


def chunk_text(t: Column, most: int = 250) -> Column:
    """A text in chunks of up to ``most`` characters, balanced within paragraphs, packed across them."""
    _check(most)
    return _arrays(lambda text: chunked(text, most))(t)


def chunk_paragraphs(paras: Column, most: int = 250) -> Column:
    """``chunk_text`` of a chapter's paragraphs, numbers in words first."""
    _check(most)
    return _arrays(lambda row: chunked("\n\n".join(filter(None, (spell(p).strip() for p in row))), most))(paras)


def chunk_lines(t: Column, most: int = 250) -> Column:
    """Chunks of each line of a text, numbers in words first; lines are never joined.

    Lines within the limit stay as they are; longer ones are chunked as texts.
    """
    _check(most)

    def lines_of(text: str) -> list[str]:
        rows = filter(None, map(str.strip, spell(text).splitlines()))
        return [c for x in rows for c in ([x] if len(x) <= most else chunked(x, most))]

    return _arrays(lines_of)(t)
