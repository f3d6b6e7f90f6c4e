"""Queries over the test tables, one for each operator, with their SQL.

The tables hold no Russian text, dashes or questions, so most queries first
rewrite texts by an expression that both dialects share, in a way that makes
their rule fire; every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabula.functions import audio, keys, text as T
from fabula.functions.numbers import HUNDREDS, MINUS, SCALES, TEENS, TENS, UNITS, UNITS_FEMININE, ZERO, integer_to_words, numbers_to_words
from fabula.operators import chapters, dialogue, segment, state, synth
from fabula.plans import book_sql as B
from fabula.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WS = r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"
COMPACT = rf"trim(regexp_replace($T, '{WS}+', ' ', 'g'))"
STRIP = rf"regexp_replace(regexp_replace($T, '^{WS}+', ''), '{WS}+$', '')"

# Rewritings, valid in Spark SQL and in DuckDB.
TEXT = "text"
BLANK_LINES = "replace(text, chr(10), chr(10) || ' ' || chr(10))"
QUESTIONS = "replace(replace(text, '.' || chr(10), '?' || chr(10)), ', ', '!? ')"
DASHES = "replace(replace(text, ', ', ' — '), '. ', ' – ')"
QUOTES = "replace(replace(replace(text, ', ', '» «'), '. ', '… „'), ' the ', ' *“the”* ')"
SPEECH = "'- ' || replace(replace(replace(replace(text, chr(10), chr(10) || chr(10) || '- '), ', ', ' - сказал он тихо, '), ' the ', ' - the '), ' of ', '? ')"
NUMBERS = "replace(replace(replace(text, ' the ', ' 2017 '), ' and ', ' 11000 '), ' of ', ' 007 ')"
COMMAS = "replace(replace(replace(text, ' the ', ', the, '), ' der ', ', DER , '), ' le ', ',le, ')"
CHAPTERS = "replace(replace(text, chr(10), chr(10) || chr(10) || 'Том 1 Глава 2 - Der' || chr(10) || chr(10)), '. ', chr(10) || chr(10))"
GLUED = "replace(text, '. ', '. Том 1 Глава 12 — ')"
ESCAPED = "'\ufeff`' || replace(replace(text, chr(10), '\\\\n\\\\n'), ', ', ',\\\\r\\\\n')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(spark: SparkSession, sf_dir: str, rewriting: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(rewriting).alias("t"))


def _from(rewriting: str) -> str:
    return f"(SELECT doc_id, {rewriting.replace(chr(92) * 2, chr(92))} AS t FROM documents)"


def scalar(name: str, value: Callable[[Column], Column], sql: str | None, rewriting: str = TEXT) -> None:
    """A function of each document's text."""
    _QUERIES[name] = lambda spark, sf_dir: _source(spark, sf_dir, rewriting).select("doc_id", value(F.col("t")).alias("value"))
    if sql is not None:
        _SQL[name] = f"SELECT doc_id, {sql.replace('$T', 't')} AS value FROM {_from(rewriting)}"


def listed(name: str, values: Callable[[Column], Column], sql: str | None, rewriting: str = TEXT) -> None:
    """A list made of each document's text, a row for each entry."""
    _QUERIES[name] = lambda spark, sf_dir: _source(spark, sf_dir, rewriting).select("doc_id", values(F.col("t")).alias("v")).select("doc_id", F.posexplode("v").alias("idx", "value"))
    if sql is not None:
        _SQL[name] = f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, parts[i] AS value FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {sql.replace('$T', 't')} AS parts FROM {_from(rewriting)}))"


def _of(expr: str, inner: str) -> str:
    return expr.replace("$T", inner)


def _sql_filled(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {_of(STRIP, 'p')}), lambda p: p <> '')"


def _sql_split(pattern: str, subject: str = "$T") -> str:
    return f"string_split(regexp_replace({subject}, '{pattern}', chr(1), 'g'), chr(1))"


_SENTENCES = rf"string_split(regexp_replace($T, '([.!?…]){WS}+', '\1' || chr(1), 'g'), chr(1))"
_TERMINAL = "CASE WHEN right($T, 1) IN (',', ':', ';') THEN left($T, length($T) - 1) || '.' WHEN right($T, 1) IN ('.', '!', '?', '…') THEN $T ELSE $T || '.' END"
_CAPITAL = "(CASE WHEN left($T, 1) = 'ß' THEN 'SS' ELSE upper(left($T, 1)) END || substring($T, 2))"
_KIND = "CASE right($T, 1) WHEN '?' THEN 'question' WHEN '!' THEN 'exclamation' ELSE 'line' END"
_MARKED = rf"regexp_replace($T, '([A-Za-zА-Яа-яЁё0-9-]+){WS}*\?$', '*\1*?')"
_ESCAPE = "replace(replace(replace($T, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

_STARLESS = rf"regexp_replace({COMPACT}, '^\*+(?:{WS}+\*+)*[.!?…]*$', '')"

# ---------------------------------------------------------------- text functions
scalar("ws_compact", T.compact, COMPACT)
scalar("ws_compact_wide", T.compact_wide, _of(COMPACT, "replace(replace(replace($T, chr(160), ' '), '\u200b', ''), '\u2060', '')"), "replace(replace(text, ' the ', chr(160) || 'the' || '\u200b'), chr(10), '\u2060' || chr(10))")
scalar("dash_fold", T.fold_dashes, "replace(replace($T, '—', '-'), '–', '-')", DASHES)
scalar("mark_fold", T.fold_marks, r"regexp_replace($T, '\?!|!\?', '?', 'g')", QUESTIONS)
scalar("yo_fold", T.fold_yo, "replace(replace($T, 'Ё', 'Е'), 'ё', 'е')", "replace(replace(text, 'the', 'ёлка'), 'T', 'Ё')")
scalar("decorative_filter", T.tts_clean, f"replace({_of(STRIP, _STARLESS)}, chr(34), '')", "CASE WHEN length(text) < 300 THEN ' *** **.' ELSE replace(text, ' the ', ' \"the\" ') END")
scalar("vosk_normalize", T.speaker_normalize, _of(COMPACT, r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace($T, '[*«»\"„“”‘’]', '', 'g'), '—', '-'), '–', '-'), '…', '.'), '...', '.'), '. . .', '.'), '\.{3,}', '.', 'g')".replace("$T", STRIP)), QUOTES)
scalar("accent_normalize", T.stress_normalize, _of(COMPACT, "regexp_replace(regexp_replace($T, '[„“”«»]', '\"', 'g'), '[‘’]', chr(39), 'g')"), QUOTES)
scalar("safe_name", T.safe_name, rf"rtrim(left(CASE WHEN trim(regexp_replace({COMPACT}, '[\\/:*?\"<>|]', '_', 'g'), '. ') = '' THEN 'chapter' ELSE trim(regexp_replace({COMPACT}, '[\\/:*?\"<>|]', '_', 'g'), '. ') END, 120), '. ')", "CASE WHEN length(text) < 60 THEN ' . ' ELSE replace(replace(text, ', ', ': '), ' the ', '/the?') END")
scalar("heading_normalize", T.heading_normalize, _of(STRIP, rf"regexp_replace(replace(replace({COMPACT}, '—', '-'), '–', '-'), '{WS}*-{WS}*', ' - ', 'g')"), DASHES)
scalar("newline_fold", T.fold_newlines, _of(STRIP, rf"regexp_replace($T, '{WS}*\n{WS}*', ' ', 'g')"))
scalar("ssml_build", lambda t: T.speech_markup(T.compact(t), F.lit("high"), F.lit(None).cast("string")), f"'<speak><p><prosody pitch=\"high\" rate=\"medium\">' || {_of(_ESCAPE, COMPACT)} || '</prosody></p></speak>'", "replace(text, ' the ', ' <the> & ')")
scalar("symbol_filter", lambda t: T.allowed_only(t, " abcdefghijklmnopqrstuvwxyz.,", False), _of(COMPACT, "regexp_replace(lower($T), '[^ a-z.,]', '', 'g')"))
scalar("short_title", T.short_title, rf"CASE WHEN regexp_matches({COMPACT}, '(?i)глава {{1,}}\p{{Nd}}+') THEN trim('Глава ' || regexp_extract({COMPACT}, '(?i)глава (\p{{Nd}}+) *[:.]? *(.*)$', 1) || ' ' || trim(regexp_extract({COMPACT}, '(?i)глава (\p{{Nd}}+) *[:.]? *(.*)$', 2))) ELSE {COMPACT} END", "CASE WHEN length(text) < 1000 THEN 'Том 1 ГЛАВА 7: ' || replace(text, chr(10), ' ') ELSE text END")
scalar("numbers_in_documents", numbers_to_words, None, NUMBERS)
scalar("comma_strip", lambda t: T.strip_commas(t, ("the", "der", "le")), None, COMMAS)
scalar("normalize_text", lambda t: T.normalize(t, ("the", "der", "le")), None, COMMAS)
scalar("isolate_headings", T.isolate_headings, None, GLUED)
scalar("chapter_key", lambda t: keys.chapter_key(F.lit("Книга"), t), "left(sha1('Книга' || chr(10) || $T), 16)")
scalar("chunks_hash", lambda t: keys.chunks_hash(segment.lines(t)), f"sha1(array_to_string({_sql_filled('string_split($T, chr(10))')}, chr(10) || '<chunk>' || chr(10)))")
scalar("unescape", lambda t: T.unescape_newlines(T.clean_wrappers(t)), _of(r"replace(replace(replace($T, '\r\n', chr(10)), '\n', chr(10)), '\r', chr(10))", _of(STRIP, "regexp_replace(ltrim($T, '\ufeff'), '^`', '')")), ESCAPED)

_LOOK = rf"(^|[^\p{{L}}\p{{N}}_])"


def _sql_commas(subject: str, words: tuple[str, ...]) -> str:
    """Words between markers stand for word boundaries, which DuckDB knows in ASCII only."""
    out = rf"regexp_replace({subject}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
    for w in words:
        out = rf"regexp_replace({out}, '(?i),{WS}*(\x01{w}\x02)', ' \1', 'g')"
        out = rf"regexp_replace({out}, '(?i)(\x01{w}\x02){WS}*,{WS}*', '\1 ', 'g')"
    return rf"regexp_replace(replace(replace({out}, chr(1), ''), chr(2), ''), '[ \t]{{2,}}', ' ', 'g')"


_SQL["comma_strip"] = f"SELECT doc_id, {_sql_commas('t', ('the', 'der', 'le'))} AS value FROM {_from(COMMAS)}"


def _sql_words(digits: str) -> str:
    """SQL for a string of digits in words: groups of three, from the left."""
    lit = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    n = "CAST(substring(d, i * 3 + 1, 3) AS INTEGER)"
    scale = "(len(d) // 3 - 1 - i)"
    small = f"CASE WHEN {n} % 100 BETWEEN 10 AND 19 THEN {lit(TEENS)}[{n} % 100 - 9] ELSE concat_ws(' ', nullif({lit(TENS)}[{n} % 100 // 10 + 1], ''), nullif(CASE WHEN {scale} = 1 THEN {lit(UNITS_FEMININE)}[{n} % 10 + 1] ELSE {lit(UNITS)}[{n} % 10 + 1] END, '')) END"
    form = f"CASE WHEN {n} % 100 BETWEEN 11 AND 14 THEN 3 WHEN {n} % 10 = 1 THEN 1 WHEN {n} % 10 IN (2, 3, 4) THEN 2 ELSE 3 END"
    noun = "CASE " + " ".join(f"WHEN {scale} = {k} THEN {lit(s)}[{form}]" for k, s in enumerate(SCALES, 1)) + " END"
    group = f"CASE WHEN {n} = 0 THEN '' ELSE concat_ws(' ', nullif({lit(HUNDREDS)}[{n} // 100 + 1], ''), nullif({small}, ''), {noun}) END"
    said = f"array_to_string(list_filter(list_transform(range(len(d) // 3), lambda i: {group}), lambda w: w <> ''), ' ')"
    padded = f"lpad(ltrim({digits}, '0'), CAST(ceil(length(ltrim({digits}, '0')) / 3.0) * 3 AS INTEGER), '0')"
    return f"CASE WHEN ltrim({digits}, '0') = '' THEN '{ZERO}' ELSE list_transform([{padded}], lambda d: {said})[1] END"


_SQL["numbers_in_documents"] = (
    f"WITH p AS (SELECT doc_id, regexp_extract_all(t, '[0-9]+|[^0-9]+') AS parts FROM {_from(NUMBERS)}), x AS (SELECT doc_id, i, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)) "
    f"SELECT p.doc_id, coalesce(v, '') AS value FROM p LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN s < ':' AND regexp_matches(s, '^[0-9]') THEN {_sql_words('s')} ELSE s END, '' ORDER BY i) AS v FROM x GROUP BY doc_id) y ON p.doc_id = y.doc_id"
)


def int_to_words_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", integer_to_words(F.col("o_orderkey") * 7919).alias("words"), integer_to_words(-F.col("o_orderkey")).alias("negative"))


_QUERIES["int_to_words_orders"] = int_to_words_orders
_SQL["int_to_words_orders"] = f"SELECT o_orderkey, {_sql_words('CAST(o_orderkey * 7919 AS VARCHAR)')} AS words, CASE WHEN o_orderkey = 0 THEN '{ZERO}' ELSE '{MINUS} ' || {_sql_words('CAST(o_orderkey AS VARCHAR)')} END AS negative FROM orders"

# ---------------------------------------------------------------- segmentation
listed("paragraphs", segment.paragraphs, _sql_filled(_sql_split(rf"\n{WS}*\n")), BLANK_LINES)
listed("plain_paragraphs", segment.plain_paragraphs, _sql_filled(r"string_split(regexp_replace($T, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10))"), "replace(text, chr(10), chr(10) || chr(10) || chr(10))")
listed("lines", segment.lines, _sql_filled("string_split($T, chr(10))"))
listed("sentences_a", segment.sentences, _sql_filled(_SENTENCES))
listed("sentences_b", lambda t: segment.sentences_tight(T.compact_wide(t)), B.let(B.compact_wide("$T"), "c", B.sentences_tight("c")))
listed("terminal_punct", lambda t: F.transform(segment.lines(t), T.terminal), f"list_transform({_sql_filled('string_split($T, chr(10))')}, lambda x: {_of(_TERMINAL, 'x')})")
listed("capitalize_first", lambda t: F.transform(segment.lines(F.lower(t)), T.capitalize), f"list_transform({_sql_filled('string_split(lower($T), chr(10))')}, lambda x: {_of(_CAPITAL, 'x')})")
listed("question_mark_word", lambda t: F.transform(segment.lines(t), T.mark_question), f"list_transform({_sql_filled('string_split($T, chr(10))')}, lambda x: {_of(_MARKED, 'x')})", QUESTIONS)

_SPOKEN = _sql_words("z")

listed("pack_words", lambda t: segment.pack_words(t, 12), B.pack_words("$T", 12))
listed("pack_neighbors", lambda t: segment.pack_neighbors(segment.lines(t), 400), B.pack_neighbors(B.filled("string_split($T, chr(10))"), 400))
listed("pack_sentences", lambda t: segment.pack_sentences(t, 200), B.let(B.compact("$T"), "c", B.pack_sentences("c", 200)))
listed("balanced_chunks", lambda t: segment.balanced(segment.sentences(t), 250), B.balance(B.sentences("$T"), 250))
listed("chunk_text", lambda t: segment.chunk_text(t, 250), B.chunked("$T", 250), BLANK_LINES)
listed("chunk_paragraphs", lambda t: segment.chunk_paragraphs(segment.lines(t), 250), B.chunk_paragraphs(B.filled("string_split($T, chr(10))"), _SPOKEN, 250), NUMBERS)
listed("line_mode_chunks", lambda t: segment.chunk_lines(t, 120), B.chunk_lines("$T", _SPOKEN, 120), NUMBERS)
listed("escaped_paragraphs", chapters.book_paragraphs, None, ESCAPED)


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", T.compact("text").alias("t"))
    return docs.select("lang", F.explode(segment.sentences(F.col("t"))).alias("s")).groupBy("lang", T.kind("s").alias("kind")).agg(F.count("*").alias("n"))


_QUERIES["kind_counts"] = kind_counts
_SQL["kind_counts"] = f"SELECT lang, {_of(_KIND, 's')} AS kind, count(*) AS n FROM (SELECT lang, unnest({_sql_filled(_of(_SENTENCES, _of(COMPACT, 'text')))}) AS s FROM documents) GROUP BY ALL"

# ---------------------------------------------------------------- dialogue
_VERBS = "|".join(dialogue.REMARK_VERBS)
_ADVERBS = "|".join(dialogue.ADVERBS)
_END = r"([^\p{L}\p{N}_]|$)"


def author_remark(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _source(spark, sf_dir, SPEECH).select("doc_id", F.posexplode(F.split(T.compact("t"), " - ")).alias("idx", "part"))
    return parts.select("doc_id", "idx", dialogue.is_remark(F.col("part")).alias("is_remark"))


_QUERIES["author_remark"] = author_remark
_REMARK = (
    f"CASE WHEN regexp_matches(p, '[?!]') THEN regexp_matches(p, '^(?:(?:{_ADVERBS}) )?(?:{_VERBS}){_END}') "
    f"ELSE regexp_matches(p, '^(?:(?:я|[а-яёa-z][а-яёa-z-]+) )?(?:(?:{_ADVERBS}) )?(?:{_VERBS}){_END}') END"
)
_SQL["author_remark"] = (
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, {_REMARK} AS is_remark "
    f"FROM (SELECT doc_id, i, lower({_of(COMPACT, 'parts[i]')}) AS p FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split({_of(COMPACT, 't')}, ' - ') AS parts FROM {_from(SPEECH)})))"
)


def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, QUESTIONS).select("doc_id", F.posexplode(dialogue.speech_kinds(F.col("t"))).alias("idx", "u"))
    return rows.select("doc_id", "idx", "u.kind", "u.text")


_QUERIES["adjacent_merge"] = adjacent_merge
_SQL["adjacent_merge"] = (
    f"WITH n AS (SELECT doc_id, {_of(_TERMINAL, 'c')} AS t FROM (SELECT doc_id, {_of(COMPACT, 't')} AS c FROM {_from(QUESTIONS)})), "
    f"s AS (SELECT doc_id, i, parts[i] AS x FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {_sql_filled(_of(_SENTENCES, 't'))} AS parts FROM n))), "
    f"c AS (SELECT doc_id, i, {_of(_TERMINAL, _CAPITAL).replace('$T', 'x')} AS x FROM s), k AS (SELECT doc_id, i, {_of(_KIND, 'x')} AS kind, {_of(_MARKED, 'x')} AS x FROM c), "
    "f AS (SELECT *, CASE WHEN kind <> 'question' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) = kind THEN 0 ELSE 1 END AS fresh FROM k), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f) "
    "SELECT doc_id, CAST(grp - 1 AS INTEGER) AS idx, any_value(kind) AS kind, string_agg(x, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, grp"
)


def dialogue_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.parse_book(_source(spark, sf_dir, SPEECH), "t", most=0)


def parse_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.parse_book(_source(spark, sf_dir, SPEECH), "t", most=200)


_QUERIES |= {"dialogue_chunks": dialogue_chunks, "parse_book": parse_book}
_COMMALESS = _sql_commas("replace(replace(t, '—', '-'), '–', '-')", T.COMMA_WORDS)
_NORMAL = f"SELECT doc_id, {B.spelled('t', _SPOKEN)} AS t FROM (SELECT doc_id, regexp_replace({_COMMALESS}, '\\?!|!\\?', '?', 'g') AS t FROM {_from(SPEECH)})"
_SQL["dialogue_chunks"] = B.parse_book(_NORMAL, _REMARK, dialogue.PROFILES, 0)
_SQL["parse_book"] = B.parse_book(_NORMAL, _REMARK, dialogue.PROFILES, 200)


def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir, CHAPTERS).select("doc_id", segment.plain_paragraphs(F.col("t")).alias("paragraphs"))
    titled = rows.withColumn("title", chapters.guess_title(F.col("paragraphs"), F.lit("book")))
    return chapters.split_chapters(titled).select("doc_id", "chapter_idx", "title", F.array_join("paragraphs", "\n\n").alias("text"))


def title_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", chapters.guess_title(segment.plain_paragraphs(F.col("text")), F.lit("book")).alias("title"))


_QUERIES |= {"chapter_split": chapter_split, "title_guess": title_guess}
_SQL["title_guess"] = f"SELECT doc_id, CASE WHEN length(f) BETWEEN 2 AND 120 THEN f ELSE 'book' END AS title FROM (SELECT doc_id, {_of(STRIP, 'string_split(p, chr(10))[1]')} AS f FROM (SELECT doc_id, {_of(_sql_filled('string_split($T, chr(10) || chr(10))'), 'text')}[1] AS p FROM documents))"
_HEADING_OF_X, _HEADING_OF_BOOK = (_of(STRIP, f"regexp_replace({_of(COMPACT, c)}, ' *- *', ' - ', 'g')") for c in ("x", "book"))
_PLAIN_PARAGRAPHS = _of(_sql_filled(r"string_split(regexp_replace($T, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10))"), "t")
_SQL["chapter_split"] = (
    f"WITH p AS (SELECT doc_id, {_PLAIN_PARAGRAPHS} AS parts FROM {_from(CHAPTERS)}), "
    f"b AS (SELECT doc_id, parts, CASE WHEN length(f) BETWEEN 2 AND 120 THEN f ELSE 'book' END AS book FROM (SELECT doc_id, parts, {_of(STRIP, 'string_split(parts[1], chr(10))[1]')} AS f FROM p)), "
    "r AS (SELECT doc_id, book, i, parts[i] AS x FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM b)), "
    f"n AS (SELECT *, {_HEADING_OF_X} AS norm FROM r), "
    r"h AS (SELECT *, CASE WHEN regexp_matches(norm, '^(Том \p{Nd}+ )?Глава \p{Nd}+( *[-:] .+)?$') THEN norm END AS head FROM n), "
    "g AS (SELECT *, count(head) OVER w AS grp, coalesce(last_value(head IGNORE NULLS) OVER w, book) AS title FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT doc_id, grp, any_value(title) AS title, any_value(book) AS book, count(*) FILTER (WHERE head IS NULL) AS n, list(x ORDER BY i) FILTER (WHERE head IS NULL) AS xs, list(norm ORDER BY i) FILTER (WHERE head IS NULL) AS ns FROM g GROUP BY doc_id, grp), "
    "k AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS mx, max(grp) OVER (PARTITION BY doc_id) AS last FROM c), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS chapter_idx FROM k WHERE n > 0 OR (mx = 0 AND grp = last)) "
    f"SELECT doc_id, CAST(chapter_idx AS INTEGER) AS chapter_idx, title, coalesce(array_to_string(CASE WHEN chapter_idx = 0 AND ns[1] = {_HEADING_OF_BOOK} THEN xs[2:] ELSE xs END, chr(10) || chr(10)), '') AS text FROM m"
)

# ---------------------------------------------------------------- books, audio, state


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FictionBook file of each page, with its markup as text."""
    pages = _table(spark, sf_dir, "pages")
    body = F.concat(F.lit("<section><title><p>"), T.escape("url"), F.lit("</p></title><p>"), T.escape(F.regexp_replace("html", r"[\x00-\x08\x0b-\x1f]", "")), F.lit("</p></section><section><p> </p></section>"))
    book = F.concat(F.lit(f'<FictionBook xmlns="{readers.NAMESPACE}"><body>'), body, F.lit("</body></FictionBook>"))
    return pages.select("page_id", book.cast("binary").alias("content"))


def fb2_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.chapters_of(_books(spark, sf_dir), "page_id")
    return found.select("page_id", "chapter_idx", "title", F.element_at("paragraphs", 2).alias("text"), "error")


def fb2_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book_title"), F.lit(0).alias("chapter_idx"), F.lit("Глава 1").alias("title"), segment.lines(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", "")).alias("paragraphs"))
    return writers.fb2_files(rows, "doc_id", "2024-01-01")


def _files(spark: SparkSession, sf_dir: str, content: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.expr(content).alias("content"))


def texts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the line breaks of another system."""
    files = _files(spark, sf_dir, "encode(replace(text, chr(10), '\\r\\n') || '\\rend', 'UTF-8')")
    return readers.texts_of(files)


def texts_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a byte that is no UTF-8."""
    return readers.texts_of(_files(spark, sf_dir, "concat(encode(text, 'UTF-8'), unhex('FF'), encode('x', 'UTF-8'))"), strict=False)


def texts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's text, stripped, the empty ones' too."""
    files = readers.texts_of(_files(spark, sf_dir, "encode(' ' || chr(10) || text || chr(9), 'UTF-8')"))
    return readers.filled(files).select("path", "text")


def chunk_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk files, some of whose chunks lack what they need; valid and rejected ones."""
    turns = _table(spark, sf_dir, "conversations").withColumn("c", F.expr("named_struct('type', CASE WHEN turn % 5 = 3 THEN ' ' ELSE role END, 'text', CASE WHEN turn % 5 = 4 THEN '' ELSE text END, 'ssml', CASE WHEN turn = 1 THEN '<p/>' ELSE ' ' END, 'pitch_shift', CASE WHEN turn = 2 THEN '-5%' ELSE ' ' END)"))
    files = turns.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("turn", "c"))).alias("cs")).select("path", F.to_json(F.transform("cs", lambda x: x["c"])).alias("text"))
    valid, rejected = readers.chunks_of(files)
    return valid.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("path", "chunk_idx", "type", "text", "ssml", "post_tone", "reason")


def json_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, lists and broken texts."""
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.expr("CASE n_nationkey % 3 WHEN 0 THEN to_json(named_struct('name', n_name, 'key', n_nationkey)) WHEN 1 THEN '[1, 2]' ELSE '{broken' END").alias("t"))
    return rows.select("n_nationkey", F.try_element_at(readers.json_object(F.col("t")), F.lit("name")).alias("name"))


def _spoken(spark: SparkSession, sf_dir: str, ladder: str) -> DataFrame:
    """The ladder with a double that makes 48 samples for each character, and refuses markup and texts with a full stop."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '.', '') WHEN 2 THEN '***' ELSE text || '…' END").alias("text"))
    chunks = turns.withColumns({"ssml": T.plain_markup("text"), "post_tone": F.expr("CASE WHEN turn % 2 = 0 THEN '-5%' END")})
    planned = synth.plan(chunks, " abcdefghijklmnopqrstuvwxyz", ladder)
    refuses = lambda said: "<" in said or "." in said
    return synth.synthesize(planned, lambda: synth.ToneDouble(48000, refuses), tone=lambda wav, shift: synth.joined([wav, synth.silence(0.001, 48000)], 0))


def _ladder(ladder: str) -> Query:
    return lambda spark, sf_dir: _spoken(spark, sf_dir, ladder).select("conv_id", "turn", "attempt", F.length("wav").alias("bytes"), "error")


def chapter_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each conversation with pauses, and the sample rate of what results."""
    audio_rows = synth.join_chapters(_spoken(spark, sf_dir, "plain"), ["conv_id"], "turn", 0.022)
    return audio_rows.select("conv_id", F.length("wav").alias("bytes"), "n_parts", synth.sample_rates(F.col("wav")).alias("rate"))


def skip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.rejected(_spoken(spark, sf_dir, "plain")).select("conv_id", "turn", "reason")


def chapter_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chapter_idx"), F.expr("chr(10) || text || ' '").alias("text"))
    return writers.whole_text(rows, "conv_id")


def pitch_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || '%' WHEN 1 THEN ' -' || CAST(p_size * 8 AS STRING) || ' hz' WHEN 2 THEN '+' || CAST(p_size AS STRING) || 'HZ' ELSE 'x' END").alias("spec"))
    return parts.select("p_partkey", "spec", F.round(audio.pitch_factor("spec"), 9).alias("factor"))


def atempo_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(audio.tempo_chain(F.col("p_size") / 7.3)).alias("idx", "x")).select("p_partkey", "idx", F.round("x", 9).alias("factor"))


def tone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising, falling and unchanged tones, and ones in hertz."""
    spec = F.expr("CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) || '%' WHEN 1 THEN '-' || CAST(p_size AS STRING) || '%' WHEN 2 THEN '+0%' ELSE CAST(p_size AS STRING) || ' hz' END")
    return _table(spark, sf_dir, "part").select("p_partkey", audio.tone_filter(spec, 48000).alias("filter"))


def playlist_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(segment.lines(F.col("t")), lambda x, i: F.format_string("part_%05d.wav", i + 1))
    rows = _source(spark, sf_dir, TEXT).select("doc_id", F.array_join(state.playlist(parts, F.lit("silence.wav"), 0.022), "\n").alias("playlist"))
    return rows


def tone_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tone_histogram(_table(spark, sf_dir, "documents").withColumn("post_tone", F.expr("CASE WHEN lang = 'en' THEN ' ' ELSE ' -' || CAST(length(text) % 5 AS STRING) || '% ' END")))


def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.chapter_counts(_table(spark, sf_dir, "documents").withColumn("post_tone", F.expr("CASE WHEN lang = 'en' THEN ' ' ELSE '-5%' END")), ["source", "lang"])


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return state.pending(docs, _table(spark, sf_dir, "labels"), ["doc_id"])


def parts_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "lang"), _table(spark, sf_dir, "labels")
    return state.parts_to_make(docs, labels.where("quality = 1"), labels.where("toxic = 1"), ["doc_id"])


def cached_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_key"), F.lit(250).alias("max_chars"), "text")
    cache = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter_key"), F.when(F.col("toxic") == 1, 200).otherwise(250).alias("max_chars"), F.when(F.col("quality") == 1, F.array(F.lit("kept"), F.lit(" "))).otherwise(F.array(F.lit(" "))).alias("chunks"))
    rows = state.with_cached_chunks(docs, cache, segment.lines(F.col("text")))
    return rows.select(F.col("chapter_key").alias("doc_id"), "from_cache", F.array_join("chunks", "|").alias("chunks"))


def state_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_key"), "source", F.expr("CASE WHEN n_chars % 3 = 0 THEN NULL ELSE lang END").alias("lang"))
    old = docs.join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter_key"), "toxic"), "chapter_key").withColumn("source", F.expr("CASE WHEN toxic = 1 THEN 'other' ELSE source END"))
    return state.invalidated(docs, old, signature=("source", "lang")).select("chapter_key", "stale")


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("type"), F.col("n_name").alias("pitch")).where("type < 20")
    return state.with_profile(_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("type")), nations)


def ordered_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ordered_text(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "\n\n")


def synth_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _source(spark, sf_dir, QUOTES).select("doc_id", F.col("t").alias("text"), T.plain_markup("t").alias("ssml"))
    return synth.plan(chunks, " abcdefghijklmnopqrstuvwxyz.,").select("doc_id", "try_markup", "try_text", "try_allowed")


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("type"), "text", F.lit(None).cast("string").alias("ssml"), F.expr("CASE WHEN turn = 0 THEN '-5%' ELSE '' END").alias("post_tone"))
    return writers.parsed_files(turns, "conv_id", ["turn"])


_QUERIES |= {
    f.__name__: f
    for f in (
        fb2_chapters, fb2_written, pitch_factor, atempo_chain, tone_filter, playlist_manifest, tone_histogram, chapter_counts, resume_pending,
        parts_to_make, cached_chunks, state_invalidation, profile_lookup, ordered_concat, synth_plan, chunk_files,
        texts_strict, texts_lenient, texts_filled, chunk_files_read, json_settings, chapter_audio, skip_markers, chapter_whole_text,
    )
}
_QUERIES |= {f"synth_{ladder}": _ladder(ladder) for ladder in ("markup", "plain", "again", "none")}

_LINES = _of(_sql_filled("string_split($T, chr(10))"), "text")
_SQL |= {
    "pitch_factor": "SELECT p_partkey, spec, CASE WHEN spec LIKE '%\\%' ESCAPE '\\' THEN round(1 + p_size / 100.0::DOUBLE, 9) WHEN spec LIKE '%hz' AND 200 - p_size * 8 > 0 THEN round((200 - p_size * 8) / 200.0::DOUBLE, 9) WHEN spec LIKE '%HZ' THEN round((200 + p_size) / 200.0::DOUBLE, 9) END AS factor FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR || '%' WHEN 1 THEN ' -' || (p_size * 8)::VARCHAR || ' hz' WHEN 2 THEN '+' || p_size::VARCHAR || 'HZ' ELSE 'x' END AS spec FROM part)",
    "atempo_chain": "WITH RECURSIVE r(p_partkey, idx, x, f) AS (SELECT p_partkey, 0, CASE WHEN x > 2 THEN x / 2 WHEN x < 0.5 THEN x / 0.5 END, CASE WHEN x > 2 THEN 2.0 WHEN x < 0.5 THEN 0.5 ELSE x END FROM (SELECT p_partkey, p_size / 7.3::DOUBLE AS x FROM part) UNION ALL SELECT p_partkey, idx + 1, CASE WHEN x > 2 THEN x / 2 WHEN x < 0.5 THEN x / 0.5 END, CASE WHEN x > 2 THEN 2.0 WHEN x < 0.5 THEN 0.5 ELSE x END FROM r WHERE x IS NOT NULL) SELECT p_partkey, CAST(idx AS INTEGER) AS idx, round(f, 9) AS factor FROM r",
    "playlist_manifest": f"SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: 'file ' || chr(39) || format('part_{{:05d}}.wav', i) || chr(39)), chr(10) || 'file ' || chr(39) || 'silence.wav' || chr(39) || chr(10)) AS playlist FROM (SELECT doc_id, {_LINES} AS p FROM documents)",
    "tone_histogram": "SELECT post_tone, count(*) AS n FROM (SELECT '-' || (length(text) % 5)::VARCHAR || '%' AS post_tone FROM documents WHERE lang <> 'en') GROUP BY 1",
    "chapter_counts": "SELECT source, lang, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE lang <> 'en') AS n_toned FROM documents GROUP BY source, lang",
    "resume_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "parts_to_make": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)",
    "cached_chunks": f"SELECT d.doc_id, l.doc_id IS NOT NULL AS from_cache, CASE WHEN l.doc_id IS NOT NULL THEN 'kept' ELSE array_to_string({_LINES}, '|') END AS chunks FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic <> 1 AND quality = 1) l ON d.doc_id = l.doc_id",
    "state_invalidation": "SELECT d.doc_id AS chapter_key, coalesce(l.toxic = 1 AND d.source <> 'other', false) AS stale FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "profile_lookup": "SELECT c_nationkey AS type, c_custkey, n_name AS pitch, n_name IS NOT NULL AS known FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20",
    "ordered_concat": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "fb2_chapters": "SELECT page_id, CAST(1 AS BIGINT) AS chapter_idx, url AS title, regexp_replace(regexp_replace(regexp_replace(html, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS text, CAST(NULL AS VARCHAR) AS error FROM pages",
}

_MARKER = rf"{WS}+((?:Том{WS}+\p{{Nd}}+{WS}+)?Глава{WS}+\p{{Nd}}+{WS}*[-–—:]{WS}*[^\n]{{1,120}})"
_ISOLATED = rf"regexp_replace(regexp_replace(regexp_replace($T, '{_MARKER}', chr(10) || chr(10) || '\1' || chr(2) || chr(10) || chr(10), 'g'), '{WS}*\x02', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_PLAIN = r"string_split(regexp_replace($T, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10))"
_UNESCAPED = r"replace(replace(replace($T, '\r\n', chr(10)), '\n', chr(10)), '\r', chr(10))"
_UNWRAPPED = _of(STRIP, "regexp_replace(ltrim($T, '\ufeff'), '^`', '')")


def _sql_listed(parts: str, rewriting: str) -> str:
    return f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, parts[i] AS value FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {parts.replace('$T', 't')} AS parts FROM {_from(rewriting)}))"


# what the double is asked to say: s the cleaned text, a its allowed characters
_TURNS = "(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '.', '') WHEN 2 THEN '***' ELSE text || '…' END AS t FROM conversations)"
_SPEAKER = _of(COMPACT, r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace($T, '[*«»\"„“”‘’]', '', 'g'), '—', '-'), '–', '-'), '…', '.'), '...', '.'), '. . .', '.'), '\.{3,}', '.', 'g')".replace("$T", _of(STRIP, "t")))
_CLEANED = f"replace({_of(STRIP, _of(_STARLESS, 't'))}, chr(34), '')"


def _sql_ladder(ladder: str) -> str:
    """Refused are markup, and texts with a full stop; a toned part is 48 samples longer."""
    clean = {"markup": _CLEANED, "plain": _SPEAKER, "again": _SPEAKER}.get(ladder)
    tone = "CASE WHEN turn % 2 = 0 THEN 96 ELSE 0 END"
    if clean is None:
        return "SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS attempt, CAST(NULL AS INTEGER) AS bytes, 'ValueError: refused' AS error FROM conversations"
    allowed = _of(COMPACT, "regexp_replace(lower(s), '[^ a-z]', '', 'g')")
    differs = "true" if ladder == "again" else "a <> s"
    return (
        f"SELECT conv_id, turn, CASE WHEN s = '' THEN NULL WHEN NOT contains(s, '.') THEN 'text' WHEN a <> '' AND {differs} THEN 'allowed' END AS attempt, "
        f"CAST(CASE WHEN s = '' THEN NULL WHEN NOT contains(s, '.') THEN 44 + 96 * length(s) + {tone} WHEN a <> '' AND {differs} THEN 44 + 96 * length(a) + {tone} END AS INTEGER) AS bytes, "
        f"CASE WHEN s <> '' AND contains(s, '.') AND NOT (a <> '' AND {differs}) THEN 'ValueError: refused' END AS error "
        f"FROM (SELECT *, {allowed} AS a FROM (SELECT conv_id, turn, {clean} AS s FROM {_TURNS}))"
    )


_SQL |= {f"synth_{ladder}": _sql_ladder(ladder) for ladder in ("markup", "plain", "again", "none")}
_SQL |= {
    "texts_strict": "SELECT CAST(doc_id AS VARCHAR) AS path, text || chr(10) || 'end' AS text FROM documents",
    "texts_lenient": "SELECT CAST(doc_id AS VARCHAR) AS path, text || chr(65533) || 'x' AS text FROM documents",
    "texts_filled": f"SELECT CAST(doc_id AS VARCHAR) AS path, {_of(STRIP, 'text')} AS text FROM documents",
    "chunk_files_read": (
        "SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS chunk_idx, CASE WHEN turn % 5 = 3 THEN ' ' ELSE role END AS type, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text, "
        "CASE WHEN turn = 1 THEN '<p/>' END AS ssml, CASE WHEN turn = 2 THEN '-5%' END AS post_tone, CASE WHEN turn % 5 = 3 THEN 'no type' WHEN turn % 5 = 4 THEN 'no text' END AS reason FROM conversations"
    ),
    "json_settings": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS name FROM nation",
    "chapter_audio": f"SELECT conv_id, CAST(44 + sum(bytes - 44) + 2 * 1056 * (count(*) - 1) AS INTEGER) AS bytes, count(*) AS n_parts, CAST(48000 AS BIGINT) AS rate FROM ({_sql_ladder('plain')}) WHERE bytes IS NOT NULL GROUP BY conv_id",
    "skip_markers": f"SELECT conv_id, turn, coalesce(error, 'empty after cleaning') AS reason FROM ({_sql_ladder('plain')}) WHERE bytes IS NULL",
    "chapter_whole_text": f"SELECT conv_id, string_agg({_of(STRIP, 'text')}, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id",
}

_ALLOWED = _of(COMPACT, "regexp_replace(lower(c), '[^ a-z.,]', '', 'g')")
_CLEAN_LINES = r"string_split(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), chr(10))"
_BOOK_HEAD = (
    f'<?xml version="1.0" encoding="utf-8"?>\n<FictionBook xmlns="{readers.NAMESPACE}">\n  <description>\n    <title-info>\n      '
    "' || CASE WHEN coalesce(source, '') = '' THEN '<book-title />' ELSE '<book-title>' || " + _of(_ESCAPE, "source") + " || '</book-title>' END || '\n      <lang>ru</lang>\n    </title-info>\n"
    '    <document-info>\n      <program-used>fabula</program-used>\n      <date value="2024-01-01">2024-01-01</date>\n    </document-info>\n  </description>\n'
    "  <body>\n    <section>\n      <title>\n        <p>Глава 1</p>\n      </title>\n"
)
_LINE_ENDS = f"'{_BOOK_HEAD}' || array_to_string(list_transform(ps, lambda p: '      <p>' || p || '</p>\n'), '') || '    </section>\n  </body>\n</FictionBook>'"

_SQL |= {
    "isolate_headings": f"SELECT doc_id, {_of(_ISOLATED, 't')} AS value FROM {_from(GLUED)}",
    "escaped_paragraphs": _sql_listed(_sql_filled(_of(_PLAIN, _of(_ISOLATED, _of(_UNESCAPED, _UNWRAPPED)))), ESCAPED),
    "normalize_text": rf"SELECT doc_id, regexp_replace({_sql_commas('t', ('the', 'der', 'le'))}, '\?!|!\?', '?', 'g') AS value FROM {_from(COMMAS)}",
    "fb2_written": (
        f"SELECT doc_id, {_LINE_ENDS} AS fb2 FROM (SELECT doc_id, source, list_transform({B.filled(_CLEAN_LINES)}, lambda p: {_of(_ESCAPE, 'p')}) AS ps FROM documents)"
    ),
    "chunk_files": (
        "SELECT conv_id, '[' || chr(10) || string_agg('  {\"type\":' || to_json(role) || ',\"text\":' || to_json(text) || CASE WHEN turn = 0 THEN ',\"post_tone\":\"-5%\"' ELSE '' END || '}', ',' || chr(10) ORDER BY turn) || chr(10) || ']' AS json, "
        "string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) || chr(10) AS lines FROM conversations GROUP BY conv_id"
    ),
    "tone_filter": (
        "SELECT p_partkey, CASE WHEN f = 1 THEN 'copy' ELSE format('asetrate=48000*{:.9f},aresample=48000,atempo={:.6f}', f, 1 / f) END AS filter "
        "FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 + p_size / 100.0::DOUBLE WHEN 1 THEN 1 - p_size / 100.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE (200 + p_size) / 200.0::DOUBLE END AS f FROM part)"
    ),
    "synth_plan": (
        f"SELECT doc_id, CASE WHEN c <> '' AND c = s THEN '<speak><p>' || {_of(_ESCAPE, 't')} || '</p></speak>' END AS try_markup, nullif(c, '') AS try_text, CASE WHEN c <> '' AND a <> '' AND a <> c THEN a END AS try_allowed "
        f"FROM (SELECT *, {_ALLOWED} AS a "
        f"FROM (SELECT doc_id, t, {_of(STRIP, 't')} AS s, replace({_of(COMPACT, 't')}, chr(34), '') AS c FROM {_from(QUOTES)}))"
    ),
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
