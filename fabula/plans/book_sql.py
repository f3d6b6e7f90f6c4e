"""SQL of the chunkers and of the dialogue parser, for the queries over rewritten texts.

Every function here makes a DuckDB expression from the expression of a text or of
a list of strings.  Folds run over structs of one type, as ``list_reduce`` asks.
"""

from __future__ import annotations

WS = r"[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"
NEW = "chr(10)"


def strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{WS}+', ''), '{WS}+$', '')"


def compact(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def compact_wide(t: str) -> str:
    return compact(f"replace(replace({t}, chr(8203), ''), chr(8288), '')")


def let(value: str, name: str, body: str) -> str:
    """``body`` in which ``name`` stands for a value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def filled(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda f: {strip('f')}), lambda f: f <> '')"


def paragraphs(t: str) -> str:
    return filled(rf"string_split(regexp_replace({t}, '\n{WS}*\n', chr(1), 'g'), chr(1))")


def sentences(t: str) -> str:
    return filled(rf"string_split(regexp_replace({t}, '([.!?…]){WS}+', '\1' || chr(1), 'g'), chr(1))")


def sentences_tight(t: str) -> str:
    """Of a compact text: ends are marks before a space, a capital or the end, but not the text's first character."""
    return filled(rf"string_split(left({t}, 1) || regexp_replace(substring({t}, 2), '([.!?…])( |[A-ZА-ЯЁ]|$)', '\1' || chr(1) || '\2', 'g'), chr(1))")


def words(t: str) -> str:
    return f"list_filter(string_split({compact(t)}, ' '), lambda w: w <> '')"


_PACK = "{'d': CAST([] AS VARCHAR[]), 'o': %s, 'alone': %s}"
_JOIN = "CASE WHEN s.o = '' THEN x.o ELSE s.o || ' ' || x.o END"
_CLOSE = "CASE WHEN s.o = '' THEN s.d ELSE list_append(s.d, s.o) END"


def _fold(units: str, most: int) -> str:
    """Units (of the type of _PACK) packed while they fit; those that stand alone stay so."""
    step = (
        f"CASE WHEN x.alone THEN {{'d': list_append({_CLOSE}, x.o), 'o': '', 'alone': false}} "
        f"WHEN length({_JOIN}) <= {most} THEN {{'d': s.d, 'o': {_JOIN}, 'alone': false}} ELSE {{'d': {_CLOSE}, 'o': x.o, 'alone': false}} END"
    )
    folded = f"list_reduce({units}, lambda s, x: {step}, {_PACK % (chr(39) * 2, 'false')})"
    return let(folded, "s", _CLOSE)


def pack_words(t: str, most: int) -> str:
    pieces = f"list_transform(range(CAST(ceil(length(w) / {most}.0) AS BIGINT)), lambda k: {_PACK % (f'substring(w, k * {most} + 1, {most})', 'true')})"
    units = f"flatten(list_transform({words(t)}, lambda w: CASE WHEN length(w) > {most} THEN {pieces} ELSE [{_PACK % ('w', 'false')}] END))"
    return _fold(units, most)


def pack_neighbors(chunks: str, most: int) -> str:
    return _fold(f"list_transform({chunks}, lambda c: {_PACK % ('c', 'false')})", most)


def pack_sentences(c: str, most: int) -> str:
    """Of a compact text."""
    cut = f"list_transform({pack_words('y', most)}, lambda p: {_PACK % ('p', 'true')})"
    units = f"flatten(list_transform({sentences(c)}, lambda y: CASE WHEN length(y) > {most} THEN {cut} ELSE [{_PACK % ('y', 'false')}] END))"
    return f"CASE WHEN length({c}) <= {most} THEN [{c}] ELSE {_fold(units, most)} END"


def balance(units: str, most: int) -> str:
    """Units in about equal chunks: d the finished ones, o the open one, n its aim, k the chunks still planned, l the characters left, r what is beyond the plan."""
    aim = "greatest(1, CAST(ceil((%s) / CAST(%s AS DOUBLE)) AS BIGINT))"
    state = "{'d': %s, 'o': %s, 'n': CAST(%s AS BIGINT), 'k': CAST(%s AS BIGINT), 'l': CAST(%s AS BIGINT), 'r': %s}"
    none = "CAST([] AS VARCHAR[])"
    joined = "s.o || ' ' || x.o"
    left = "s.l - length(s.o)"
    step = (
        f"CASE WHEN s.k = 0 THEN {state % ('s.d', 's.o', 's.n', 's.k', 's.l', 'CASE WHEN s.r = chr(0) THEN x.o ELSE s.r || chr(32) || x.o END')} "
        f"WHEN s.o = '' THEN {state % ('s.d', 'x.o', aim % ('s.l', 's.k'), 's.k', 's.l', 's.r')} "
        f"WHEN length(s.o) < s.n AND length(s.o) + 1 + length(x.o) <= {most} THEN {state % ('s.d', joined, 's.n', 's.k', 's.l', 's.r')} "
        f"WHEN s.k = 1 THEN {state % ('list_append(s.d, s.o)', chr(39) * 2, '0', '0', left, 'x.o')} "
        f"ELSE {state % ('list_append(s.d, s.o)', 'x.o', aim % (left, '(s.k - 1)'), 's.k - 1', left, 's.r')} END"
    )
    size = "CAST(list_sum(list_transform(us, lambda u: length(u))) + len(us) - 1 AS BIGINT)"
    first = state % (none, "''", "0", f"ceil({size} / {most}.0)", size, "chr(0)")
    folded = f"list_reduce(list_transform(us, lambda u: {state % (none, 'u', '0', '0', '0', 'chr(0)')}), lambda s, x: {step}, {first})"
    rest = f"CASE WHEN b.r = chr(0) THEN {none} WHEN length(b.r) > {most} THEN {pack_words('b.r', most)} ELSE [b.r] END"
    ended = let(folded, "b", f"list_concat(CASE WHEN b.o = '' THEN b.d ELSE list_append(b.d, b.o) END, {rest})")
    expanded = f"flatten(list_transform({units}, lambda y: CASE WHEN length(y) > {most} THEN {pack_words('y', most)} ELSE [y] END))"
    return let(expanded, "us", f"CASE WHEN len(us) < 2 THEN us ELSE {ended} END")


def chunked(t: str, most: int) -> str:
    """The text chunker: balanced within paragraphs, packed across them."""
    units = sentences_tight("e")
    own = f"CASE WHEN len({units}) = 0 THEN {pack_words('e', most)} WHEN length(e) <= {most} THEN [e] ELSE {balance(units, most)} END"
    return pack_neighbors(f"flatten(list_transform({paragraphs(t)}, lambda g: {let(compact_wide('g'), 'e', own)}))", most)


def spelled(t: str, said: str) -> str:
    """Numbers in words; ``said`` makes words of the digits z."""
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[0-9]+|[^0-9]+'), lambda z: CASE WHEN regexp_matches(z, '^[0-9]') THEN {said} ELSE z END), '')"


def chunk_paragraphs(lines: str, said: str, most: int) -> str:
    whole = f"array_to_string(list_filter(list_transform({lines}, lambda v: {strip(spelled('v', said))}), lambda v: v <> ''), {NEW} || {NEW})"
    return let(whole, "t2", chunked("t2", most))


def chunk_lines(t: str, said: str, most: int) -> str:
    rows = filled(f"string_split({spelled(t, said)}, {NEW})")
    return f"flatten(list_transform({rows}, lambda v: CASE WHEN length(v) <= {most} THEN [v] ELSE {chunked('v', most)} END))"


# ---------------------------------------------------------------- dialogue
def terminal(t: str) -> str:
    return f"CASE WHEN right({t}, 1) IN (',', ':', ';') THEN left({t}, length({t}) - 1) || '.' WHEN right({t}, 1) IN ('.', '!', '?', '…') THEN {t} ELSE {t} || '.' END"


def capital(t: str) -> str:
    return f"(upper(left({t}, 1)) || substring({t}, 2))"


def escaped(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _markup(kind: str, t: str, profiles: dict) -> str:
    """Prosody of the kind's profile; a question has none, nor has a kind without one."""
    cases = "".join(
        f" WHEN '{name}' THEN '<speak><p><prosody pitch=\"{p.get('pitch', 'medium')}\" rate=\"{p.get('rate', 'medium')}\">' || {escaped(t)} || '</prosody></p></speak>'"
        for name, p in profiles.items() if name != "question" and ("pitch" in p or "rate" in p)
    )
    return f"CASE {kind} WHEN 'question' THEN '<speak><p>' || {escaped(t)} || '</p></speak>'{cases} END"


def _utterances(rows: str, keys: str) -> str:
    """Of speech (keys, t): keys, j, kind, text; the sentences of each t, neighbours of one kind but questions merged."""
    marked = rf"regexp_replace(x, '([A-Za-zА-Яа-яЁё0-9-]+){WS}*\?$', '*\1*?')"
    return (
        f"(SELECT {keys}, grp AS j, any_value(kind) AS kind, string_agg(x, ' ' ORDER BY i) AS text FROM ("
        f"SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY i) AS grp FROM ("
        f"SELECT {keys}, i, kind, {marked} AS x, CASE WHEN kind <> 'question' AND lag(kind) OVER (PARTITION BY {keys} ORDER BY i) = kind THEN 0 ELSE 1 END AS fresh FROM ("
        f"SELECT *, CASE right(x, 1) WHEN '?' THEN 'question' WHEN '!' THEN 'exclamation' ELSE 'line' END AS kind FROM ("
        f"SELECT {keys}, i, {let(capital('parts[i]'), 'y', terminal('y'))} AS x FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM ("
        f"SELECT {keys}, {let(let(compact('t'), 'c', terminal('c')), 'y', sentences('y'))} AS parts FROM {rows})))))) GROUP BY {keys}, grp)"
    )


def _said(t: str) -> str:
    """An author's chunk."""
    return let(capital(compact(t)), "y", terminal("y"))


def parse_book(normal: str, remark: str, profiles: dict, most: int) -> str:
    """normal: a query of doc_id and t, normalised texts; remark: whether the part p (lower case, compact) is the author's."""
    dash = f"string_split(regexp_replace({strip('substring(p, 2)')}, '{WS}+-{WS}+', chr(1), 'g'), chr(1))"
    sql = (
        f"WITH n AS MATERIALIZED ({normal}), "
        f"a AS (SELECT doc_id, i - 1 AS para_idx, {compact('parts[i]')} AS p FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {paragraphs('t')} AS parts FROM n))), "
        f"d AS (SELECT doc_id, para_idx, i, parts[i] AS t FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, para_idx, {filled(dash)} AS parts FROM a WHERE starts_with(p, '-')))), "
        f"m AS (SELECT *, {let('lower(' + compact('t') + ')', 'p', remark)} AS remark FROM d), "
        "f AS (SELECT *, CASE WHEN NOT remark AND NOT coalesce(lag(remark) OVER (PARTITION BY doc_id, para_idx ORDER BY i), true) THEN 0 ELSE 1 END AS fresh FROM m), "
        "g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, para_idx ORDER BY i) AS run FROM f), "
        "r AS MATERIALIZED (SELECT doc_id, para_idx, run, any_value(remark) AS remark, string_agg(t, ' - ' ORDER BY i) AS t FROM g GROUP BY doc_id, para_idx, run), "
        f"c AS MATERIALIZED (SELECT doc_id, para_idx, 0 AS run, 0 AS j, 'author' AS kind, {_said('p')} AS text FROM a WHERE NOT starts_with(p, '-') "
        f"UNION ALL SELECT doc_id, para_idx, run, 0, 'author', {_said('t')} FROM r WHERE remark "
        f"UNION ALL SELECT * FROM {_utterances('(SELECT * FROM r WHERE NOT remark)', 'doc_id, para_idx, run')}), "
    )
    if most > 0:
        keys = "doc_id, para_idx, run, j, q"
        sql += (
            f"l AS (SELECT *, unnest(range(1, len(parts) + 1)) AS q FROM (SELECT *, {let('text', 'c', pack_sentences('c', most))} AS parts FROM c WHERE length(text) > {most})), "
            "k AS MATERIALIZED (SELECT doc_id, para_idx, run, j, q, kind, parts[q] AS t, len(parts) AS n FROM l), "
            "o AS (SELECT doc_id, para_idx, run, j, 0 AS q, 0 AS jj, kind, text FROM c WHERE length(text) <= "
            f"{most} UNION ALL SELECT doc_id, para_idx, run, j, q, 0, kind, t FROM k WHERE n <= 1 "
            f"UNION ALL SELECT doc_id, para_idx, run, j, q, 0, kind, {_said('t')} FROM k WHERE n > 1 AND kind = 'author' "
            f"UNION ALL SELECT doc_id, para_idx, run, j, q, j2, kind, text FROM (SELECT doc_id, para_idx, run, j0 AS j, q, j AS j2, kind, text FROM {_utterances('(SELECT *, j AS j0 FROM k WHERE n > 1 AND kind <> ' + chr(39) + 'author' + chr(39) + ')', keys.replace(' j,', ' j0,'))})) "
        )
    else:
        sql += "o AS (SELECT doc_id, para_idx, run, j, 0 AS q, 0 AS jj, kind, text FROM c) "
    return sql + (
        "SELECT doc_id, CAST(para_idx AS INTEGER) AS para_idx, CAST(row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY run, j, q, jj) - 1 AS INTEGER) AS chunk_idx, "
        f"kind AS type, text, {_markup('kind', 'text', profiles)} AS ssml, CAST(NULL AS VARCHAR) AS post_tone FROM o"
    )
