"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans are regular: each kind has a pattern and a test.  They are the
seeds of a bootstrap.  The words around an instance form its lexical patterns:
one word on either side, two words before it, and two after it, where the ends of
the text and other identifiers count as words.  Patterns and instances form a
bipartite graph, scored in turns until it settles: a pattern's confidence is the
confident share of its instances, an instance's confidence joins those of its
patterns by noisy-or.  Strings that may be identifiers but that no base pattern
takes (numbers in groups, written-out addresses) are added as spans where
confident patterns hold them.

Positions come from one pass: the pieces between the matches (``split``) and
the matches (``regexp_extract_all``) alternate, so starts are running sums of
their lengths in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fabula.llm.runtime import Scratch, keep_columns

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored forms of the base patterns: the same matches without
#: backtracking or stack depth.  A run can only match from its own start or from
#: the end of the last match (\G), which spares a scan from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OPEN, _SHUT = r"[\[(<{]", r"[\])>}]"
_AT = rf"(?:@| ?{_OPEN} ?(?:at|AT|@) ?{_SHUT} ?)"
_DOT = rf"(?:\.| ?{_OPEN} ?(?:dot|DOT) ?{_SHUT} ?| dot )"
_NAME = "[A-Za-z0-9._%+-]++"
#: Strings that may be identifiers: an address, its signs perhaps in words or brackets; a number, perhaps in groups.
CANDIDATE = (
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)"
    r"|[+(]{0,2}+(?<![0-9])[0-9](?:[ ().:/_-]{0,3}[0-9])++"
)
#: What a candidate must look like to become a span of a kind.
PLAUSIBLE = {
    "email": rf"^{_NAME}(?:{_AT}| at )\S",
    "ip": r"^[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3,}$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$",
}
#: A pattern counts from so many confident instances (twice as many if it has words on one side only) and from this
#: confidence; an instance from this one.
LEAST_SUPPORT = 5.0
LEAST_PATTERN = 0.8
LEAST_INSTANCE = 0.9
#: Scores have settled when they change by less in all; they only grow, so they do.
SETTLED = 1e-3
#: Characters on either side of an instance in which its context words are sought; longer words are no context.
CONTEXT = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's test."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _word(piece: Column, last: bool) -> Column:
    """The two words next to an instance, the nearest first: array of strings, without case.

    A word is its letters, or its signs if it has none.
    """
    near = F.substring(piece, -CONTEXT, CONTEXT) if last else F.substring(piece, 1, CONTEXT)
    words = F.filter(F.split(F.lower(near), r"\s+"), lambda w: w != "")
    words = F.reverse(words) if last else words
    letters = lambda w: F.regexp_replace(w, r"[^\p{L}^$#]", "")
    return F.transform(F.slice(words, 1, 2), lambda w: F.when(letters(w) == "", w).otherwise(letters(w)))


def found_spans(text: Column, kind: str, pattern: str, test: Callable[[Column], Column], near: int = 0) -> Column:
    """The matches that pass the test: array of (start, kind, end, value, left, right), in order.

    left and right are the two words next to the match; ^ and $ stand for the
    text's ends, # for another match.  With ``near`` also before and after, the
    so many characters in front and behind.
    """
    more = ",before:string,after:string" if near else ""
    item = f"array<struct<start:int,kind:int,end:int,value:string,left:array<string>,right:array<string>{more}>>"
    code = KINDS.index(kind) if kind in KINDS else len(KINDS)
    none = F.array().cast(item)

    def fold(matches: Column) -> Column:
        def over(pieces: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                value, start = F.get(matches, i), state["at"] + F.length(F.get(pieces, i))
                end = start + F.length(value)
                span = F.struct(
                    start.alias("start"), F.lit(code).alias("kind"), end.alias("end"), value.alias("value"),
                    _word(F.concat(F.when(i == 0, F.lit("^ ")).otherwise(F.lit("# ")), F.get(pieces, i)), True).alias("left"),
                    _word(F.concat(F.get(pieces, i + 1), F.when(i == F.size(matches) - 1, F.lit(" $")).otherwise(F.lit(" #"))), False).alias("right"),
                    *([F.substring(F.get(pieces, i), -near, near).alias("before"), F.substring(F.get(pieces, i + 1), 1, near).alias("after")] if near else []),
                )
                return F.struct(end.alias("at"), F.when(test(value), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

            first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
            return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), first, step, lambda s: s["spans"])

        return F.when(F.size(matches) > 0, _let(F.split(text, pattern, -1), over)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), fold)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _patterns(rows: DataFrame) -> DataFrame:
    """``rows`` with a row for each pattern of their words, and whether it has words on both sides."""
    word = lambda side, i: F.coalesce(F.get(side, F.lit(i)), F.lit("~"))
    l1, l2, r1, r2 = word("left", 0), word("left", 1), word("right", 0), word("right", 1)
    form = lambda both, *parts: F.struct(F.concat_ws(" ", *parts).alias("pattern"), F.lit(both).alias("both"))
    blank = F.lit("_")
    return rows.withColumn("p", F.explode(F.array(form(True, l1, blank, r1), form(False, l2, l1, blank), form(False, blank, r1, r2)))).select("*", "p.pattern", "p.both").drop("p", "left", "right")


def _confident(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """Patterns with their confidence by kind, when scoring the graph in turns has settled.

    edges: distinct pattern, both, instance; seeds: distinct instance, kind.
    """
    totals = scratch.write(edges.groupBy("pattern", "both").agg(F.count("*").alias("n")), "totals")
    least = F.when(F.col("both"), LEAST_SUPPORT).otherwise(2 * LEAST_SUPPORT)
    known = certain = seeds.withColumn("conf", F.lit(1.0))
    before = -1.0
    while True:
        held = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"))
        scored = held.join(totals, "pattern").where(F.col("mass") >= least).withColumn("conf", F.col("mass") / (F.col("n") + 1))
        patterns = scratch.write(scored.where(F.col("conf") >= LEAST_PATTERN).select("pattern", "kind", "conf"), "patterns")
        state = patterns.agg(F.coalesce(F.sum("conf"), F.lit(0.0))).first()[0]
        if state - before < SETTLED:
            return patterns
        before = state
        spread = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("conf"))
        known = certain.unionByName(spread.where(_plausible())).groupBy("instance", "kind").agg(F.max("conf").alias("conf"))


def _plausible() -> Column:
    """Whether ``instance`` looks like the kind numbered ``kind``."""
    plausible = F.lit(False)
    for code, k in enumerate(KINDS):
        plausible = F.when(F.col("kind") == code, F.col("instance").rlike(PLAUSIBLE[k])).otherwise(plausible)
    return plausible


def personal_data(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 hold the base spans alone; spans also holds the
    n_added spans that the bootstrap discovers.  Null and empty texts have no
    spans (the hash of the empty string, and an empty string).  Repeated rows
    get the same result each.  An empty table gives no rows.  Only doc_id and
    text are read; texts are read once and whole.
    """
    scratch = Scratch(documents.sparkSession, "pii")
    docs = keep_columns(documents, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    sign = {"email": "@", "phone": "+"}
    base = {k: found_spans(text, k, PATTERNS[k], lambda v, k=k: _holds(k, v)) for k in KINDS}
    for k, mark in sign.items():
        base[k] = F.when(F.contains(text, F.lit(mark)), base[k]).otherwise(F.array())
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *[base[k].alias(k) for k in KINDS], found_spans(text, "token", CANDIDATE, lambda v: (F.length(_digits(v)) >= 7) | v.rlike("[A-Za-z]")).alias("tokens"))
    rows = scratch.write(rows, "spans")
    every = F.concat(*KINDS)
    seeds = rows.select(F.explode(every).alias("s")).select(F.col("s.left").alias("left"), F.col("s.right").alias("right"), F.col("s.value").alias("instance"), F.col("s.kind").alias("kind"))
    free = F.filter("tokens", lambda t: ~F.exists(every, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    tokens = rows.select("doc_id", "text_hash", F.explode(free).alias("t")).select("doc_id", "text_hash", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.left").alias("left"), F.col("t.right").alias("right"), F.col("t.value").alias("instance"))
    edges = _patterns(seeds.drop("kind")).unionByName(_patterns(tokens.select("left", "right", "instance"))).distinct()
    edges = scratch.write(edges, "edges")
    patterns = _confident(edges, scratch.write(seeds.select("instance", "kind").distinct(), "seeds"), scratch)
    scores = edges.join(patterns, "pattern").where(_plausible()).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("conf"))
    scores = scores.groupBy("instance").agg(F.max(F.struct("conf", F.negative("kind").alias("k"))).alias("best")).where(F.col("best.conf") >= LEAST_INSTANCE).select("instance", F.negative("best.k").alias("kind"))
    added = tokens.join(scores, "instance").select("doc_id", "text_hash", F.struct("start", "kind", "end").alias("s")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("s")).alias("added"))
    short = rows.select(
        "doc_id", "text_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(every), 256).alias("base_sha256"),
        F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"),
    )
    both = short.alias("r").join(added.alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_hash") == F.col("a.text_hash")), "left")
    more = F.coalesce(F.col("a.added"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return both.select("r.doc_id", *[f"r.n_{k}" for k in KINDS], "r.base_sha256", _joined(F.concat("r.base", more)).alias("spans"), F.size(more).cast("long").alias("n_added"))
