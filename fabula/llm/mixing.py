"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``alpha``, normalised; alpha 1
keeps the natural mix, 0 makes sources equal.  Alpha is found by bisection, for
a target entropy of the weights or for a limit on how much more often one
source is repeated than another.  A source's budget is its weight times the
whole budget.  It is filled by whole passes over the source and then a prefix of
a permutation: rows are dealt into blocks by a keyed hash, blocks come in the
order of another, and within the block where the budget ends rows come in the
order of a third.  So what a row gets depends on a few numbers of its source
alone: mixing reads texts in place and shuffles only sums.

There may be any number of sources: their shares stay in tables, of which the
driver sees sums only, and several exponents are tried in one pass.  Tables with
a row for each source are broadcast while they are small, else joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fabula.llm.runtime import Scratch, keep_columns

#: Rows of a block, on average.
BLOCK_ROWS = 1024
#: The place where a budget ends is sought in ranges of blocks first, 2 to the power of this, so that no source's blocks meet in one task.
RANGE_BITS = 10
#: Characters of source names, and 64 for each source, up to which tables of sources are broadcast.
BROADCAST_SOURCES = 16 << 20
#: Exponents tried in one pass over the shares, and passes: 5 bits each.
TRIED, PASSES = 31, 11

# Columns added to the caller's; no others are, so that his may have any names.
SOURCE, ROW, BLOCK = "__mix_source", "__mix_row", "__mix_block"


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(shares: list[float], alpha: float) -> list[float]:
    """Shares to the power alpha, normalised; computed from logarithms."""
    logs = [alpha * math.log(s) for s in shares]
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    total = math.fsum(raw)
    return [x / total for x in raw]


def search_alpha(entropies: Callable[[list[float]], list[float]], ratio: float, target_entropy: float | None = None, most_ratio: float | None = None) -> float:
    """The exponent in [0, 1] for the target: the flattest mix that keeps to it.

    entropies: those of the weights at some exponents; ratio: the largest share
    over the smallest.  Every pass narrows the interval to one of TRIED + 1 parts.
    """

    def narrowed(good: Callable[[list[float]], list[bool]]) -> float:  # the least exponent for which good holds, if it holds at 1
        if good([0.0])[0]:
            return 0.0
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            tried = [lo + (hi - lo) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
            held = good(tried) + [True]
            k = held.index(True)
            lo, hi = ([lo] + tried)[k], (tried + [hi])[k]
        return hi

    found = [1.0] if target_entropy is None and most_ratio is None else []
    if target_entropy is not None:
        found.append(narrowed(lambda alphas: [h <= target_entropy for h in entropies(alphas)]))
    if most_ratio is not None:  # weights over shares are largest for the smallest share
        found.append(narrowed(lambda alphas: [ratio ** (1 - a) <= max(1.0, most_ratio) for a in alphas]))
    return max(found)


def find_alpha(shares: list[float], target_entropy: float | None = None, most_ratio: float | None = None) -> float:
    """``search_alpha`` of a list of shares.

    target_entropy: entropy of the weights in nats; beyond what the shares allow
    the nearest end is taken.  most_ratio: no source is repeated more than this
    many times as often as another.  With both, the larger alpha holds.
    """
    if len(shares) < 2:
        return 1.0
    return search_alpha(lambda alphas: [entropy(tempered(shares, a)) for a in alphas], max(shares) / min(shares), target_entropy, most_ratio)


def _table_entropies(shares: DataFrame, total: int, top: float) -> Callable[[list[float]], list[float]]:
    """Entropies of the tempered weights of a table of tokens by source."""
    log_share = F.log(F.col("tokens") / F.lit(total)) - F.lit(top)

    def entropies(alphas: list[float]) -> list[float]:
        # weights are exp(alpha * (log share - top)) over their sum
        tried = shares.select(log_share.alias("s"), F.posexplode(F.array(*map(F.lit, alphas))).alias("k", "a"))
        sums = tried.groupBy("k", "a").agg(F.sum(F.exp(F.col("a") * F.col("s"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("s")) * F.col("s")).alias("m"))
        return [math.log(r.z) - r.a * r.m / r.z for r in sorted(sums.collect(), key=lambda r: r.k)]

    return entropies


def token_count(text: Column) -> Column:
    """Words between white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(seed: int, kind: str, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(kind), *cols)


def _by_source(rows: DataFrame, table: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a table of sources, whose own names start with __mix_."""
    return rows.join(F.broadcast(table) if small else table, SOURCE, how)


def mix(documents: DataFrame, target_entropy: float | None = None, most_ratio: float | None = None, budget: int | str = "total", seed: int = 17) -> DataFrame:
    """``documents`` with the columns __n_tokens, __copies and __alpha.

    budget: tokens of the mix; "total" for the tokens of the input, "cover" for
    the least budget that gives every source a whole pass.  __copies is how often
    the row appears in the mix; over a source's rows the copies use its budget
    up to less than one row (equal rows, which have one hash, are taken
    together), and never exceed it.  Rows without a source form a source of
    their own.  Sources without tokens get one copy of each row.  Ties can't
    occur but between rows of one doc_id and text, which are treated alike.
    An empty table gives no rows.  Other columns are kept, whatever their names
    (but for those that start with __mix_ and the three above).
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    docs = documents.withColumns({SOURCE: source, ROW: _hash(seed, "row", F.col("doc_id"), F.xxhash64("text"))})
    counts = scratch.write(docs.groupBy(SOURCE).agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).alias("__mix_blocks")), "counts")
    size = counts.agg(F.coalesce(F.sum(F.length(f"{SOURCE}.name") + 64), F.lit(0))).first()[0]
    small = size <= BROADCAST_SOURCES
    block = F.pmod(F.xxhash64(ROW), F.col("__mix_blocks")).alias(BLOCK)
    tokens = token_count(F.col("text"))
    sums = _by_source(docs.select(SOURCE, ROW, "text"), counts, small).groupBy(SOURCE, block).agg(F.sum(tokens).alias("tokens"))
    order = _hash(seed, "blocks", F.col(SOURCE), F.col(BLOCK))
    sums = scratch.write(sums.withColumn("__mix_order", order).withColumn("range", F.shiftright("__mix_order", 64 - RANGE_BITS)), "sums")
    shares = scratch.write(sums.groupBy(SOURCE).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "shares")
    facts = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.count("*").alias("n")).first()
    total, top = int(facts.total), math.log(facts.high / facts.total) if facts.n else 0.0
    entropies = _table_entropies(shares, total, top)
    alpha = search_alpha(entropies, facts.high / facts.low, target_entropy, most_ratio) if facts.n > 1 else 1.0
    raw = F.exp(F.lit(alpha) * (F.log(F.col("tokens") / F.lit(total)) - F.lit(top)))
    scale = shares.agg(F.sum(raw)).first()[0] or 1.0
    weight = raw / F.lit(scale)
    if budget == "total":
        whole = total
    elif budget == "cover":
        whole = int(shares.agg(F.coalesce(F.max(F.ceil(F.col("tokens") / weight)), F.lit(0))).first()[0])
    else:
        whole = int(budget)
    own = F.round(weight * F.lit(float(whole))).cast("long")
    own = F.greatest(own, F.col("tokens")) if budget == "cover" else own
    plan = shares.select(SOURCE, F.floor(own / F.col("tokens")).cast("long").alias("passes"), F.pmod(own, F.col("tokens")).alias("rest"))
    plan = scratch.write(plan, "plan")

    # where each source's rest ends: a running sum over ranges of its blocks, over the blocks of one range, over the rows of one block
    def first_beyond(rows: DataFrame, upto: str, by: tuple[str, ...]) -> DataFrame:
        """Of each source the first row at which the running sum of tokens passes ``upto``, with ``left``, what was free before it."""
        running = Window.partitionBy(SOURCE).orderBy(*by)
        beyond = rows.withColumn("sum", F.sum("tokens").over(running)).where(F.col("sum") > F.col(upto))
        return beyond.groupBy(SOURCE).agg(F.min(F.struct(*by, "tokens", "sum", upto)).alias("e")).select(SOURCE, *[F.col(f"e.{c}").alias(c) for c in by], (F.col(f"e.{upto}") - F.col("e.sum") + F.col("e.tokens")).alias("left"))

    ranges = sums.groupBy(SOURCE, "range").agg(F.sum("tokens").alias("tokens"))
    cut = first_beyond(ranges.join(plan, SOURCE), "rest", ("range",)).select(SOURCE, "range", F.col("left").alias("left_of_range"))
    last = first_beyond(sums.join(cut, [SOURCE, "range"]), "left_of_range", ("__mix_order", BLOCK))
    last = scratch.write(last.select(SOURCE, F.col("__mix_order").alias("__mix_cut"), F.col(BLOCK).alias("__mix_last"), F.col("left").alias("__mix_left")), "last")
    inside = _by_source(_by_source(docs.select(SOURCE, ROW, "text"), counts, small).select(SOURCE, ROW, "text", block), last, small).where(F.col(BLOCK) == F.col("__mix_last"))
    rows = inside.groupBy(SOURCE, "__mix_left", ROW).agg(F.sum(tokens).alias("tokens"))
    taken = rows.withColumn("sum", F.sum("tokens").over(Window.partitionBy(SOURCE).orderBy(ROW))).where(F.col("sum") <= F.col("__mix_left")).groupBy(SOURCE).agg(F.max(ROW).alias("__mix_row_cut"))
    final = counts.join(plan.select(SOURCE, F.col("passes").alias("__mix_passes")), SOURCE, "left").join(last, SOURCE, "left").join(taken, SOURCE, "left")
    out = _by_source(docs, scratch.write(final, "final"), small)
    own_block = F.pmod(F.xxhash64(ROW), F.col("__mix_blocks"))
    at = F.struct(_hash(seed, "blocks", F.col(SOURCE), own_block), own_block)
    more = F.when(F.col("__mix_cut").isNull(), F.lit(False)).when(own_block == F.col("__mix_last"), F.coalesce(F.col(ROW) <= F.col("__mix_row_cut"), F.lit(False))).otherwise(at < F.struct("__mix_cut", "__mix_last"))
    copies = F.when(F.col("__mix_passes").isNull(), F.lit(1)).otherwise(F.col("__mix_passes") + more.cast("long")).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in documents.columns], tokens.alias("__n_tokens"), copies.alias("__copies"), F.lit(alpha).alias("__alpha"))


def mixed_rows(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as it has copies, with the columns of documents alone.

    Nulls, empty texts and tables and repeated rows as in ``mix``.
    """
    out = mix(documents, **how).where("__copies > 0")
    repeated = out.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in documents.columns])


def mixture(documents: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, copies, alpha of every row of ``documents``."""
    rows = keep_columns(documents, "doc_id", "source", "text")
    return mix(rows, **how).select("doc_id", "source", F.col("__n_tokens").alias("n_tokens"), F.col("__copies").alias("copies"), F.col("__alpha").alias("alpha"))
