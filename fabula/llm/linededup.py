"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed if an earlier line (smaller doc_id, then smaller line number)
equals it, or is within one edit (insertion, deletion or substitution of a code
point) of it.  White space around lines doesn't count; blank lines stay.

Deletion variants of every line would be as many rows as the corpus has
characters, so two filters come first, both without loss:

* halves: two lines within one edit share the half that the edit isn't in;
* blocks: within the other half they share all but the block of 16 characters
  that the edit is in.

Lines that share these with another line emit their deletion variants within
the block.  Two forms of keys make groups that need no pairs: ``block without
character i, at position i`` joins lines of one length that differ there at
most, and ``block without a character`` meets the whole block of a line that is
one shorter.  The least position of each key is the candidate, and its edit
distance is verified on the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fabula.llm.runtime import Scratch, forget, keep_columns

#: Shorter lines are only removed if they are equal to an earlier one, unless the caller says otherwise.
LEAST_CHARS = 16
BLOCK = 16
_BLANK = " \t\r\f\x0b"


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, of (the hash of the text), line_no (from 0), line (trimmed, not blank) of the rows with a doc_id and a text."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.select("doc_id", "of", "line_no", F.btrim("raw", F.lit(_BLANK)).alias("line")).where("line <> ''")


def _at(doc_id: Column, line_no: Column, h1: Column) -> Column:
    """The position of a line: 63 bits of the doc_id and its sign, 31 of the line number, 30 of the line's hash."""
    number = lambda c: c.cast("decimal(20,0)")
    return ((number(doc_id) * number(F.lit(1 << 31)) + number(line_no)) * number(F.lit(1 << 30)) + number(F.pmod(h1, F.lit(1 << 30)))).cast("decimal(38,0)")


def _half_keys(line: Column, least: int) -> list[Column]:
    """Keys of the four halves of a line that another may share; null where there is none.

    m is the length of the shorter line of a pair, so a line takes part with its
    own length and with one less; the first m div 2 characters are side 0, the
    last m - m div 2 are side 1.
    """
    size = F.length(line)

    def key(less: int, side: int) -> Column:
        m = size - less
        half = F.floor(m / 2).cast("int")
        part = F.substring(line, F.lit(1), half) if side == 0 else F.right(line, m - half)
        return F.when(size >= least + less, F.xxhash64(m, F.lit(side), part))

    return [key(less, side) for less in (0, 1) for side in (0, 1)]


def _blocks(line: Column, m: Column, side: Column, key: Column) -> Column:
    """The other half without one block: array of (key of what is left, the block)."""
    half = F.floor(m / 2).cast("int")
    size = F.when(side == 0, m - half).otherwise(half)
    rest = F.when(side == 0, F.substring(line, half + 1, F.length(line))).otherwise(F.substring(line, F.lit(1), F.length(line) - (m - half)))

    def block(b: Column) -> Column:
        before = b * BLOCK
        after = F.greatest(size - before - BLOCK, F.lit(0))
        return F.struct(
            F.xxhash64(key, b, F.substring(rest, F.lit(1), before), F.when(after > 0, F.right(rest, after)).otherwise("")).alias("key"),
            F.substring(rest, before + 1, F.length(rest) - before - after).alias("block"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), block)


def _variants(block: Column, key: Column, longer: Column) -> Column:
    """Keys of the block's deletion variants: array of (key, role).

    role 0: blocks of one length that differ at one place at most; role 1: a
    block as it is; role 2: a block less a character, which meets role 1.
    """
    size = F.length(block)
    without = lambda i: F.concat(F.substring(block, F.lit(1), i), F.substring(block, i + 2, size))
    at = F.sequence(F.lit(0), size - 1)
    swapped = F.transform(at, lambda i: F.struct(F.xxhash64(key, F.lit("swap"), size, i, without(i)).alias("key"), F.lit(0).alias("role")))
    whole = F.array(F.struct(F.xxhash64(key, F.lit("cut"), block).alias("key"), F.lit(1).alias("role")))
    cut = F.transform(at, lambda i: F.struct(F.xxhash64(key, F.lit("cut"), without(i)).alias("key"), F.lit(2).alias("role")))
    none = F.array().cast("array<struct<key:bigint,role:int>>")
    return F.when(size == 0, F.when(longer, none).otherwise(whole)).when(longer, F.array_distinct(cut)).otherwise(F.concat(swapped, whole))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another line has too.

    rows hold one row for each line (a distinct text) and key; counting is
    partial before the shuffle, and the join is one that Spark may split.
    """
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return rows.join(several, "key", "left_semi")


def removed_lines(documents: DataFrame, scratch: Scratch, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, of (the hash of its text), line_no of the lines that an earlier line removes; repeats possible."""
    keys = [f"k{i}" for i in range(4)]
    hashed = _lines(documents).select("doc_id", "of", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("size"), *[k.alias(n) for k, n in zip(_half_keys(F.col("line"), least_chars), keys)])
    hashed = hashed.withColumn("at", _at(F.col("doc_id"), F.col("line_no"), F.col("h1")))
    # equal lines: their first position goes on for all of them; what depends on the text alone has one value
    texts = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("size", *keys)])
    texts = scratch.write(texts, "texts")
    forget(documents.sparkSession)
    half = lambda i: F.struct((F.col("size") - i // 2).alias("m"), F.lit(i % 2).alias("side"), F.col(f"k{i}").alias("key"))
    halves = texts.where("k0 is not null").select("at", F.inline(F.array(*[half(i) for i in range(4)]))).where("key is not null")
    halves = scratch.write(_shared(halves), "halves")
    # only lines of shared halves are read again, at their first positions
    wanted = halves.groupBy("at").agg(F.collect_set(F.struct("m", "side", "key")).alias("halves"))
    place = F.pmod("at", F.lit(1 << 61).cast("decimal(20,0)"))
    wanted = wanted.withColumn("place", place).select(F.expr(f"(at - place) div {1 << 61}").alias("doc_id"), F.expr(f"CAST(place div {1 << 30} AS INT)").alias("line_no"), "at", "halves")
    wanted = scratch.write(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "at", "halves")).alias("wanted")), "wanted")
    scratch.drop(halves)
    forget(documents.sparkSession)
    rows = documents.where("text is not null").join(wanted.hint("merge"), "doc_id").select("doc_id", F.split("text", "\n").alias("lines"), "wanted")
    rows = rows.select("doc_id", F.inline(F.transform("wanted", lambda w: F.struct(w["at"].alias("at"), w["line_no"].alias("line_no"), F.btrim(F.get("lines", w["line_no"]), F.lit(_BLANK)).alias("line"), w["halves"].alias("halves")))))
    own = F.col("at") == _at(F.col("doc_id"), F.col("line_no"), F.xxhash64("line"))  # a doc_id may have another text too
    held = scratch.write(rows.where(own).select("at", "line", "halves").dropDuplicates(["at"]), "held")
    forget(documents.sparkSession)
    each = held.select("at", F.length("line").alias("size"), "line", F.explode("halves").alias("h"))
    blocks = each.select("at", "size", F.col("h.m").alias("m"), F.inline(_blocks(F.col("line"), F.col("h.m"), F.col("h.side"), F.col("h.key"))))
    blocks = scratch.write(_shared(blocks), "blocks")
    variants = blocks.select("at", F.inline(_variants(F.col("block"), F.col("key"), F.col("size") > F.col("m")))).distinct()
    least = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"r{r}") for r in (0, 1, 2)], F.count("*").alias("n")).where("n > 1")
    partner = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    pairs = variants.join(least, "key").select("at", partner.alias("other")).where("other < at").distinct()
    texts_of = lambda a, b: held.select(F.col("at").alias(a), F.col("line").alias(b))
    verified = pairs.join(texts_of("at", "line"), "at").join(texts_of("other", "other_line"), "other").where(F.levenshtein("line", "other_line", 1).between(0, 1))
    near = scratch.write(verified.select("at").distinct(), "near")
    scratch.drop(held, blocks)
    forget(documents.sparkSession)
    # all lines of a removed text go; of the other repeated texts all but the first
    fate = texts.select("h1", "h2", "at", "n").join(near.withColumn("near", F.lit(True)), "at", "left").where("n > 1 or near").select("h1", "h2", F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = hashed.select("doc_id", "of", "line_no", "at", "h1", "h2").join(fate, ["h1", "h2"]).where("near or at > first")
    return gone.select("doc_id", "of", "line_no")


def without_repeated_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per row of ``documents``: doc_id, text (what is left), n_lines, n_removed.

    Removed lines go with their line break.  Lines of fewer than ``least_chars``
    characters are only removed if they are equal to an earlier one.  Null texts
    stay null (0 lines); empty texts have one line, which is blank.  A repeated
    row (doc_id and text) gets the same result and doesn't remove the lines of
    its equal; of two texts under one doc_id each loses its own lines.  Rows
    without a doc_id lose nothing and remove nothing.  An empty table gives no
    rows.  Only doc_id and text are read.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    docs = keep_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = removed_lines(docs, scratch, least_chars).groupBy("doc_id", "of").agg(F.collect_set("line_no").alias("gone"))
    gone = scratch.write(gone, "gone")
    forget(documents.sparkSession)
    lines = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.map_contains_key(F.col("dropped"), i), x)), lambda x: x.isNotNull()), "\n")
    )
    both = docs.withColumn("of", F.xxhash64("text")).join(gone.hint("merge"), ["doc_id", "of"], "left").withColumn("dropped", F.map_from_arrays(F.col("gone"), F.col("gone")))
    return both.select(
        "doc_id", left.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = reduce(
    lambda sql, kv: sql.replace(*kv),
    [("$LEAST", str(LEAST_CHARS)), ("$BLANK", "' ' || chr(9) || chr(13) || chr(12) || chr(11)")],
    """
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(parts[i], $BLANK) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), full_lines AS (SELECT * FROM lines WHERE line <> ''
), texts AS (
  SELECT line, min({'d': doc_id, 'l': line_no}) AS pos FROM full_lines GROUP BY line
), long_texts AS (SELECT line, pos, length(line) AS n, unnest(range(1, length(line) + 1)) AS i FROM texts WHERE length(line) >= $LEAST
), swapped AS (
  SELECT pos, min(pos) OVER (PARTITION BY hash(n, i, substring(line, 1, i - 1), substring(line, i + 1))) AS other FROM long_texts
), cut AS (SELECT DISTINCT pos, substring(line, 1, i - 1) || substring(line, i + 1) AS less FROM long_texts WHERE n > $LEAST
), apart AS (SELECT c.pos AS longer, t.pos AS shorter FROM cut c JOIN texts t ON c.less = t.line
), near AS (
  SELECT pos FROM swapped WHERE other < pos
  UNION SELECT longer FROM apart WHERE shorter < longer
  UNION SELECT shorter FROM apart WHERE longer < shorter
), gone AS (
  SELECT DISTINCT f.doc_id, f.line_no FROM full_lines f JOIN texts t USING (line)
  WHERE {'d': f.doc_id, 'l': f.line_no} > t.pos OR t.pos IN (SELECT pos FROM near)
), per_doc AS (SELECT doc_id, list(line_no) AS gone FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN parts ELSE list_filter(parts, lambda x, i: NOT list_contains(gone, i - 1)) END, chr(10)), '')) AS kept_sha256
FROM split s LEFT JOIN per_doc p ON s.doc_id = p.doc_id
""",
)
