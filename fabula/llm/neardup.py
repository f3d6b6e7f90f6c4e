"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Every document's set of word shingles gives a fingerprint of the whole set
   and a MinHash signature of 64 values.  Documents with one fingerprint are
   copies; the smallest doc_id of each fingerprint goes on alone.
2. The forest: 16 orders of the same signatures, order t starting with values
   4t.  Each order is sorted as a whole by range partitioning (the id is part of
   the key, so any number of equal signatures spreads over many tasks).  A
   row's candidates are its next neighbours in the order, those of the longest
   common prefix.  How deep that prefix is follows the density of the region: a
   sparse region compares rows that share two values, a dense one rows that
   share eight.  In each order a row is linked to the most alike of them, so
   large groups hang together by many orders without all their pairs.  A
   128-bit sketch of the signature drops candidates whose similarity is plainly
   below the threshold.
3. Candidate links are confirmed on the full sets, in rounds: first a few links
   of each document, then the links that still join different components, with
   more links a document in each round, until none is left untested.  So every
   candidate is either confirmed, refuted, or lies inside a component.
4. A dense region holds more rows than step 2 compares.  So every region, all
   rows that share the four values of an order (16 such chances find a pair of
   similarity 0.8 with a probability of 0.9998), is then gone through whole:
   rows of different components are compared in blocks of bounded size, on their
   full sets, inside the task.  Nothing is emitted but the links that join
   components, and two blocks of one component never meet, so groups of near
   copies cost nothing here, and documents that are alike just below the threshold
   make no rows, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fabula.llm import kernels as K
from fabula.llm.components import connected_components
from fabula.llm.runtime import Scratch, broadcast_if_small, keep_columns, shuffle_parts, ship

TREES = 16
DEPTH = 4
VALUES = TREES * DEPTH
#: Neighbours in each order that a row is compared with.
REACH = 12
#: Links to the most alike of them that go on at first; step 4 takes the others.
BEST = 2
#: Least values that neighbours have in common at the start of an order.
LEAST_PREFIX = 2
#: Sketch fields (of 64, two bits each) that a candidate must share.  A pair of
#: similarity 0.8 shares 54 on average, fewer than 40 about once in a million.
LEAST_SHARED = 40
#: Links of a document tested in each round; the last round tests all.
ROUNDS = (4, None)
#: Documents and shingles of a block of a region, about.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 18

#: Up to so many ids (8 bytes each) of documents with candidates are broadcast to where texts are read; more are joined.
BROADCAST_IDS = 2_000_000

_A = (K.mix(np.arange(1, VALUES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (K.mix(np.arange(1001, 1001 + VALUES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The 64 MinHash values (uint32) of a set of 64-bit hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        x = low[i : i + 4096]
        np.minimum(best, ((x[None, :] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=best)
    return best


def orders_and_sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures [n, 64] to the 16 leading keys of the orders and the two sketch words."""
    mixed = values * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    short = (mixed & np.uint32(0xFFFF)).astype(np.uint64).reshape(len(values), TREES, DEPTH)
    keys = (short << np.array([48, 32, 16, 0], np.uint64)).sum(axis=2, dtype=np.uint64)
    fields = ((mixed >> np.uint32(20)) & np.uint32(3)).astype(np.uint64).reshape(len(values), 2, 32)
    sketch = (fields << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), sketch.view(np.int64)


def shared_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch fields (of 32) that two arrays of sketch words share."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return 32 - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).astype(np.int64)


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (the set's fingerprint), keys (16 longs), s1, s2 of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.string_column(batch.column("text"))
            n = batch.num_rows
            sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            values = np.zeros((n, VALUES), np.uint32)
            for i, j in K.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                for k, s in enumerate(K.shingle_sets(part, offsets[i : j + 1] - offsets[i], width), i):
                    sizes[k] = len(s)
                    if len(s):
                        prints[k] = K.mix(s).sum(), K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                        values[k] = minhash(s)
            keys, sketch = orders_and_sketch(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TREES), pa.array(keys.ravel()))
            signed = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(signed[:, 0]), pa.array(signed[:, 1]), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                ["doc_id", "n_shingles", "f1", "f2", "keys", "s1", "s2"],
            )

    return documents.mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, s1 long, s2 long")


def _common_values(a1: np.ndarray, b1: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Leading 16-bit values in common of the keys (a1, a2) and (b1, b2)."""
    def lead(x: np.ndarray) -> np.ndarray:
        x = x.view(np.uint64)
        return (x < np.uint64(1 << 48)).astype(np.int64) + (x < np.uint64(1 << 32)) + (x < np.uint64(1 << 16)) + (x == 0)

    first = lead(a1 ^ b1)
    return np.where(first == DEPTH, DEPTH + lead(a2 ^ b2), first)


def candidates(reps: DataFrame, parts: int):
    """Links a < b with the number of shared sketch fields, from all orders (repeats possible), with the rows at
    the edges of partitions (edge not null); and the function that links the latter."""
    rows = reps.select("doc_id", "s1", "s2", "keys", F.posexplode("keys").alias("tree", "k1")).select(
        F.col("tree").cast("int").alias("tree"), "k1", F.element_at("keys", F.pmod(F.col("tree") + 1, F.lit(TREES)).cast("int") + 1).alias("k2"), "doc_id", "s1", "s2"
    )
    names = ["tree", "k1", "k2", "doc_id", "s1", "s2"]
    ordered = rows.repartitionByRange(parts, "tree", "k1", "k2", "doc_id").sortWithinPartitions("tree", "k1", "k2", "doc_id")

    def pairs(cols: list[np.ndarray], upto: int) -> tuple[np.ndarray, ...]:
        """Of each of the first ``upto`` rows, the links to the BEST most alike of its next REACH rows."""
        tree, k1, k2, ids, s1, s2 = cols
        n = len(ids)
        shared = np.full((REACH + 1, upto), -1, np.int64)
        for step in range(1, min(REACH, n - 1) + 1):
            m = min(upto, n - step)
            x, y = slice(0, m), slice(step, m + step)
            fields = shared_fields(s1[x], s1[y]) + shared_fields(s2[x], s2[y])
            good = (tree[x] == tree[y]) & (fields >= LEAST_SHARED) & (_common_values(k1[x], k1[y], k2[x], k2[y]) >= LEAST_PREFIX)
            shared[step, :m] = np.where(good, fields, -1)
        out = []
        at = np.arange(upto)
        for _ in range(BEST):
            step = shared.argmax(axis=0)
            value = shared[step, at]
            shared[step, at] = -1
            hit = np.flatnonzero(value >= 0)
            a, b = ids[hit], ids[hit + step[hit]]
            out.append((np.minimum(a, b), np.maximum(a, b), value[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within the partition; and its first and last rows, for the links across its edges."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rest, head, seen = None, None, 0
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in names]
            if not len(cols[0]):
                continue
            if seen < REACH:
                head = [x[: REACH - seen] for x in cols] if head is None else [np.concatenate([h, x[: REACH - seen]]) for h, x in zip(head, cols)]
            seen += len(cols[0])
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            upto = max(0, len(rest[0]) - REACH)
            yield _edge_batch(*pairs(rest, upto))
            rest = [x[upto:] for x in rest]
        if seen:
            yield _edge_batch(*pairs(rest, len(rest[0])))
            tail = [x[-REACH:] for x in rest]
        if seen:
            for side, rows_ in ((0, head), (1, tail)):
                m = len(rows_[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows_[3]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.full(m, part * 2 + side)), pa.array(rows_[0].astype(np.int32)), *(pa.array(rows_[k]) for k in (1, 2, 4, 5))], FIELDS
                )

    FIELDS = ["a", "b", "shared", "edge", "tree", "k1", "k2", "s1", "s2"]

    def _edge_batch(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        none = lambda t: pa.nulls(len(a), t)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), none(pa.int64()), none(pa.int32()), *(none(pa.int64()) for _ in range(4))], FIELDS)

    found = ordered.mapInArrow(neighbours, "a long, b long, shared long, edge long, tree int, k1 long, k2 long, s1 long, s2 long")
    return found, pairs


def _across(found: DataFrame, pairs) -> DataFrame:
    """Links across the edges of partitions: a row for each partition's first and last neighbours, in their order."""
    names = ["tree", "k1", "k2", "a", "s1", "s2"]

    def over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            cols = [np.concatenate([np.asarray(b.column(c)) for b in got]) for c in names]
            order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
            a, b, s = pairs([c[order] for c in cols], len(order))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "shared"])

    return found.where("edge is not null").select(*names).repartition(1).mapInArrow(over_edges, "a long, b long, shared long")


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and shingles (the sorted distinct 64-bit hashes as bytes) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = K.string_column(batch.column("text"))
            for i, j in K.slices(offsets):
                sets = [s.tobytes() for s in K.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, shingles binary")


def _hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in hashes, and the hashes, of a column of sets."""
    offsets, data = K.string_column(column)
    return (offsets - offsets[0]) // 8, data[offsets[0] : offsets[-1]].view(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b and linked (100 * intersection >= percent * union) of each pair, on the full sets."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oa, da = _hashes(batch.column("set_a"))
            ob, db = _hashes(batch.column("set_b"))
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.concatenate([da[oa[i] : oa[i + 1]], db[ob[i] : ob[i + 1]]])
                size = len(both)
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= percent * (size - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    side = lambda i: sets.select(F.col("doc_id").alias(i), F.col("shingles").alias(f"set_{i}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(measure, "a long, b long, linked boolean")


def _sets_of(docs: DataFrame, ids: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """The sets of the documents ``ids`` (distinct doc_id), written; one row for each different set of a doc_id."""
    ids = scratch.write(ids, "ids")
    sets = scratch.write(shingled(docs.join(broadcast_if_small(ids, BROADCAST_IDS), "doc_id", "left_semi"), width), "sets")
    if sets.count() > ids.count():  # rows repeat
        sets = scratch.write(sets.dropDuplicates(["doc_id", "shingles"]), "sets")
    return sets


def settle(open_links: DataFrame, docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame | None:
    """The components after all links (a, b, shared; written) are confirmed, refuted or within one; None without links."""
    if open_links.isEmpty():
        return None
    active = open_links.select(F.col("a").alias("doc_id")).unionByName(open_links.select(F.col("b").alias("doc_id"))).distinct()
    sets = _sets_of(docs, active, scratch, width)
    component = None
    for most in ROUNDS:
        if open_links.isEmpty():
            break
        chosen = open_links.select("a", "b")
        if most is not None:
            ends = open_links.select(F.col("a").alias("u"), "a", "b", "shared").unionByName(open_links.select(F.col("b").alias("u"), "a", "b", "shared"))
            best = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("shared"), F.xxhash64("a", "b")))
            other = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("a", "b"), "a", "b"))
            chosen = ends.withColumn("r", best).withColumn("o", other).where((F.col("r") <= most // 2) | (F.col("o") <= most - most // 2)).select("a", "b").distinct()
        tested = scratch.write(confirm(chosen, sets, percent), "tested")
        good = tested.where("linked").select("a", "b")
        if component is not None:
            good = good.unionByName(component.select(F.col("id").alias("a"), F.col("component").alias("b")))
        component = scratch.write(connected_components(good, scratch), "component")
        if most is None:
            break
        side = lambda c: component.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        rest = open_links.join(tested.select("a", "b"), ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
        rest = rest.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b", "shared")
        following = scratch.write(rest, "links")
        scratch.drop(open_links)
        open_links = following
    scratch.drop(sets)
    return component


def regions(reps: DataFrame, component: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Pairs of blocks that go through the regions with more than one component: region, pair, side, doc_id, of, n, s1, s2.

    A row goes to each pair that its block is in, with the side 0 or 1, or 2 in a
    block that is compared with itself.  Members of a component that fills a
    block have blocks of their own.
    """
    labelled = reps.withColumn("of", F.col("doc_id"))
    if component is not None:
        of = component.select(F.col("id").alias("doc_id"), F.col("component").alias("of"))
        labelled = reps.join(of, "doc_id", "left").withColumn("of", F.coalesce("of", "doc_id"))
    rows = labelled.select("doc_id", "of", F.col("n_shingles").alias("n"), "s1", "s2", F.posexplode("keys").alias("tree", "key"))
    several = rows.groupBy("tree", "key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("tree", "key")
    rows = scratch.write(rows.join(several, ["tree", "key"], "left_semi").withColumn("region", F.xxhash64("tree", "key")).drop("tree", "key"), "regions")
    parts = F.greatest(F.ceil(F.sum("docs") / BLOCK_DOCS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int")
    own = rows.groupBy("region", "of").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    whole = (F.col("docs") > BLOCK_DOCS) | (F.col("shingles") > BLOCK_SHINGLES)
    # (region, large component or null, its blocks)
    of = F.when(whole, F.col("of"))
    dealt = scratch.write(own.groupBy("region", of.alias("large")).agg(parts.alias("parts")), "dealt")
    blocks = dealt.select("region", "large", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    block = F.struct(F.coalesce("large", F.lit(-(1 << 63))).alias("large"), "part")
    blocks = blocks.select("region", F.col("large").isNotNull().alias("single"), block.alias("block"))
    left = blocks.select("region", F.col("single").alias("single_a"), F.col("block").alias("a"))
    two = left.join(blocks.select("region", F.col("single").alias("single_b"), F.col("block").alias("b")), "region")
    two = two.where("a <= b and not (single_a and single_b and a.large = b.large)").select("region", F.xxhash64("region", "a", "b").alias("pair"), "a", "b")
    same = F.col("a") == F.col("b")
    ends = two.select("region", "pair", F.col("a").alias("block"), F.when(same, 2).otherwise(0).alias("side")).unionByName(
        two.where(~same).select("region", "pair", F.col("b").alias("block"), F.lit(1).alias("side"))
    )
    large = dealt.where("large is not null").select("region", F.col("large").alias("of"), F.col("parts").alias("own_parts"))
    small = dealt.where("large is null").select("region", "parts")
    placed = rows.join(large, ["region", "of"], "left").join(small, "region", "left")
    in_block = F.when(F.col("own_parts").isNotNull(), F.struct(F.col("of").alias("large"), F.pmod(F.xxhash64("doc_id"), F.col("own_parts")).cast("int").alias("part"))).otherwise(
        F.struct(F.lit(-(1 << 63)).alias("large"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    )
    placed = placed.withColumn("block", in_block).select("region", "block", "doc_id", "of", "n", "s1", "s2")
    return placed.join(ends, ["region", "block"]).select("region", "pair", "side", "doc_id", "of", "n", "s1", "s2")


def block_links(side: np.ndarray, ids: np.ndarray, of: np.ndarray, s1: np.ndarray, s2: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of two blocks (sides 0 and 1, or all of one block: side 2) whose components differ, on full sets.

    Links of two components already joined here are left out.
    """
    size = np.diff(offsets)
    token = np.unique(hashes, return_inverse=True)[1]
    held = np.zeros(int(token.max(initial=0)) + 1, bool)
    label = np.unique(of, return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(side != 1):
        other = (label != label[i]) & (side == 1) if side[i] == 0 else (label != label[i]) & (np.arange(len(ids)) > i)
        other &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
        other = np.flatnonzero(other)
        other = other[shared_fields(s1[other], s1[i : i + 1]) + shared_fields(s2[other], s2[i : i + 1]) >= LEAST_SHARED]
        if not len(other):
            continue
        own = token[offsets[i] : offsets[i + 1]]
        held[own] = True
        starts, n = offsets[other], size[other]
        ends = np.cumsum(n)
        at = np.repeat(starts - ends + n, n) + np.arange(ends[-1])
        common = np.add.reduceat(held[token[at]].astype(np.int64), ends - n)
        held[own] = False
        for j in other[100 * common >= percent * (n + size[i] - common)]:
            if label[j] != label[i]:
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return a, b


def region_links(blocks: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """Links a, b found in pairs of blocks, which come one after another in partitions sorted by pair."""
    names = ["side", "doc_id", "of", "s1", "s2"]
    rows = blocks.join(sets, "doc_id").repartition(parts, "region", "pair").sortWithinPartitions("region", "pair").select("pair", *names, "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            offsets, hashes = _hashes(table.column("shingles"))
            links = block_links(*(np.asarray(table.column(c)) for c in names), offsets, hashes, percent)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["a", "b"])

        last = None
        for batch in batches:
            pair = np.asarray(batch.column("pair"))
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    if held and pair[lo] != last:
                        yield finish()
                        held.clear()
                    held.append(batch.slice(lo, hi - lo))
                    last = pair[lo]
        if held:
            yield finish()

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept.

    documents: doc_id (long, unique) and text; other columns are ignored.  Null
    and empty texts have no shingles and are linked with nothing.  Rows that
    repeat a doc_id with the same text get the same result each; a null doc_id
    keeps a null component and is not kept.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    docs = keep_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = scratch.write(signatures(docs, width), "signed")
    firsts = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    firsts = scratch.write(firsts, "firsts")
    reps = signed.join(firsts, ["f1", "f2", "doc_id"], "left_semi").select("doc_id", "n_shingles", "keys", "s1", "s2").distinct()
    reps = scratch.write(reps, "reps")
    found, pairs = candidates(reps, shuffle_parts(spark))
    found = scratch.write(found, "neighbours")
    links = found.where("edge is null").select("a", "b", "shared").unionByName(_across(found, pairs)).where("a <> b")
    open_links = scratch.write(links.groupBy("a", "b").agg(F.max("shared").alias("shared")), "links")
    scratch.drop(found)
    component = settle(open_links, docs, scratch, width, percent)
    blocks = scratch.write(regions(reps, component, scratch), "blocks")
    sets = _sets_of(docs, blocks.select("doc_id").distinct(), scratch, width)
    more = scratch.write(region_links(blocks, sets, shuffle_parts(spark), percent), "more")
    scratch.drop(blocks, sets)
    if not more.isEmpty():
        if component is not None:
            more = more.unionByName(component.select(F.col("id").alias("a"), F.col("component").alias("b")))
        component = scratch.write(connected_components(more, scratch), "component")
    if component is None:
        named = firsts.withColumn("component_id", F.col("doc_id"))
    else:
        named = firsts.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    named = named.select("f1", "f2", "component_id")
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"))


#: The same for the query over ``documents``, in DuckDB: all pairs by a join of words of two.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), least(len(w), 1) + 1))) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT a AS id, least(a, b) AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.id
"""
