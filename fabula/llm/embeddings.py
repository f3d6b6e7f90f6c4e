"""Near-duplicate vectors: NN-descent, then all pairs, at every size.

1. Equal vectors become one, with a count.  Vectors that are null, zero or hold
   null or non-finite components take no part.
2. A first neighbour graph comes from a few orders by random sign bits: in each,
   a vector's neighbours are the next ones in the order.
3. NN-descent: every vector joins its neighbours, and the vectors it is a
   neighbour of, with one another; what is nearer than the worst of a list
   replaces it.  A vector has two lists, of its own component of the links found
   so far and of all others: the nearest of its own component never crowd out a
   vector beyond it.  When components merge, the places of the second list are
   free for what lies further out, so lists grow until no entry of it is a link.
   Every measured pair at the threshold that joins two components is a link,
   whether a list has room for it or not.  Rounds go on until no components
   merge and few lists change.
4. The links of a component are counted in blocks of its members.  Blocks are
   ranges of the angle to the component's pivot; where two blocks' angles add up
   to no more than the threshold's angle, all pairs are links and only their
   numbers count, so large tight groups need no pairs; where they differ by more,
   none is, so long chains need few.
5. In large tables an audit compares a sample of the vectors without a link, and
   one member of each of some components, with all vectors.  A vector counts as
   missed if it has any link out of its component, so large groups count no more
   than others.  The sample is as large as the evidence needs: even if it shows no
   miss, the vectors missed could be three in a sample.  What the audit finds is
   kept.  Below the target the search goes on from fresh orders.
6. Then all pairs are compared, whatever the size and the audit, in slabs that are
   sent to where the vectors are.  So every link is found, and the result doesn't
   depend on what the search finds, which only makes what is left to join small.
   This takes time with the square of the rows, but shuffles nothing and sends out
   only what joins components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fabula.llm import kernels as K
from fabula.llm.components import connected_components, least_members
from fabula.llm.runtime import Scratch, forget, keep_columns, shuffle_parts, ship

LISTED = 8
REVERSE = 8
#: Orders of a start, for each bit of the number of vectors: the share of pairs an order brings together falls as rows grow.
ORDERS_A_BIT = 1
#: Neighbours on either side in an order.
REACH = 3
SIGN_BITS = 32
#: The audit may ask for so many starts from fresh orders in all.
ATTEMPTS = 4
#: Rounds end early when fewer than this share of the list entries is new.
CHANGED = 0.002
#: Pairs measured in single precision from so far below the threshold are measured again in double precision.
MARGIN = 1e-4
#: Vectors that an audit compares at least, and components of which it compares a member.
AUDIT_QUERIES = 256
AUDIT_RECALL = 0.99
#: Up to so many distinct vectors one start of the search is enough, without an audit; results are the same, as all pairs are compared at every size.
EXACT_ROWS = 150_000
#: Bytes of vectors sent out at once to be compared with all.
SLAB_BYTES = 32 << 20
#: Rows and columns of a product of matrices, and the links that a task holds until it contracts them.
STRIP, COLUMNS, HELD_LINKS = 256, 8192, 1 << 20
BLOCK = 512


def unit_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have ``width`` usable components and their vectors at length 1, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts, ends = np.asarray(column.offsets)[:-1].astype(np.int64), np.asarray(column.offsets)[1:].astype(np.int64)
    good = np.flatnonzero(np.asarray(column.is_valid()) & (ends - starts == width))
    values = column.values
    parts = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    v = parts[starts[good][:, None] + np.arange(width)]
    usable = np.isfinite(v).all(axis=1) & (np.abs(v).max(axis=1, initial=0.0) > 0)
    good, v = good[usable], v[usable]
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0.0)  # so that squares neither vanish nor overflow
    return good, v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _blob(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in vectors], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), kind)
    offsets, data = K.string_column(column)
    return data[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def prepared(rows: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep of every usable row; id, copies, vec of every distinct vector) of the vectors (vec_id, embedding) of one width.

    copies: the different vec_ids of a vector.  Of rows that repeat a vec_id with
    different vectors the one of the least hash counts.
    """

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = unit_vectors(batch.column("embedding"), width)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), _blob(v)], ["vec_id", "vec"])

    units = rows.where("vec_id is not null").mapInArrow(normal, "vec_id long, vec binary").withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    units = scratch.write(units, "units")
    if units.select("vec_id").distinct().count() < units.count():  # rows repeat
        units = scratch.write(units.groupBy("vec_id").agg(F.min(F.struct("h1", "h2", "vec")).alias("m")).select("vec_id", "m.vec", "m.h1", "m.h2"), "units")
    groups = scratch.write(units.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "groups")
    members = units.select("vec_id", "h1", "h2").join(groups.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep")
    reps = units.join(groups.select(F.col("rep").alias("vec_id"), "copies"), "vec_id").select(F.col("vec_id").alias("id"), "copies", "vec")
    return members, scratch.write(reps, "reps")


def ordered_neighbours(reps: DataFrame, orders: range, parts: int) -> DataFrame:
    """u, v of vectors that are near in one of the orders; order r sorts by sign bits of seed r."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vec"))
            ids = np.asarray(batch.column("id"))
            for r in orders:
                planes = np.random.default_rng(1000 + r).standard_normal((v.shape[1], SIGN_BITS))
                bits = (v @ planes > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r)), pa.array(bits @ (1 << np.arange(SIGN_BITS - 1, -1, -1))), pa.array(ids)], ["r", "key", "id"])

    rows = reps.select("id", "vec").mapInArrow(keys, "r long, key long, id long").repartitionByRange(parts, "r", "key", "id").sortWithinPartitions("r", "key", "id")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            own = [np.asarray(batch.column(c)) for c in ("r", "id")]
            fresh = 0 if tail is None else len(tail[0])
            r, ids = own if tail is None else [np.concatenate(x) for x in zip(tail, own)]
            for step in range(1, REACH + 1):
                at = np.arange(max(0, fresh - step), len(ids) - step)
                at = at[r[at] == r[at + step]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[at + step])], ["u", "v"])
            tail = [r[-REACH:], ids[-REACH:]]

    return rows.mapInArrow(near, "u long, v long")


def _measured(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """u, v, sim in both directions of distinct pairs (u, v)."""

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = np.einsum("ij,ij->i", _matrix(batch.column("x")), _matrix(batch.column("y")))
            u, v = batch.column("u"), batch.column("v")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([u, v]), pa.concat_arrays([v, u]), pa.array(np.concatenate([sim, sim]))], ["u", "v", "sim"])

    side = lambda i, x: reps.select(F.col("id").alias(i), F.col("vec").alias(x))
    both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y")
    return both.mapInArrow(cosines, "u long, v long, sim double")


def _labelled(rows: DataFrame, component: DataFrame | None, key: str, name: str) -> DataFrame:
    """``rows`` with the component of ``key``, which is the key itself where it has no links yet."""
    if component is None:
        return rows.withColumn(name, F.col(key))
    of = component.select(F.col("id").alias(key), F.col("component").alias(name))
    return rows.join(of, key, "left").withColumn(name, F.coalesce(name, key))


def _best(edges: DataFrame, component: DataFrame | None) -> DataFrame:
    """The LISTED best entries of each vector within its component (own) and of those beyond it: u, v, sim, own."""
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    sides = _labelled(_labelled(distinct, component, "u", "of_u"), component, "v", "of_v")
    sides = sides.select("u", "v", "sim", (F.col("of_u") == F.col("of_v")).alias("own"))
    rank = F.row_number().over(Window.partitionBy("u", "own").orderBy(F.desc("sim"), "v"))
    return sides.withColumn("r", rank).where(F.col("r") <= LISTED).drop("r")


def _joining(edges: DataFrame, reps: DataFrame, component: DataFrame | None, threshold: float) -> DataFrame:
    """The links a, b among measured pairs whose ends are in different components."""
    close = edges.where(F.col("sim") >= threshold - MARGIN).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    close = _labelled(_labelled(close, component, "u", "of_u"), component, "v", "of_v").where("of_u <> of_v").select("u", "v")
    return _measured(close, reps).where((F.col("sim") >= threshold) & (F.col("u") < F.col("v"))).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _merged(component: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components of the links and of the components known before."""
    if component is not None:
        links = links.unionByName(component.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return scratch.write(connected_components(links, scratch), "component")


def narrowed(reps: DataFrame) -> DataFrame:
    """id, vec in single precision: what the search moves around; links are measured in double precision."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _blob(_matrix(batch.column("vec")).astype(np.float32))], ["id", "vec"])

    return reps.select("id", "vec").mapInArrow(narrow, "id long, vec binary")


def descend(graph: DataFrame, reps: DataFrame, component: DataFrame | None, turn: int, threshold: float) -> DataFrame:
    """Candidates u, v, sim from one round of neighbours' neighbours: those that are nearer than the worst entry
    of u's list (within or beyond its component), and all that join two components at the threshold.

    reps: id, vec in single precision.
    """
    full = lambda own, name: F.when(F.count_if(own) >= LISTED, F.min(F.when(own, F.col("sim")))).otherwise(-2.0).alias(name)
    worst = graph.groupBy("u").agg(full(F.col("own"), "worst"), full(~F.col("own"), "worst_beyond"))
    reverse = graph.select(F.col("v").alias("u"), F.col("u").alias("v"))
    picked = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(turn))))
    reverse = reverse.withColumn("r", picked).where(F.col("r") <= REVERSE).drop("r")
    around = graph.select("u", "v").unionByName(reverse).distinct().unionByName(reps.select(F.col("id").alias("u"), F.col("id").alias("v")))
    held = reps.select(F.col("id").alias("v"), "vec").join(worst.withColumnRenamed("u", "v"), "v", "left")
    held = _labelled(held, component, "v", "of").withColumns({c: F.coalesce(c, F.lit(-2.0)) for c in ("worst", "worst_beyond")})
    rows = around.join(held, "v").select("u", "v", "of", "worst", "worst_beyond", "vec").repartition("u").sortWithinPartitions("u")

    def local(ids: np.ndarray, of: np.ndarray, worst_: np.ndarray, beyond: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sim = x @ x.T
        np.fill_diagonal(sim, -3)
        least = np.where(of[:, None] == of[None, :], worst_[:, None], np.minimum(beyond, threshold - MARGIN)[:, None])
        a, b = np.nonzero(sim > least)
        yield ids[a], ids[b], sim[a, b]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _then_none(batches):
            if batch is not None:
                own = [*(np.asarray(batch.column(c)) for c in ("u", "v", "of", "worst", "worst_beyond")), _matrix(batch.column("vec"), np.float32)]
                if not len(own[0]):
                    continue
                rest = own if rest is None else [np.concatenate(z) for z in zip(rest, own)]
            if rest is None:
                break
            u, v, of, w, beyond, x = rest
            cuts = np.append(np.flatnonzero(np.diff(u)) + 1, len(u) if batch is None else [])
            out, lo = [], 0
            for hi in cuts.astype(int):
                out += local(v[lo:hi], of[lo:hi], w[lo:hi], beyond[lo:hi], x[lo:hi])
                lo = hi
            rest = [z[lo:] for z in rest]
            if out:
                a, b, s = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float64))], ["u", "v", "sim"])

    return rows.mapInArrow(joined, "u long, v long, sim double")


def _then_none(batches):
    yield from batches
    yield None


def compared(some: DataFrame, reps: DataFrame, component: DataFrame | None, scratch: Scratch, threshold: float, once: bool) -> DataFrame:
    """Links a, b that join different components, of the vectors ``some`` with all of ``reps``, by comparing every pair.

    Links are contracted within a task: an id's row leads to the least id that
    the task's links reach, and only ids with a joining link have a row.  With
    ``once``, where ``some`` is all of ``reps``, each pair is compared once.
    """
    spark = reps.sparkSession
    label = lambda df: _labelled(df.select("id", "vec"), component, "id", "of").select("id", "of", "vec")
    rows = scratch.write(label(reps).repartition(shuffle_parts(spark)), "labelled")
    some = rows if once else scratch.write(label(some), "some")
    size = some.agg(F.coalesce(F.sum(F.length("vec") + 16), F.lit(0))).first()[0]
    slabs = -(-size // SLAB_BYTES)
    out = None
    for k in range(slabs):
        slab = some.where(F.pmod(F.xxhash64("id"), F.lit(slabs)) == k).toArrow()
        ids = np.asarray(slab.column("id"))
        order = np.argsort(ids)
        held = spark.sparkContext.broadcast((ids[order], np.asarray(slab.column("of"))[order], _matrix(slab.column("vec"))[order]))
        del slab
        found = scratch.write(rows.mapInArrow(_comparison(held, threshold, once), "a long, b long"), "found")
        held.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def _linked_pairs(v: np.ndarray, x: np.ndarray, of: np.ndarray, label: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of v and of x that are links between different labels: sought in single precision, confirmed in double."""
    margin = MARGIN + v.shape[1] * 2.0**-23  # more than the products in single precision can be off
    a, b = np.nonzero(v.astype(np.float32) @ x.astype(np.float32).T >= threshold - margin)
    keep = of[a] != label[b]
    a, b = a[keep], b[keep]
    sure = np.zeros(len(a), bool)
    for lo in range(0, len(a), COLUMNS):
        part = slice(lo, lo + COLUMNS)
        sure[part] = np.einsum("ij,ij->i", v[a[part]], x[b[part]]) >= threshold
    return a[sure], b[sure]


def _comparison(held, threshold: float, once: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, x = held.value
        links, n = [], 0
        for batch in batches:
            order = np.argsort(np.asarray(batch.column("id")))
            own, of, v = np.asarray(batch.column("id"))[order], np.asarray(batch.column("of"))[order], _matrix(batch.column("vec"))[order]
            for lo in range(0, len(own), STRIP):
                part = slice(lo, lo + STRIP)
                first = int(np.searchsorted(ids, own[lo], "right")) if once else 0
                for at in range(first, len(ids), COLUMNS):
                    a, b = _linked_pairs(v[part], x[at : at + COLUMNS], of[part], label[at : at + COLUMNS], threshold)
                    a, b = a + lo, b + at
                    keep = own[a] < ids[b] if once else np.ones(len(a), bool)
                    links.append((own[a[keep]], ids[b[keep]]))
                    n += int(keep.sum())
                    if n > HELD_LINKS:
                        links = [least_members(*(np.concatenate(z) for z in zip(*links)))]
                        yield pa.RecordBatch.from_arrays([pa.array(z) for z in links.pop()], ["a", "b"])
                        n = 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in least_members(*(np.concatenate(z) for z in zip(*links)))], ["a", "b"])

    return compare


def audit(reps: DataFrame, component: DataFrame, scratch: Scratch, threshold: float, total: int) -> tuple[float, DataFrame] | None:
    """The share of vectors with links whose links all lie inside their component, at the least of what the sample
    allows for, and the joining links of the sample; None if the sample would be half of all vectors."""
    joined = component.count()
    single = total - joined
    queries = max(AUDIT_QUERIES, int(6 * single / ((1 - AUDIT_RECALL) * max(joined, 1))))
    if 2 * queries >= total:
        return None
    dealt = F.xxhash64(F.lit("audit"), "id")
    alone = reps.select("id").join(component, "id", "left_anti").orderBy(dealt, "id").limit(queries)
    members = component.groupBy("component").agg(F.min(F.struct(dealt.alias("h"), "id")).alias("m")).select(F.col("m.id").alias("id"))
    some = scratch.write(alone.withColumn("alone", F.lit(True)).unionByName(members.orderBy(dealt, "id").limit(AUDIT_QUERIES).withColumn("alone", F.lit(False))), "sample")
    links = compared(reps.join(some.select("id"), "id"), reps, component, scratch, threshold, once=False)
    row = some.join(links.select(F.col("a").alias("id")).distinct().withColumn("missed", F.lit(1)), "id", "left").agg(
        F.count_if("alone").alias("n"), F.count_if(F.col("alone") & F.col("missed").isNotNull()).alias("missed"),
        F.count_if(~F.col("alone")).alias("groups"), F.count_if(~F.col("alone") & F.col("missed").isNotNull()).alias("cut"),
    ).first()
    # as many as were missed in the sample, or three where none was (no miss is likely up to there)
    lost = single * max(row.missed, 3 if row.n < single else 0) / max(row.n, 1)
    return min(joined / (joined + lost) if joined + lost else 1.0, 1 - row.cut / max(row.groups, 1)), links


def component_links(component: DataFrame, reps: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """id, n_links of every member of a component: the rows of other members at the threshold, counted in blocks."""
    limit = float(np.arccos(threshold)) - 1e-6  # certain pairs only: safely inside
    beyond = float(np.arccos(threshold)) + 1e-6  # vectors whose angles to the pivot differ by more can't be a link
    members = component.join(reps, "id").select("component", "id", "copies", "vec")
    pivots = members.where("id = component").select("component", F.col("vec").alias("pivot"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.einsum("ij,ij->i", _matrix(batch.column("vec")), _matrix(batch.column("pivot")))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("component", "id", "copies", "vec")] + [pa.array(np.arccos(np.clip(c, -1, 1)))], ["component", "id", "copies", "vec", "angle"])

    turned = scratch.write(members.join(pivots, "component").select("component", "id", "copies", "vec", "pivot").mapInArrow(angles, "component long, id long, copies long, vec binary, angle double"), "angles")
    # blocks of about BLOCK members: ranges of the angle (in 64 classes), then by hash within a class
    classes = turned.withColumn("class", F.floor(F.col("angle") / (limit / 32)).cast("int"))
    sizes = classes.groupBy("component", "class").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("angle").alias("low"), F.max("angle").alias("top"))
    dealt = classes.join(sizes.select("component", "class", F.greatest(F.floor(F.col("n") / BLOCK), F.lit(1)).cast("int").alias("parts")), ["component", "class"])
    dealt = scratch.write(dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), "dealt")
    left = sizes.select("component", F.col("class").alias("ca"), F.col("low").alias("la"), F.col("top").alias("ta"))
    right = sizes.select("component", F.col("class").alias("cb"), F.col("low").alias("lb"), F.col("top").alias("tb"), F.col("copies").alias("copies_b"))
    classes_of_two = left.join(right, "component")  # at most (classes)^2 rows a component
    sure = classes_of_two.where(F.col("ta") + F.col("tb") <= limit).groupBy("component", "ca").agg(F.sum("copies_b").alias("sure"))
    blocks = dealt.groupBy("component", "class", "part").agg(F.count("*").alias("n"))
    near = F.greatest(F.col("lb") - F.col("ta"), F.col("la") - F.col("tb")) <= beyond
    unsure = classes_of_two.where((F.col("ta") + F.col("tb") > limit) & near & (F.col("ca") <= F.col("cb"))).select("component", "ca", "cb")
    a = blocks.select("component", F.col("class").alias("ca"), F.col("part").alias("pa"))
    b = blocks.select("component", F.col("class").alias("cb"), F.col("part").alias("pb"))
    pairs = unsure.join(a, ["component", "ca"]).join(b, ["component", "cb"]).where("ca < cb or pa <= pb")
    pairs = scratch.write(pairs.withColumn("pair", F.xxhash64("component", "ca", "pa", "cb", "pb")), "pairs")
    ends = pairs.select("component", "pair", F.col("ca").alias("class"), F.col("pa").alias("part"), F.lit(0).alias("side")).unionByName(
        pairs.select("component", "pair", F.col("cb").alias("class"), F.col("pb").alias("part"), F.lit(1).alias("side"))
    )
    sent = dealt.join(ends, ["component", "class", "part"]).select("component", "pair", "side", "id", "copies", "vec")

    def count(table: pa.Table) -> pa.Table:
        side, ids = np.asarray(table.column("side")), np.asarray(table.column("id"))
        copies, x = np.asarray(table.column("copies")), _matrix(table.column("vec"))
        a, b = side == 0, side == 1
        linked = x[a] @ x[b].T >= threshold
        linked &= ids[a][:, None] != ids[b][None, :]
        out_ids, out_n = [ids[a]], [linked @ copies[b]]
        if set(ids[a].tolist()) != set(ids[b].tolist()):  # otherwise a block with itself
            out_ids.append(ids[b])
            out_n.append(copies[a] @ linked)
        return pa.table({"id": pa.array(np.concatenate(out_ids)), "n": pa.array(np.concatenate(out_n).astype(np.int64))})

    counted = sent.groupBy("component", "pair").applyInArrow(count, "id long, n long")
    own = sizes.select("component", "class", (F.col("top") * 2 <= limit).alias("with_own"))
    certain = dealt.join(sure.withColumnRenamed("ca", "class"), ["component", "class"]).join(own, ["component", "class"])
    certain = certain.select("id", (F.col("sure") - F.when(F.col("with_own"), F.col("copies")).otherwise(0)).alias("n"))
    return counted.unionByName(certain).groupBy("id").agg(F.sum("n").alias("n_links"))


def _replaced(scratch: Scratch, edges: DataFrame, component: DataFrame | None, *old: DataFrame | None) -> DataFrame:
    """The best lists of ``edges``, written; the old tables are dropped."""
    following = scratch.write(_best(edges, component), "graph")
    scratch.drop(*[t for t in old if t is not None])
    return following


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    embeddings: vec_id (long, unique) and embedding (array of numbers); other
    columns are ignored.  Null, empty or zero vectors, and those with null or
    non-finite components, are linked with nothing; vectors are only linked with
    those of the same number of components.  Equal vectors are linked.  n_links
    counts vec_ids, so rows that repeat one count once (and get the same result
    each; if their vectors differ, that of the one with the least hash).  A null
    vec_id has no links and a null component.  An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    rows = keep_columns(embeddings, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    widths = [r.w for r in rows.select(F.size("embedding").alias("w")).where("w > 0").distinct().collect()]
    known = None
    for width in sorted(widths):
        some = _linked_vectors(rows.where(F.size("embedding") == width) if len(widths) > 1 else rows, width, threshold, scratch)
        known = some if known is None else known.unionByName(some)
    if known is None:
        known = spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    elif len(widths) > 1:  # a vec_id may have vectors of several widths
        known = known.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(known, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def _linked_vectors(rows: DataFrame, width: int, threshold: float, scratch: Scratch) -> DataFrame:
    """vec_id, n_links, component_id of the usable vectors of one width."""
    spark = rows.sparkSession
    members, reps = prepared(rows, width, scratch)
    members = scratch.write(members, "members")
    short = scratch.write(narrowed(reps), "short")
    total = reps.count()
    graph, component, turn = None, None, 0
    orders = max(1, ORDERS_A_BIT * total.bit_length())
    for attempt in range(ATTEMPTS):
        pairs = ordered_neighbours(reps, range(attempt * orders, (attempt + 1) * orders), shuffle_parts(spark))
        pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        measured = scratch.write(_measured(pairs, reps), "measured")
        component = _merged(component, _joining(measured, reps, component, threshold), scratch)
        known = measured if graph is None else graph.select("u", "v", "sim").unionByName(measured)
        graph = _replaced(scratch, known, component, graph, measured)
        while True:
            measured = scratch.write(descend(graph, short, component, turn, threshold), "measured")
            turn += 1
            links = scratch.write(_joining(measured, reps, component, threshold), "links")
            merging = not links.isEmpty()
            if merging:
                component = _merged(component, links, scratch)
            following = _replaced(scratch, graph.select("u", "v", "sim").unionByName(measured), component, measured, links)
            fresh = following.join(graph, ["u", "v"], "left_anti").count()
            scratch.drop(graph)
            graph = following
            forget(spark)
            if not merging and fresh <= CHANGED * total * LISTED:
                break
        if total <= EXACT_ROWS:
            break
        audited = audit(reps, component, scratch, threshold, total)
        if audited is None:
            break
        recall, links = audited
        component = _merged(component, links, scratch)
        if recall >= AUDIT_RECALL:
            break
    component = _merged(component, compared(reps, reps, component, scratch, threshold, once=True), scratch)
    counts = scratch.write(component_links(component, reps, scratch, threshold), "counts")
    named = reps.select("id", "copies").join(component, "id", "left").join(counts, "id", "left")
    named = named.select(F.col("id").alias("rep"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(named, "rep").select("vec_id", "n_links", "component_id")


#: The same for the query over ``embeddings``, in DuckDB: all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda k: k IS NULL OR NOT isfinite(k))) = 0 AND list_max(list_transform(x, lambda k: abs(k))) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), n AS (SELECT a, count(*) AS n FROM e GROUP BY a
), r AS (SELECT a AS id, least(a, b) AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.id
"""
