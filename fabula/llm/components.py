"""Connected components by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabula.llm.runtime import Scratch

#: Graphs of up to so many edges (16 bytes each) are contracted in one task.
SMALL_EDGES = 1_000_000


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the edges (a, b) and the least id of each one's component; by hooking and pointer jumping."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return ids, ids[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches if b.num_rows]
        if got:
            ids, low = least_members(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], ["id", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(contract, "id long, component long")


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """The component of every id of ``edges``.

    edges: columns a and b (long, not null), undirected, repeats and loops allowed.
    Returns id and component, the smallest id reachable.  Ids without an edge
    don't appear.  Each round links every node to the smallest node near it
    (a large star, then a small star), which ends after about log(n) rounds;
    only per-node minima are gathered, never a node's list of neighbours.  A
    graph whose counted edges fit the bound SMALL_EDGES is contracted in one task
    instead, with the same result.
    """
    edges = scratch.write(edges.where("a <> b").select("a", "b"), "edges")
    if edges.count() <= SMALL_EDGES:
        return _in_one_task(edges)
    graph = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph")
    before = None
    for _ in range(most_rounds):
        both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        stars = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))
        ).distinct()
        following = scratch.write(stars, "stars")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(graph)
        graph = following
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return graph.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        graph.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
