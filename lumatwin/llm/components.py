"""Connected components over a two-dimensional grid of edge blocks.

Vertices are hashed into ``side`` classes; an edge belongs to the block of its two classes. Each block is one task with a
bounded share of the edges: it runs union-find on them and returns, for every vertex that isn't its own root, the root. Then rows and columns
of the grid exchange what they found: a vertex takes the smallest of its roots as parent, and its other roots become
edges to it for the next round. Rounds go on until no edge is left; last, parents are followed to their roots by
doubling. Only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.operators.bounded import sorted_join
from lumatwin.stage import Stage

#: Edges that one block holds at most, on average.
BLOCK_EDGES = 250_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: the vertices that aren't the smallest of their component, and that smallest vertex."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)  # hook the larger root to the smallest it meets
        while True:  # halve the paths
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    moved = parent != np.arange(len(ids))
    return ids[moved], ids[parent[moved]]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition, blocks one after the other in it, as (vertex, root) of each block."""
    us, vs, cs = [], [], []
    for x in batches:
        us.append(x["u"].to_numpy()), vs.append(x["v"].to_numpy()), cs.append(x["cell"].to_numpy())
    if us:
        u, v, c = np.concatenate(us), np.concatenate(vs), np.concatenate(cs)
        for cell in np.unique(c):
            own = c == cell
            vertex, root = local_roots(u[own], v[own])
            for k in range(0, len(vertex), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(vertex[k : k + 100_000]), pa.array(root[k : k + 100_000])], ["vertex", "root"])


def components(spark: SparkSession, edges: DataFrame, side: int | None = None) -> DataFrame:
    """(vertex, root): each vertex of edges(u, v) with the smallest vertex of its component.

    Null ends and loops are no edges; repeated edges count once; a vertex without an edge isn't in the result, and empty
    edges give an empty result. side: classes of vertices; by default so many that a block holds BLOCK_EDGES edges. A vertex with a third of
    all edges is spread over its whole row of the grid.
    """
    stage = Stage(spark, "components")
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    left = stage.write(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(*ends).distinct(), "edges")
    rounds: list[DataFrame] = []
    while count := left.count():
        n = side or max(2, math.ceil(math.sqrt(2 * count / BLOCK_EDGES)))
        row, column = F.pmod(F.xxhash64("u"), F.lit(n)), F.pmod(F.xxhash64("v"), F.lit(n))
        cell = (F.least(row, column) * n + F.greatest(row, column)).cast("int").alias("cell")
        blocks = left.select("u", "v", cell).repartition(n * (n + 1) // 2, "cell")
        found = stage.write(blocks.mapInArrow(_block, "vertex long, root long"), "found")
        parents = _stable(stage, stage.write(found.groupBy("vertex").agg(F.min("root").alias("root")), "tree"))
        # what a vertex was told besides its smallest root: an edge between the two roots, as far as they aren't the same by now
        top = parents.select(F.col("vertex").alias("root"), F.col("root").alias("top"))
        told = sorted_join(found, top, "root", "left").select("vertex", F.coalesce("top", "root").alias("v"))
        told = sorted_join(told, parents.withColumnRenamed("root", "u"), "vertex").where("u <> v").select(*ends).distinct()
        after = stage.write(told, "edges")
        stage.drop(left, found)
        left = after
        rounds.append(parents)
    if not rounds:
        return left.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    # a vertex with a parent takes no part in later rounds, so each has one parent in all of them together
    tree = rounds[0] if len(rounds) == 1 else _stable(stage, stage.write(reduce(DataFrame.union, rounds), "tree"))
    return tree.union(tree.select(F.col("root").alias("vertex"), "root").distinct())


def _stable(stage: Stage, tree: DataFrame) -> DataFrame:
    """tree(vertex, root) with each vertex at the end of its chain of parents, by doubling."""
    while True:
        up = tree.select(F.col("vertex").alias("root"), F.col("root").alias("higher"))
        jumped = stage.write(sorted_join(tree, up, "root", "left").select("vertex", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "tree")
        stage.drop(tree)
        still = not jumped.where("moved").isEmpty()
        tree = jumped.select("vertex", "root")
        tree._stage_path = jumped._stage_path
        if not still:
            return tree
