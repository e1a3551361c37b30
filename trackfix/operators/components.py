"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.session import materialize

#: Parts of a large component in the last join.
SALTS = 16
#: Nodes that a task's stars hold before it starts others.
FOREST_NODES = 500_000
#: So many edges at most, left by all tasks' stars together, are joined by one task, which holds more of its own.
FEW_EDGES = 200_000


def _codes(column: pa.Array) -> np.ndarray:
    """Each value's rank among the distinct ones; null comes first. Structs rank by their fields in order."""
    if not pa.types.is_struct(column.type):
        some = pc.unique(column)
        rank = np.empty(len(some), np.int64)
        rank[pc.sort_indices(some, null_placement="at_start").to_numpy()] = np.arange(len(some))
        return rank[pc.index_in(column, some).to_numpy(zero_copy_only=False)]
    code = np.zeros(len(column), np.int64)
    for field in column.flatten():
        own = _codes(field)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return code


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component: roots hook onto the least root they meet, then all pointers jump to roots."""
    parent = np.arange(n)
    while len(a):
        a, b = parent[a], parent[b]
        live = a != b
        a, b = a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _as_stars(edges: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([c.combine_chunks() for c in edges.columns])
    _, first, code = np.unique(_codes(ends), return_index=True, return_inverse=True)
    parent = _roots(code[: len(edges)], code[len(edges) :], len(first))
    child = np.flatnonzero(parent != np.arange(len(first)))
    return pa.table([ends.take(pa.array(first[parent[child]])), ends.take(pa.array(first[child]))], schema=edges.schema)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the least nodes of what they connect, in bounded memory.

    Nodes are numbered in their order and joined by arrays; stars stand in for their edges when more come.
    """
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(len(t) for t in held) > 2 * FOREST_NODES:
            held = [_as_stars(pa.concat_tables(held))]
            if len(held[0]) > FOREST_NODES:
                yield from held.pop().to_batches()
    if held:
        yield from _as_stars(pa.concat_tables(held)).to_batches()


def connected_components(edges: DataFrame, src: str, dst: str, together: list[str] | None = None) -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the component's least node.

    ``src`` and ``dst`` name two columns of one orderable type (a number, a string, a struct). Null ends,
    loops, repeated and reversed edges are harmless; an empty table gives an empty result.

    First each task turns its edges into stars; ``together`` names columns by which edges are dealt out for
    that, where they mostly bound a component (a sequence and a range of its nodes, say), and mostly nothing is
    left to do. Without it, up to ``FEW_EDGES`` edges of stars are joined at once, which spares the jobs of the rounds. Else each round every node points to the least node of its closed neighbourhood and the graph contracts
    along the pointers, so that only edges between different groups remain. Even rounds order nodes by
    themselves (a star around its least node ends in one round), odd rounds by a hash of the round, under
    which long chains lose a constant share of their nodes. Rounds are written to the shared folder; no
    round gathers a node's neighbours, so hubs cost only partial aggregates and joins that can be split.
    """
    a, b = F.col("a"), F.col("b")
    level = (
        (edges.repartition(*together) if together else edges)
        .select(F.least(F.col(src), F.col(dst)).alias("a"), F.greatest(F.col(src), F.col(dst)).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (a != b))
    )
    level = materialize(level.mapInArrow(_stars, level.schema))
    if not together and level.count() <= FEW_EDGES:
        level = materialize(level.coalesce(1).mapInArrow(_stars, level.schema))
        return level.select(b.alias("node"), a.alias("component")).union(level.select(a, a).distinct())
    if together:
        ends = level.select(a.alias("node"), F.lit(0).alias("leaf")).union(level.select(b, F.lit(1)))
        crossed = ends.groupBy("node").agg(F.sum("leaf").alias("stars"), F.min("leaf").alias("leaf")).where("stars > 1 OR (stars = 1 AND leaf = 0)")
        if crossed.isEmpty():  # every node is in one star
            return level.select(b.alias("node"), a.alias("component")).union(level.select(a, a).distinct())
    pointers: list[DataFrame] = []
    while not level.isEmpty():
        both = level.union(level.select(b, a))
        if len(pointers) % 2 == 0:
            near = both.groupBy("a").agg(F.min("b").alias("near"))
            pointed = near.select(F.col("a").alias("node"), F.least("a", "near").alias("parent"))
        else:
            salt = F.lit(len(pointers))
            key = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), c.alias("v"))
            near = both.groupBy("a").agg(F.min(key(b)).alias("near"))
            pointed = near.select(F.col("a").alias("node"), F.least(key(a), F.col("near"))["v"].alias("parent"))
        pointed = materialize(pointed)
        pointers.append(pointed)
        of_a = pointed.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = pointed.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = level.join(of_a, "a").join(of_b, "b").where(F.col("pa") != F.col("pb"))
        level = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not pointers:
        return level.select(a.alias("node"), b.alias("component"))
    root = pointers[-1].select("node", F.col("parent").alias("root"))
    for pointed in reversed(pointers[:-1]):
        above = root.select(F.col("node").alias("parent"), "root")
        root = pointed.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    root = materialize(root) if len(pointers) > 1 else root
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    # A component may hold a third of all nodes: its rows are dealt out by a salt as well. The exploded side is
    # larger than Spark estimates, so it is kept from being broadcast.
    salted = root.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread.hint("merge"), ["root", "salt"]).select("node", "component")
