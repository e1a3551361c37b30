"""Motion groups: direction clusters, spatial splits, merges, absorption of small fragments."""

from __future__ import annotations

import bisect
import functools
import heapq
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.config import RectifyConfig
from trackfix.functions.scalars import SEQ, finite
from trackfix.operators.components import connected_components
from trackfix.operators.medians import grouped_medians, largest_group
from trackfix.operators.motion import direction_descriptors, direction_similarity, group_descriptors, median_positions, world_fixed_points
from trackfix.operators.neighbours import AXES, nearest, radius_pairs
from trackfix.session import at_once, materialize

#: Queries of one sequence whose edges one task takes, as a power of two.
RANGE_BITS = 17
#: Directions in cells that one task joins.
TASK_DIRECTIONS = 100_000
#: Sequences whose fragments one task absorbs.
TASK_SEQUENCES = 64
GROUP = "seq_id long, group_id int, group_type string, query int"


def keyed_components(edges: DataFrame, part: list[str]) -> DataFrame:
    """``(part..., query, component)`` of edges ``(part..., a, b)``; the component is its least member.

    Edges are dealt out by part and range of ``a``, so that a large sequence is several tasks' work.
    """
    node = lambda c: F.struct(*part, F.col(c).alias("k"))
    dealt = edges.select(*part, node("a").alias("na"), node("b").alias("nb"), F.shiftright(F.col("a"), RANGE_BITS).alias("range"))
    found = connected_components(dealt, "na", "nb", [*part, "range"])
    return found.select(*[F.col(f"node.{p}").alias(p) for p in part], F.col("node.k").alias("query"), F.col("component.k").alias("component"))


def renumber(groups: DataFrame, order: list[str]) -> DataFrame:
    """Groups told apart by ``order`` within a sequence get ids 0, 1, ... in that order.

    ``groups`` are written first, as they are read twice and mostly come from costly steps.
    """
    groups = materialize(groups.select(SEQ, *order, "group_type", "query"))
    rank = F.row_number().over(Window.partitionBy(SEQ).orderBy(*order)) - 1
    ids = groups.select(SEQ, *order).distinct().select(SEQ, *order, rank.cast("int").alias("group_id"))
    return groups.join(ids.hint("merge"), [SEQ, *order]).select(SEQ, "group_id", "group_type", "query")


def _aligned(descriptors: DataFrame, threshold: float, least: int) -> DataFrame:
    """The pairs of :func:`aligned_pairs`, each once, as ``(seq_id, a, b, da, db)`` with both descriptors, whichever is whose.

    Directions of a frame are joined by grid cell; the side is the longest chord that the threshold allows, so both
    ends lie in the same or neighbouring cells, and of two opposite neighbours one is looked into. A pair is kept at
    the first frame where it meets, so that neither a distinct nor another join with the descriptors is needed. Equal
    directions take little room in a file, by which Spark would broadcast the table or put millions of its rows into
    one task: the join is told to sort, and its tasks are counted by rows.
    """
    step = descriptors.select(SEQ, "query", "desc", F.explode("desc").alias("d")).select(SEQ, "query", "desc", "d.frame", "d.dx", "d.dy", "d.dz")
    side = math.sqrt(max(0.0, 2 - 2 * max(threshold, -1.0))) + 1e-4
    axes = ("dx", "dy", "dz")
    step = materialize(step.withColumns({"c" + c: F.floor(F.col(c) / side) for c in axes}))
    # cell 13 is the point's own, cell 26 - i the opposite of cell i
    ahead = F.expr("transform(sequence(13, 26), i -> named_struct('i', i, 'dx', i % 3 - 1, 'dy', (i div 3) % 3 - 1, 'dz', i div 9 - 1))")
    cells = ["c" + c for c in axes]
    tasks = -(-14 * step.count() // TASK_DIRECTIONS) or 1
    spread = step.repartition(-(-tasks // 4), SEQ, "query")  # each becomes 14 rows, which are held for the shuffle
    left = spread.select(SEQ, "frame", F.col("query").alias("a"), F.col("desc").alias("da"), *[F.col(c).alias("a" + c) for c in axes], *cells, F.explode(ahead).alias("o"))
    left = left.select(SEQ, "frame", "a", "da", *["a" + c for c in axes], (F.col("o.i") == 13).alias("own"), *[(F.col("c" + c) + F.col(f"o.{c}")).alias("c" + c) for c in axes])
    right = step.select(SEQ, "frame", F.col("query").alias("b"), F.col("desc").alias("db"), *axes, *cells)
    left, right = left.repartition(tasks, SEQ, "frame", *cells), right.repartition(tasks, SEQ, "frame", *cells)
    alike = lambda p, q: sum((u * v for u, v in zip(p, q, strict=True)), F.lit(0.0)) >= threshold - 1e-6
    once = F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    near = left.join(right.hint("merge"), [SEQ, "frame", *cells]).where(once & alike([F.col("a" + c) for c in axes], [F.col(c) for c in axes]))
    near = near.where(F.size(F.array_intersect("da.frame", "db.frame")) >= least) if least > 1 else near

    def met(p: Column, q: Column) -> Column:
        beside = [F.abs(F.floor(p[c] / side) - F.floor(q[c] / side)) <= 1 for c in axes]
        return functools.reduce(operator.and_, beside, (p["frame"] == q["frame"]) & alike([p[c] for c in axes], [q[c] for c in axes]))

    before = F.exists("da", lambda p: (p["frame"] < F.col("frame")) & F.exists("db", lambda q: met(p, q)))
    return near.where(~F.coalesce(before, F.lit(False))).select(SEQ, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "da", "db")


def aligned_pairs(descriptors: DataFrame, threshold: float, least: int = 1) -> DataFrame:
    """``(seq_id, a, b)``, a < b, whose unit directions have a dot product of at least ``threshold`` at a common frame.

    A mean is no more than its largest term, so these are all pairs that can have a similarity of the
    threshold; those with fewer than ``least`` common frames, which have none, are left out.
    """
    return _aligned(descriptors, threshold, least).select(SEQ, "a", "b")


def direction_edges(descriptors: DataFrame, positions: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """Edges ``(seq_id, a, b, similarity)``, a < b, of points that move alike.

    Pairs are tried only where b is among the ``direction_knn`` nearest of a, so that an edge may be missing
    though a is near b. When that is None, every edge of a sequence is found: see ``aligned_pairs``.
    """
    where = descriptors.select(SEQ, "query").join(positions.hint("merge"), [SEQ, "query"])
    if cfg.direction_knn is None:
        placed = descriptors.join(where.select(SEQ, "query").hint("merge"), [SEQ, "query"])
        judged = _aligned(placed, cfg.direction_cos_threshold, cfg.min_co_visible_frames)
    else:
        pairs = nearest(where, [SEQ], cfg.direction_knn).where("a < b").select(SEQ, "a", "b")
        side = lambda c: descriptors.select(SEQ, F.col("query").alias(c), F.col("desc").alias("d" + c)).hint("merge")
        judged = pairs.join(side("a"), [SEQ, "a"]).join(side("b"), [SEQ, "b"])
    similarity = direction_similarity(F.col("da"), F.col("db"), cfg.min_co_visible_frames)
    return judged.select(SEQ, "a", "b", similarity.alias("similarity")).where(F.col("similarity") >= cfg.direction_cos_threshold)


def motion_clusters(fixed: DataFrame, descriptors: DataFrame, edges: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """First groups: the world-fixed points, then components of the direction graph by least member.

    Descriptors are keyed by query, so that points that stand still never shift those of others.
    """
    comps = keyed_components(edges, [SEQ])
    member = descriptors.select(SEQ, "query").join(comps.hint("merge"), [SEQ, "query"], "left").withColumn("component", F.coalesce("component", "query"))
    size = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "component"))
    kind = F.when(size >= cfg.min_group_size, "co_moving").otherwise("independent_dynamic")
    moving = member.select(SEQ, "query", kind.alias("group_type"), F.lit(1).alias("first"), F.col("component").cast("int").alias("second"))
    still = fixed.select(SEQ, "query", F.lit("world_fixed").alias("group_type"), F.lit(0).alias("first"), F.lit(-1).alias("second"))
    return renumber(still.unionByName(moving), ["first", "second"])


def spatial_split(groups: DataFrame, positions: DataFrame, cfg: RectifyConfig, kind: str = "co_moving", k: int | None = None) -> DataFrame:
    """Splits groups of ``kind`` into the components of their undirected kNN graph; small parts become independent."""
    k = cfg.spatial_knn if k is None else k
    if k <= 0:
        return groups
    size = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "group_id"))
    sized = groups.withColumn("size", size)
    large = sized.where((F.col("group_type") == kind) & (F.col("size") > cfg.min_group_size)).join(positions.hint("merge"), [SEQ, "query"])
    parts = keyed_components(nearest(large, [SEQ, "group_id"], k), [SEQ, "group_id"]).withColumnRenamed("component", "part")
    split = sized.join(parts.hint("merge"), [SEQ, "group_id", "query"], "left")
    eligible = (F.col("group_type") == kind) & (F.col("size") > cfg.min_group_size)
    split = split.withColumn("part", F.when(eligible, F.coalesce("part", "query")).otherwise(F.lit(-1)).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "group_id", "part"))
    new = F.when(eligible & (n < cfg.min_group_size), "independent_dynamic").otherwise(F.col("group_type"))
    return renumber(split.withColumn("group_type", new).withColumnRenamed("group_id", "old"), ["old", "part"])


def group_centroids(groups: DataFrame, positions: DataFrame) -> DataFrame:
    """Median position per axis and size of each group."""
    return _centroids(materialize(groups.join(positions.hint("merge"), [SEQ, "query"])))


def _centroids(member: DataFrame) -> DataFrame:
    largest = largest_group(member, [SEQ, "group_id"])
    return grouped_medians(member, [SEQ, "group_id", "group_type"], list(AXES), [F.count(F.lit(1)).alias("size")], nan=True, largest=largest)


def fragment_scale(groups: DataFrame, positions: DataFrame) -> DataFrame:
    """``(seq_id, group_id, scale)``: median positive distance to the nearest other member.

    1 for a group of one, with a non-finite member, or of equal points only; duplicates have distance 0 and
    don't count.
    """
    return _scales(materialize(groups.join(positions.hint("merge"), [SEQ, "query"])))


def _scales(member: DataFrame) -> DataFrame:
    near = nearest(member, [SEQ, "group_id"], 1).where("d2 > 0").groupBy(SEQ, "group_id").agg(F.median(F.sqrt("d2")).alias("m"))
    whole = member.groupBy(SEQ, "group_id").agg(F.bool_and(finite(*[F.col(c) for c in AXES])).alias("ok"))
    return whole.join(near.hint("merge"), [SEQ, "group_id"], "left").select(SEQ, "group_id", F.coalesce(F.when(F.col("ok"), F.col("m")), F.lit(1.0)).alias("scale"))


def fragment_pairs(groups: DataFrame, points: DataFrame, positions: DataFrame, cfg: RectifyConfig) -> tuple[DataFrame, DataFrame]:
    """Groups that may merge, and the pairs ``(seq_id, a, b, similarity)`` that do.

    The reach of a pair is that of the earlier group alone.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "group_id"))
    large = groups.withColumn("size", size).where((F.col("group_type") == "co_moving") & (F.col("size") >= cfg.merge_min_group_size))
    large = materialize(large.drop("size"))
    desc = materialize(group_descriptors(points, large, cfg).where(F.size("desc") >= cfg.min_co_visible_frames))
    members = large.join(desc.select(SEQ, "group_id").hint("merge"), [SEQ, "group_id"])
    members = materialize(members.join(positions.hint("merge"), [SEQ, "query"]))
    reach = (F.lit(cfg.merge_distance_factor) * F.greatest("scale", F.lit(1e-6))).alias("reach")
    items = _centroids(members).join(_scales(members).hint("merge"), [SEQ, "group_id"]).select(SEQ, "group_id", *AXES, "size", reach)
    items = materialize(items)
    near = radius_pairs(items, [SEQ], "group_id", "reach")
    if cfg.merge_max_group_size is not None:
        small = lambda c: items.select(SEQ, F.col("group_id").alias(c), F.col("size").alias("n" + c))
        near = near.join(small("a"), [SEQ, "a"]).join(small("b"), [SEQ, "b"]).where((F.col("na") <= cfg.merge_max_group_size) | (F.col("nb") <= cfg.merge_max_group_size))
    side = lambda c: desc.select(SEQ, F.col("group_id").alias(c), F.col("desc").alias("d" + c))
    similarity = direction_similarity(F.col("da"), F.col("db"), cfg.min_co_visible_frames).alias("similarity")
    alike = near.join(side("a").hint("merge"), [SEQ, "a"]).join(side("b").hint("merge"), [SEQ, "b"]).select(SEQ, "a", "b", similarity)
    return items, alike.where(F.col("similarity") >= cfg.merge_direction_cos_threshold)


def merge_fragments(groups: DataFrame, points: DataFrame, positions: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """Joins fragments of one motion; merged and mergeable groups come first, in order, then the others."""
    if cfg.merge_distance_factor <= 0 or cfg.merge_direction_cos_threshold <= 0:
        return groups
    items, pairs = fragment_pairs(groups, points, positions, cfg)
    comps = keyed_components(pairs, [SEQ]).withColumnRenamed("query", "group_id")
    several = F.count(F.lit(1)).over(Window.partitionBy(SEQ)) >= 2
    able = items.withColumn("several", several).where("several").select(SEQ, "group_id", F.lit(0).alias("first"))
    new = groups.join(able.hint("merge"), [SEQ, "group_id"], "left").join(comps.hint("merge"), [SEQ, "group_id"], "left")
    new = new.withColumns({"first": F.coalesce("first", F.lit(1)), "second": F.coalesce("component", "group_id").cast("int")})
    return renumber(new, ["first", "second"])


class _Middle:
    """What a part's median needs: its size, and per axis the sorted values around the middle and how many lie outside.

    As long as no more values come than the middle reaches to each side, medians are exact.
    """

    def __init__(self, n: int, below: list[int], values: list[list[float]]) -> None:
        self.n, self.below, self.values = n, below, values
        self.above = [n - b - len(v) for b, v in zip(below, values, strict=True)]
        self.nan = any(v != v for axis in values for v in axis)

    def add(self, xyz: np.ndarray) -> None:
        self.n += len(xyz)
        self.nan |= bool(np.isnan(xyz).any())
        if self.nan:
            return
        for axis, values in enumerate(self.values):
            for v in xyz[:, axis].tolist():
                if self.below[axis] and v <= values[0]:
                    self.below[axis] += 1
                elif self.above[axis] and v >= values[-1]:
                    self.above[axis] += 1
                else:
                    bisect.insort(values, v)

    def median(self) -> list[float]:
        if self.nan:
            return [math.nan] * 3
        return [(v[(self.n - 1) // 2 - b] + v[self.n // 2 - b]) / 2 for b, v in zip(self.below, self.values, strict=True)]


def _whole(xyz: np.ndarray) -> _Middle:
    return _Middle(len(xyz), [0, 0, 0], [sorted(xyz[:, i].tolist()) for i in range(3)])


def _merge_small(small: dict[int, np.ndarray], middles: list[_Middle], least: int, factor: float) -> tuple[list[int], dict[int, list[int]]]:
    """Greedy absorption of parts below ``least`` members, smallest first, into the nearest part in reach.

    ``small`` has the members' positions of these parts, ``middles`` all parts. Returns the parts that stay alone
    in the order they gave up, and the parts of each survivor. Each step depends on the medians that the last
    one left, so a sequence's parts are one task's work; a heap, whose entries are void once a part has grown,
    gives the smallest, and one array the distances of all centroids.
    """
    small, alone, into = dict(small), [], {i: [i] for i in range(len(middles))}
    found = _Centroids(np.array([m.median() for m in middles]).reshape(-1, 3))
    heap = [(middles[i].n, i) for i in small]
    heapq.heapify(heap)
    while heap:
        size, i = heapq.heappop(heap)
        if i not in small or middles[i].n != size:
            continue
        mine = small.pop(i)
        j, gap = found.take(i)
        if gap < factor * max(_scale(mine), 1e-6):
            into[j] += into.pop(i)
            middles[j].add(mine)
            found.put(j, middles[j].median())
            if j in small:
                small[j] = np.concatenate((small[j], mine))
                if middles[j].n < least:
                    heapq.heappush(heap, (middles[j].n, j))
                else:
                    del small[j]
        else:
            alone.append(i)
    return alone, into


class _Centroids:
    """Centroids of parts by number; those taken lie at infinity, and go once they are half."""

    def __init__(self, at: np.ndarray) -> None:
        self.at = [np.where(np.isfinite(at).all(axis=1), at[:, i], np.inf) for i in range(3)]
        self.part = np.arange(len(at))
        self.place, self.taken = self.part.copy(), 0

    def take(self, i: int) -> tuple[int, float]:
        """Removes part ``i`` and returns the nearest other one, the lowest on ties, and its distance; infinite for none."""
        p = self.place[i]
        if p >= len(self.part) or self.part[p] != i:  # it had no finite centroid
            return -1, math.inf
        own = [float(c[p]) for c in self.at]
        self.put(i, [math.inf] * 3)
        self.taken += 1
        if 2 * self.taken > len(self.part):  # what lies at infinity is never the nearest, and so never put anew
            kept = np.isfinite(self.at[0])
            self.part, self.at, self.taken = self.part[kept], [c[kept] for c in self.at], 0
            self.place[self.part] = np.arange(len(self.part))
        if not math.isfinite(own[0]) or not len(self.part):
            return -1, math.inf
        square = (self.at[0] - own[0]) ** 2
        square += (self.at[1] - own[1]) ** 2
        square += (self.at[2] - own[2]) ** 2
        j = int(np.argmin(square))
        return int(self.part[j]), math.sqrt(square[j])

    def put(self, i: int, at: list[float]) -> None:
        p = self.place[i]
        for c, v in zip(self.at, at, strict=True):
            c[p] = v if all(map(math.isfinite, at)) else math.inf


def _absorb(parts: list[np.ndarray], xyz: np.ndarray, least: int, factor: float) -> tuple[list[tuple[int, np.ndarray]], dict[int, np.ndarray]]:
    """:func:`_merge_small` of parts given by their rows of ``xyz``; returns those alone, and the survivors, with their members."""
    alone, into = _merge_small({i: xyz[p] for i, p in enumerate(parts) if len(p) < least}, [_whole(xyz[p]) for p in parts], least, factor)
    members = {i: np.concatenate([parts[j] for j in own]) for i, own in into.items()}
    return [(i, members[i]) for i in alone], {i: m for i, m in members.items() if i not in set(alone)}


def _scale(xyz: np.ndarray) -> float:
    """Median positive nearest-neighbour distance of a part, else 1."""
    if len(xyz) < 2 or not np.isfinite(xyz).all():
        return 1.0
    gap = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    near = gap.min(axis=1)
    near = near[near > 0]
    return float(np.median(near)) if len(near) else 1.0


def _parts(member: DataFrame) -> DataFrame:
    """One row per part of ``member`` (group columns, small, positions): size, small parts' ``members``, others' middle values per axis.

    A median moves by at most one rank for each value that joins, and no more than the small parts' members do.
    """
    key = [SEQ, "group_id"]
    size = F.count(F.lit(1)).over(Window.partitionBy(*key))
    spare = F.sum("small").over(Window.partitionBy(SEQ))
    sized = member.select(*key, "group_type", "small", *AXES).withColumns({"size": size, "spare": spare})
    few = sized.where("small = 1").groupBy(*key, "group_type").agg(F.max("size").alias("size"), F.flatten(F.collect_list(F.array(*AXES))).alias("members"))
    rank = F.row_number().over(Window.partitionBy(*key, "axis").orderBy("v")) - 1
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in AXES]))
    ranked = sized.where("small = 0").select(*key, "group_type", "size", "spare", each.alias("e")).select("*", "e.*").withColumn("rank", rank)
    near = (F.col("rank") >= F.floor((F.col("size") - 1) / 2) - F.col("spare") - 1) & (F.col("rank") <= F.floor(F.col("size") / 2) + F.col("spare") + 1)
    middle = ranked.where(near | F.isnan("v") & (F.col("rank") == F.col("size") - 1))
    own = lambda c, column: F.when(F.col("axis") == c, F.col(column))
    columns = [x for c in AXES for x in (F.min(own(c, "rank")).cast("int").alias("below" + c), F.sort_array(F.collect_list(own(c, "v"))).alias("mid" + c))]
    many = middle.groupBy(*key, "group_type").agg(F.max("size").alias("size"), *columns)
    return few.unionByName(many, allowMissingColumns=True)


def absorb_fragments(groups: DataFrame, positions: DataFrame, cfg: RectifyConfig, world_fixed: bool = False) -> DataFrame:
    """Absorbs small groups of each sequence; lone ones become independent (world-fixed ones stay so).

    ``world_fixed`` treats the world-fixed groups, else all others. Groups that stayed alone come before the
    survivors; the world-fixed ones before the rest. Only sequences with a small group go through Python, as one
    row per part: the members' positions of small parts, and of others the size and, per axis, the values around
    the middle that medians can reach however many small parts join. Members follow their part by a join.
    """
    if not world_fixed and cfg.min_fitting_size <= 1:
        return groups
    mine = (F.col("group_type") == "world_fixed") == F.lit(world_fixed)
    size = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "group_id"))
    member = groups.where(mine).withColumn("small", (size < cfg.min_fitting_size).cast("int")).withColumn("any_small", F.max("small").over(Window.partitionBy(SEQ)))
    least, factor = cfg.min_fitting_size, cfg.fragment_merge_distance_factor

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id").reset_index(drop=True)
        positions_of = lambda i: np.array(pdf["members"][i], float).reshape(-1, 3)
        small = {i: positions_of(i) for i, n in enumerate(pdf["size"]) if n < least}
        middles = [_whole(small[i]) if i in small else _Middle(n, [int(pdf["below" + c][i]) for c in AXES], [list(pdf["mid" + c][i]) for c in AXES]) for i, n in enumerate(pdf["size"])]
        alone, into = _merge_small(small, middles, least, factor)
        order, kind, types = np.zeros(len(pdf), np.int32), np.empty(len(pdf), object), pdf["group_type"]
        for at, i in enumerate([*alone, *sorted(into.keys() - set(alone))]):
            order[into[i]] = at
            if world_fixed:
                kind[into[i]] = types[i]
            elif at < len(alone):
                kind[into[i]] = "independent_dynamic"
            else:
                kind[into[i]] = "co_moving" if len(into[i]) > 1 else types[i]
        return pd.DataFrame({SEQ: pdf[SEQ], "old": pdf["group_id"], "group_id": order, "group_type": kind})

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    member = materialize(member)
    parts = materialize(_parts(member.where("any_small = 1").join(positions.hint("merge"), [SEQ, "query"])))
    tasks = -(-parts.agg(F.count_distinct(SEQ)).first()[0] // TASK_SEQUENCES) or 1  # few bytes, much work
    moved = parts.repartition(tasks, SEQ).groupBy(SEQ).applyInPandas(run, f"{SEQ} {kinds[SEQ]}, old {kinds['group_id']}, group_id {kinds['group_id']}, group_type string")
    old = member.where("any_small = 1").select(SEQ, F.col("group_id").alias("old"), "query")
    absorbed = old.join(moved.hint("merge"), [SEQ, "old"]).select(SEQ, "group_id", "group_type", "query")
    same = member.where("any_small = 0").select(SEQ, "group_id", "group_type", "query")
    changed = same.unionByName(absorbed).withColumn("part", F.lit(0 if world_fixed else 1))
    other = groups.where(~mine).select(SEQ, "group_id", "group_type", "query").withColumn("part", F.lit(1 if world_fixed else 0))
    return renumber(changed.unionByName(other).withColumnRenamed("group_id", "old"), ["part", "old"])


def split_world_fixed(groups: DataFrame, positions: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """Splits the world-fixed points in space and absorbs the small parts; non-finite ones stay whole."""
    bad = groups.where("group_type = 'world_fixed'").join(positions.hint("merge"), [SEQ, "query"]).where(~finite(*[F.col(c) for c in AXES])).select(SEQ).distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "group_id"))
    k = cfg.world_fixed_spatial_knn
    sized = groups.withColumn("size", size).join(bad.withColumn("bad", F.lit(True)), SEQ, "left")
    able = (F.col("group_type") == "world_fixed") & (F.col("size") >= cfg.min_group_size) & F.col("bad").isNull()
    large = sized.where(able).join(positions.hint("merge"), [SEQ, "query"])
    parts = keyed_components(nearest(large, [SEQ, "group_id"], k), [SEQ, "group_id"]).withColumnRenamed("component", "part") if k > 0 else None
    if parts is None:
        return groups
    split = sized.join(parts.hint("merge"), [SEQ, "group_id", "query"], "left").withColumn("part", F.when(able, F.coalesce("part", "query")).otherwise(F.lit(-1)).cast("int"))
    numbered = materialize(renumber(split.withColumnRenamed("group_id", "old"), ["old", "part"]))
    pieces = numbered.where("group_type = 'world_fixed'").select(SEQ, "group_id").distinct().groupBy(SEQ).count().where("count > 1").select(SEQ)
    several = numbered.join(pieces, SEQ, "left_semi")
    return absorb_fragments(several, positions, cfg, world_fixed=True).unionByName(numbered.join(pieces, SEQ, "left_anti"))


def motion_groups(points: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """Groups ``(seq_id, group_id, group_type, query)`` of all points that stand still or move clearly.

    Points that do neither are in no group. Group ids follow the order of the steps: world-fixed parts, then
    lone fragments, then the rest.
    """
    positions, fixed, directed = at_once(
        lambda: materialize(median_positions(points)),
        lambda: materialize(world_fixed_points(points, cfg).select(SEQ, "query")),
        lambda: materialize(direction_descriptors(points, cfg)),
    )
    moving = materialize(directed.join(fixed.hint("merge"), [SEQ, "query"], "left_anti"))
    groups = materialize(motion_clusters(fixed, moving, direction_edges(moving, positions, cfg), cfg))
    groups = materialize(spatial_split(groups, positions, cfg))
    groups = materialize(merge_fragments(groups, points, positions, cfg))
    groups = materialize(_world_fixed_first(split_world_fixed(_world_fixed_first(groups), positions, cfg)))
    return materialize(absorb_fragments(groups, positions, cfg))


def _world_fixed_first(groups: DataFrame) -> DataFrame:
    first = F.when(F.col("group_type") == "world_fixed", 0).otherwise(1)
    return renumber(groups.withColumn("first", first).withColumnRenamed("group_id", "old"), ["first", "old"])
