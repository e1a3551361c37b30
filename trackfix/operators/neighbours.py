"""Nearest-neighbour and radius joins inside a partition key (a sequence, or a group of one).

Points lie in a tree of boxes: slabs of equal counts, and above them boxes of eight. Pairs of boxes are
followed from the root down, and dropped as soon as their gap is over the reach of the first box. For nearest
neighbours a box's reach is the distance within which its neighbour boxes, by their counts, must hold enough
points; for radius joins it is its largest radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.functions.scalars import finite
from trackfix.session import join_sized, materialize

AXES = ("px", "py", "pz")
CELLS = tuple("at" + axis for axis in AXES)
#: Bits of a box's number for each axis.
BOX_BITS = 20
#: Parts of up to so many points are one box, all pairs of which are compared.
WHOLE = 512
#: Parts of up to so many points ``nearest`` compares in arrays, without a row per pair; and so many pairs at a time.
IN_ARRAYS, PAIRS_AT_ONCE = 4096, 1 << 20
#: Points that a task compares in arrays.
TASK_POINTS = 20_000
LOW, HIGH = tuple("lo" + axis for axis in AXES), tuple("hi" + axis for axis in AXES)


def squared_distance(a: str = "a", b: str = "b") -> Column:
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in AXES), F.lit(0.0))


def _box(shift: int) -> Column:
    """The number of the box that holds ``2 ** shift`` slabs along each axis."""
    return sum((F.shiftleft(F.shiftright(F.col(c).cast("long"), shift), i * BOX_BITS) for i, c in enumerate(CELLS)), F.lit(0).cast("long"))


def _slabs(points: DataFrame, part: list[str], cuts: Column) -> DataFrame:
    """``points`` (part..., k, AXES, more...) with their place in slabs of equal counts: ``cuts`` (of ``size``) of x, of y in each, of z in these."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*part))
    placed, by = points.withColumn("size", size).withColumn("cuts", cuts), list(part)
    for axis, cell in zip(AXES, CELLS, strict=True):
        own = Window.partitionBy(*by)
        place = F.row_number().over(own.orderBy(axis, "k")) - 1
        placed = placed.withColumn(cell, F.floor(place * F.col("cuts") / F.count(F.lit(1)).over(own)).cast("int"))
        by.append(cell)
    return materialize(placed.drop("size").withColumn("box", _box(0)))


def _bounds(placed: DataFrame, part: list[str], box: Column, *more: Column) -> DataFrame:
    return placed.groupBy(*part, box.alias("box")).agg(*[F.min(c).alias("lo" + c) for c in AXES], *[F.max(c).alias("hi" + c) for c in AXES], F.count(F.lit(1)).alias("n"), *more)


def boxed(points: DataFrame, part: list[str], leaf: int) -> tuple[DataFrame, DataFrame]:
    """``points`` (part..., k, AXES) with their ``box`` of at most ``leaf`` points, and each box's bounds.

    Slabs of equal counts along x are cut into as many along y, and these along z. So boxes are small where
    points are dense and wide where they are sparse; an outlier widens one of them.
    """
    placed = _slabs(points.select(*part, "k", *AXES), part, F.ceil(F.cbrt(F.col("size") / leaf)))
    return placed, _bounds(placed, part, F.col("box"))


def _gap(a: str) -> Column:
    """Squared distance of a point to a box, 0 inside; never over that to a point of the box, rounding included."""
    out = [F.greatest(F.col("lo" + c) - F.col(f"{a}.{c}"), F.lit(0.0), F.col(f"{a}.{c}") - F.col("hi" + c)) for c in AXES]
    return sum((d * d for d in out), F.lit(0.0))


def _apart(a: str, b: str) -> Column:
    """Squared distance of two boxes, 0 where they meet; never over that of a point of each."""
    out = [F.greatest(F.col(f"{b}.lo{c}") - F.col(f"{a}.hi{c}"), F.lit(0.0), F.col(f"{a}.lo{c}") - F.col(f"{b}.hi{c}")) for c in AXES]
    return sum((d * d for d in out), F.lit(0.0))


def _across(a: str, b: str) -> Column:
    """Squared distance that no point of the one box and point of the other exceed."""
    out = [F.greatest(F.col(f"{b}.hi{c}") - F.col(f"{a}.lo{c}"), F.col(f"{a}.hi{c}") - F.col(f"{b}.lo{c}")) for c in AXES]
    return sum((d * d for d in out), F.lit(0.0))


def meeting_boxes(placed: DataFrame, part: list[str], k: int | None = None) -> DataFrame:
    """``(part..., a, b, reach, core)``: the boxes ``b`` (structs of box, bounds and count) within the squared reach of ``a``.

    With ``k``, the reach is one within which every point of ``a`` has ``k`` others, and ``core`` tells the
    nearest boxes that suffice for that; else it is the largest ``r2`` of the box's points. Both sides of a pair
    are replaced by their parts in turn, so that a level makes pairs in proportion to its boxes.
    """
    more = [] if k else [F.max("r2").alias("r2")]
    deepest = placed.agg(F.max("cuts")).first()[0]
    depth = max(0, (int(deepest) - 1).bit_length()) if deepest else 0
    fields = ["box", *LOW, *HIGH, "n", *["r2" for _ in more]]
    pairs = None
    for shift in range(depth, -1, -1):
        level = _bounds(placed, part, _box(shift), *more)
        up = sum((F.shiftleft(F.shiftright(F.shiftright(F.col("box"), i * BOX_BITS).bitwiseAND((1 << BOX_BITS) - 1), 1), i * BOX_BITS) for i in range(3)), F.lit(0).cast("long"))
        level = materialize(level.withColumn("up", up)) if depth else level.withColumn("up", up)
        side = lambda name, level=level: level.select(*part, F.col("up").alias("up" + name), F.struct(*fields).alias(name))
        if pairs is None:
            both = side("a").join(side("b").drop("upb").hint("merge"), part).drop("upa")
        else:
            half = pairs.select(*part, F.col("a.box").alias("upa"), "b", "reach").join(side("a").hint("merge"), [*part, "upa"]).where(_apart("a", "b") <= F.col("reach"))
            both = half.select(*part, "a", F.col("b.box").alias("upb"), "reach").join(side("b").hint("merge"), [*part, "upb"]).where(_apart("a", "b") <= F.col("reach"))
        if k:
            near = Window.partitionBy(*part, "a.box").orderBy("across", "b.box")
            both = both.withColumn("across", _across("a", "b")).withColumn("upto", F.sum("b.n").over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            reach = F.min(F.when(F.col("upto") > k, F.col("across"))).over(Window.partitionBy(*part, "a.box"))
            both = both.withColumn("reach", F.coalesce(reach, F.lit(float("inf")))).withColumn("core", F.col("upto") - F.col("b.n") <= k)
        else:
            both = both.withColumn("reach", F.col("a.r2")).withColumn("core", F.lit(True))
        pairs = both.where(_apart("a", "b") <= F.col("reach")).select(*part, "a", "b", "reach", "core")
        pairs = materialize(pairs) if depth else pairs
    return pairs


def _searched(points: DataFrame, part: list[str], k: int, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Points ``(part..., k, AXES, box)`` in boxes of about a sixth of ``k``, and the boxes that meet (None where parts are one box each).

    Parts of fewer than eight times ``k`` points are one box: all their pairs are fewer than the rest would be.
    """
    some = points.where(finite(*[F.col(c) for c in AXES])).select(*part, F.col(key).alias("k"), *AXES)
    size = F.col("size")
    cuts = F.when(size < max(WHOLE, 8 * (k + 1)), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.cbrt(size / max(4, k // 6))))).cast("int")
    largest = some.groupBy(*part).count().agg(F.max("count")).first()[0]
    if (largest or 0) < max(WHOLE, 8 * (k + 1)):
        return some.withColumn("box", F.lit(0).cast("long")), None
    placed = _slabs(some, part, cuts)
    return placed, meeting_boxes(placed, part, k)


def _owned(placed: DataFrame, part: list[str], name: str) -> DataFrame:
    return placed.select(*part, F.col("box").alias("box" + name), F.struct("k", *AXES).alias(name))


def _in_core(placed: DataFrame, boxes: DataFrame | None, part: list[str]) -> DataFrame:
    """All pairs of a point and another of its box's core boxes."""
    a, b = _owned(placed, part, "a"), _owned(placed, part, "b")
    if boxes is None:
        pairs = a.join(b, part)
    else:
        core = boxes.where("core").select(*part, F.col("a.box").alias("boxa"), F.col("b.box").alias("boxb"))
        pairs = core.join(a.hint("merge"), [*part, "boxa"]).join(b.hint("merge"), [*part, "boxb"])
    return pairs.where(F.col("a.k") != F.col("b.k")).withColumn("d2", squared_distance()).select(*part, "a", "b", "d2", "boxa")


def _beyond(placed: DataFrame, boxes: DataFrame, part: list[str], first: DataFrame, k: int) -> DataFrame:
    """Pairs of a point and those of other boxes within the distance of the ``k``-th of its ``first`` neighbours."""
    reach = first.groupBy(*part, "boxa", "a").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("reach"))
    seeking = _owned(placed, part, "a").join(reach, [*part, "boxa", "a"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    widest = seeking.groupBy(*part, "boxa").agg(F.max("reach").alias("widest"))
    rest = boxes.where("NOT core").select(*part, F.col("a.box").alias("boxa"), "a", "b").join(widest, [*part, "boxa"]).where(_apart("a", "b") <= F.col("widest"))
    rest = rest.select(*part, "boxa", F.col("b.box").alias("boxb"), *[F.col("b." + c) for c in (*LOW, *HIGH)])
    touched = rest.join(seeking.hint("merge"), [*part, "boxa"]).where(_gap("a") <= F.col("reach")).select(*part, "boxb", "a", "reach")
    return touched.join(_owned(placed, part, "b").hint("merge"), [*part, "boxb"]).where(F.col("a.k") != F.col("b.k")).withColumn("d2", squared_distance()).select(*part, "a", "b", "d2", "reach")


def compared(points: DataFrame, part: list[str], k: int, key: str = "query") -> tuple[DataFrame, DataFrame]:
    """The two tables of pairs whose distances :func:`nearest` takes, for judging how many these are."""
    placed, boxes = _searched(points, part, k, key)
    first = _in_core(placed, boxes, part)
    return first, first.limit(0) if boxes is None else _beyond(placed, boxes, part, _best(first, part, k), k)


def _best(pairs: DataFrame, part: list[str], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*part, "a.k").orderBy("d2", "b.k"))).where(F.col("rank") <= k)


def _near_in_part(xyz: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the ``k`` nearest other points of each point of a small part, ties by place."""
    n, k = len(xyz), min(k, len(xyz) - 1)
    if k <= 0:
        return np.zeros((n, 0), np.int64), np.zeros((n, 0))
    at, near, step = np.empty((n, k), np.int64), np.empty((n, k)), max(1, PAIRS_AT_ONCE // n)
    for begin in range(0, n, step):
        own = xyz[begin : begin + step]
        d2 = sum((own[:, None, i] - xyz[None, :, i]) ** 2 for i in range(len(AXES)))
        d2[np.arange(len(own)), np.arange(begin, begin + len(own))] = np.nan  # sorted last
        row, place = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])  # those at the k-th distance all
        gap = d2[row, place]
        order = np.lexsort((place, gap, row))
        first = np.searchsorted(row, np.arange(len(own)))[:, None] + np.arange(k)
        at[begin : begin + step], near[begin : begin + step] = place[order][first], gap[order][first]
    return at, near


def _rank_parts(part: list[str], k: int):
    """The neighbours in the parts of a task's rows, which come sorted by ``part`` and key; only one part is held over."""

    def ranked(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        xyz = np.stack([rows.column(c).to_numpy() for c in AXES], axis=1)
        a, b, d2, rank = [], [], [], []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at, gap = _near_in_part(xyz[begin:end], k)
            a.append(np.repeat(np.arange(begin, end), at.shape[1]))
            b.append(at.ravel() + begin)
            d2.append(gap.ravel())
            rank.append(np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), end - begin))
        own, other = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
        taken = [rows.column(c).take(own) for c in (*part, "k")] + [rows.column("k").take(other)]
        arrays = [c.combine_chunks() for c in taken] + [pa.array(np.concatenate(d2)), pa.array(np.concatenate(rank))]
        return pa.RecordBatch.from_arrays(arrays, names=[*part, "a", "b", "d2", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            new = np.zeros(max(0, len(rows) - 1), bool)
            for c in part:
                column = rows.column(c)
                new |= pc.not_equal(column.slice(1), column.slice(0, max(0, len(rows) - 1))).to_numpy()
            cuts = np.append(0, np.flatnonzero(new) + 1)
            held = rows.slice(cuts[-1]).to_batches()
            if len(cuts) > 1:
                yield ranked(rows, cuts)
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield ranked(rows, np.array([0, len(rows)]))

    return run


def _nearest_in_parts(points: DataFrame, part: list[str], k: int, rows: int) -> DataFrame:
    """:func:`nearest` for parts of few points, which arrays compare: nothing but the points is shuffled, and no row is made per pair.

    Tasks are counted by ``rows``: points are few bytes and much work, and by bytes would be put into too few tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"{p} {kinds[p]}" for p in part), f"a {kinds['k']}", f"b {kinds['k']}", "d2 double", "rank int"])
    dealt = points.select(*part, "k", *AXES).repartition(-(-rows // TASK_POINTS) or 1, *part).sortWithinPartitions(*part, "k")
    return dealt.mapInArrow(_rank_parts(part, k), schema)


def nearest(points: DataFrame, part: list[str], k: int, key: str = "query") -> DataFrame:
    """``(part..., a, b, d2, rank)``: the ``k`` nearest other points of each point, ties by ``key``.

    Points of a part of fewer than ``IN_ARRAYS`` points, or eight times ``k``, are compared with each other in arrays.
    Others are compared with those of the nearest boxes that must hold ``k`` others, and then only with boxes
    within the distance of the k-th of these. Non-finite points have no neighbours.
    """
    some = points.where(finite(*[F.col(c) for c in AXES])).select(*part, F.col(key).alias("k"), *AXES).dropna(subset=[*part, "k"])
    some, bound = materialize(some), max(IN_ARRAYS, 8 * (k + 1))
    sizes = some.groupBy(*part).count()
    least, largest, rows = sizes.agg(F.min("count"), F.max("count"), F.sum("count")).first()
    if (largest or 0) < bound:
        return _nearest_in_parts(some, part, k, rows or 0)
    if least >= bound:
        return _nearest_by_boxes(some, part, k)
    large = materialize(sizes.where(F.col("count") >= bound).select(*part))
    by_boxes = _nearest_by_boxes(join_sized(some, large, part, "left_semi"), part, k)
    return by_boxes.unionByName(_nearest_in_parts(join_sized(some, large, part, "left_anti"), part, k, rows))


def _nearest_by_boxes(points: DataFrame, part: list[str], k: int) -> DataFrame:
    placed, boxes = _searched(points, part, k, "k")
    first = materialize(_best(_in_core(placed, boxes, part), part, k))
    beyond = _beyond(placed, boxes, part, first, k)
    inside = first.select(*part, "a", "b", "d2").unionByName(beyond.where(F.col("d2") <= F.col("reach")).select(*part, "a", "b", "d2"))
    return _best(inside, part, k).select(*part, F.col("a.k").alias("a"), F.col("b.k").alias("b"), "d2", "rank")


def touched_boxes(items: DataFrame, part: list[str], key: str, radius: str, leaf: int = 16) -> tuple[DataFrame, DataFrame]:
    """Items in boxes of about ``leaf``, and ``(part..., box, a, reach)``: each box that an item's radius touches."""
    xyz, reach = [F.col(c) for c in AXES], F.col(radius)
    some = items.where(finite(*xyz, reach)).select(*part, F.col(key).alias("k"), *AXES, F.when(reach >= 0, reach * reach).otherwise(F.lit(-1.0)).alias("r2"))
    placed = _slabs(some, part, F.greatest(F.lit(1), F.floor(F.cbrt(F.col("size") / leaf))).cast("int"))
    boxes = meeting_boxes(placed, part)
    boxes = boxes.select(*part, F.col("a.box").alias("boxa"), F.col("b.box").alias("box"), *[F.col("b." + c) for c in (*LOW, *HIGH)])
    seeking = placed.select(*part, F.col("box").alias("boxa"), F.struct("k", *AXES).alias("a"), F.col("r2").alias("reach"))
    return placed, boxes.join(seeking.hint("merge"), [*part, "boxa"]).where(_gap("a") <= F.col("reach")).select(*part, "box", "a", "reach")


def radius_pairs(items: DataFrame, part: list[str], key: str, radius: str) -> DataFrame:
    """``(part..., a, b, d2)`` with ``a < b`` no farther apart than the radius of ``a``; only boxes in reach are searched.

    Non-finite items and radii pair with nothing, nor do negative radii.
    """
    placed, touched = touched_boxes(items, part, key, radius)
    pairs = touched.join(placed.select(*part, "box", F.struct("k", *AXES).alias("b")).hint("merge"), [*part, "box"]).where(F.col("a.k") < F.col("b.k")).withColumn("d2", squared_distance())
    return pairs.where(F.col("d2") <= F.col("reach")).select(*part, F.col("a.k").alias("a"), F.col("b.k").alias("b"), "d2")


def nearest_centroid(items: DataFrame, part: list[str], key: str) -> DataFrame:
    """``(part..., a, b, d2)``: the nearest other item of each, the lowest key on ties; non-finite ones never win."""
    return nearest(items, part, 1, key).select(*part, "a", "b", "d2")
