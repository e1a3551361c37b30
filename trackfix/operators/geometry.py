"""Camera rays and parallax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.functions.scalars import SEQ, above, clip, norm3
from trackfix.operators.medians import exact_medians, largest_group
from trackfix.session import materialize


def rays(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Unit rays ``(seq_id, query, frame, rx, ry, rz)`` from the camera to visible points; rays of no length drop out."""
    d = [F.col(p) - F.col(c) for p, c in (("x", "cx"), ("y", "cy"), ("z", "cz"))]
    n = norm3(*d)
    both = points.where("visible").join(cameras, [SEQ, "frame"]).withColumn("n", n).where(above(F.col("n"), 1e-9))
    return both.select(SEQ, "query", "frame", *[(c / F.col("n")).alias(a) for c, a in zip(d, ("rx", "ry", "rz"), strict=True)])


#: What rounding may take off a bound of dot products.
SLACK = 1e-12
#: Rays of a query of which all pairs are compared: with so few, cells cost more than they leave out.
FEW_RAYS = 64
RAY = ("rx", "ry", "rz")


def _dot(a: Column, b: Column) -> Column:
    return a["rx"] * b["rx"] + a["ry"] * b["ry"] + a["rz"] * b["rz"]


def ray_cells(directions: DataFrame) -> DataFrame:
    """``(seq_id, query, cells)``: a query's rays by grid cell of direction, each cell with its bounds, a ray of it and all.

    The grid spans the query's own rays, with more cells the more there are.
    """
    own, ray = Window.partitionBy(SEQ, "query"), F.struct(*RAY)
    spread = F.greatest(*[F.max(c).over(own) - F.min(c).over(own) for c in RAY])
    side = F.greatest(spread, F.lit(SLACK)) / F.ceil(0.75 * F.cbrt(F.count(F.lit(1)).over(own)))
    celled = directions.withColumn("side", side).withColumns({"from_" + c: F.min(c).over(own) for c in RAY})
    cell = F.struct(*[F.floor((F.col(c) - F.col("from_" + c)) / F.col("side")).alias(c) for c in RAY])
    bounds = [f(c).alias(name + c) for c in RAY for f, name in ((F.min, "lo"), (F.max, "hi"))]
    by_cell = celled.groupBy(SEQ, "query", cell.alias("cell")).agg(*bounds, F.min(ray).alias("one"), F.collect_list(ray).alias("rays"))
    return by_cell.groupBy(SEQ, "query").agg(F.sort_array(F.collect_list(F.struct("cell", *[n + c for c in RAY for n in ("lo", "hi")], "one", "rays"))).alias("cells"))


def wide_pairs(cells: Column) -> Column:
    """Pairs ``(a, b)`` of cells that may hold the two rays farthest apart.

    No two rays of a pair of cells have a dot product below the sum of the least products of their bounds; a pair
    whose bound is over the least product of single rays of any two cells is out.
    """
    known = F.array_min(F.transform(cells, lambda a: F.array_min(F.transform(cells, lambda b: _dot(a["one"], b["one"])))))

    def bound(a: Column, b: Column) -> Column:
        ends = lambda c: F.least(*[a[m + c] * b[n + c] for m in ("lo", "hi") for n in ("lo", "hi")])
        return sum((ends(c) for c in RAY), F.lit(-SLACK))

    ahead = lambda a, least: F.filter(cells, lambda b: (b["cell"] >= a["cell"]) & (bound(a, b) <= least))
    pairs = lambda least: F.flatten(F.transform(cells, lambda a: F.transform(ahead(a, least), lambda b: F.struct(a["rays"].alias("a"), b["rays"].alias("b")))))
    return F.get(F.transform(F.array(known), pairs), F.lit(0))  # a variable, so that it is worked out once


def query_parallax(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Largest angle between two rays of a query point, 0 with fewer than two, as ``(seq_id, query, parallax)``.

    Of up to ``FEW_RAYS`` rays all pairs are compared, of more only those of cells that may be farthest apart, in packed
    arrays; nothing is joined with itself, and the angle is taken once, being monotone in the dot product.
    """
    directions = rays(points, cameras).groupBy(SEQ, "query").agg(F.collect_list(F.struct(*RAY)).alias("rays"))
    directions = materialize(directions.withColumn("n", F.size("rays")))
    one = directions.where(F.col("n") <= FEW_RAYS).select(SEQ, "query", "n", "rays", F.posexplode("rays").alias("i", "a"))
    two = one.select(SEQ, "query", "n", "a", F.explode(F.slice("rays", F.col("i") + 1, F.col("n"))).alias("b"))
    least = two.groupBy(SEQ, "query").agg(F.max("n").alias("n"), F.min(_dot(F.col("a"), F.col("b"))).alias("least"))
    many = directions.where(F.col("n") > FEW_RAYS)
    if not many.isEmpty():
        least = least.unionByName(_least_of_cells(ray_cells(many.select(SEQ, "query", F.inline("rays")))))
    angle = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.acos(clip(F.col("least"), -1.0, 1.0)))
    everyone = points.select(SEQ, "query").distinct()
    return everyone.join(least.select(SEQ, "query", angle.alias("parallax")), [SEQ, "query"], "left").select(SEQ, "query", F.coalesce("parallax", F.lit(0.0)).alias("parallax"))


def _least_of_cells(cells: DataFrame) -> DataFrame:
    """``(seq_id, query, n, least)``: number of rays and least dot product of two of them, from their ``cells``."""
    packed = cells.withColumn("pairs", wide_pairs(F.col("cells")))
    least = F.array_min(F.transform("pairs", lambda p: F.array_min(F.transform(p["a"], lambda a: F.array_min(F.transform(p["b"], lambda b: _dot(a, b)))))))
    n = F.aggregate("cells", F.lit(0), lambda s, c: s + F.size(c["rays"]))
    return packed.select(SEQ, "query", n.alias("n"), least.alias("least"))


def group_parallax(groups: DataFrame, parallax: DataFrame) -> DataFrame:
    """Median parallax of each group's members."""
    return exact_medians(groups.join(parallax.hint("merge"), [SEQ, "query"]), [SEQ, "group_id", "group_type"], ["parallax"], largest=largest_group(groups, [SEQ, "group_id"]))
