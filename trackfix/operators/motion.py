"""Per-point and per-group motion: positions, velocities, direction descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.config import RectifyConfig
from trackfix.functions.scalars import SEQ, above, clip, finite, nan_median, norm3

XYZ = ("x", "y", "z")
#: Rows of points whose medians one task takes.
TASK_ROWS = 100_000


def median_positions(points: DataFrame) -> DataFrame:
    """Per query the median visible position per axis, else the position at the first frame.

    Medians hold a task's rows until all are there, so rows are dealt out by point first, to tasks counted by rows:
    Spark would count them by the size of files, which for regular motions is a small part of what the rows hold.
    """
    seen = lambda n: F.when(F.col("visible"), F.col(n))
    dealt = points.select(SEQ, "query", "frame", "visible", *XYZ).repartition(-(-points.count() // TASK_ROWS) or 1, SEQ, "query")
    return dealt.groupBy(SEQ, "query").agg(*[F.coalesce(nan_median(seen(n)), F.min_by(n, "frame")).alias("p" + n) for n in XYZ])


def world_fixed_points(points: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """``(seq_id, query, n_visible, spread)`` of points that stand still: enough visible frames, small spread."""
    spread = F.sqrt(sum((F.var_pop(n) for n in XYZ), F.lit(0.0)))
    still = points.where("visible").groupBy(SEQ, "query").agg(F.count(F.lit(1)).alias("n_visible"), spread.alias("spread"))
    return still.where((F.col("n_visible") >= cfg.min_visible_frames) & finite(F.col("spread")) & (F.col("spread") < cfg.world_fixed_std_threshold))


def velocities(points: DataFrame) -> DataFrame:
    """Steps ``(seq_id, query, frame, dx, dy, dz)`` between consecutive frames that are both visible."""
    w = Window.partitionBy(SEQ, "query").orderBy("frame")
    nxt = points.select(SEQ, "query", "frame", "visible", *XYZ, F.lead(F.struct("frame", "visible", *XYZ)).over(w).alias("n"))
    both = nxt.where(F.col("visible") & F.col("n.visible") & (F.col("n.frame") == F.col("frame") + 1))
    return both.select(SEQ, "query", "frame", *[(F.col(f"n.{c}") - F.col(c)).alias("d" + c) for c in XYZ])


def _resampled(steps: DataFrame, keys: list[str], cfg: RectifyConfig) -> DataFrame:
    """Unit directions of moving steps at evenly spaced ranks, packed by frame; too few moving steps: no row."""
    d = [F.col("d" + c) for c in XYZ]
    moving = steps.withColumn("n", norm3(*d)).where(above(F.col("n"), cfg.motion_threshold))
    unit = F.struct("frame", *[(F.col("d" + c) / F.col("n")).alias("d" + c) for c in XYZ])
    packed = moving.groupBy(*keys).agg(F.array_sort(F.collect_list(unit)).alias("desc")).where(F.size("desc") >= cfg.min_co_visible_frames)
    k, n = cfg.descriptor_dirs, F.size("desc")
    if k <= 0:
        return packed
    if k == 1:
        picked = F.slice("desc", 1, 1)
    else:
        picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("desc", F.floor(i * (F.size("desc") - 1) / (k - 1)).cast("int")))
    return packed.withColumn("desc", F.when(n > k, picked).otherwise(F.col("desc")))


def direction_descriptors(points: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """``(seq_id, query, desc)``: a point's unit directions at up to ``descriptor_dirs`` frames."""
    steps = velocities(points)
    enough = F.count(F.lit(1)).over(Window.partitionBy(SEQ, "query")) >= cfg.min_co_visible_frames
    return _resampled(steps.withColumn("enough", enough).where("enough"), [SEQ, "query"], cfg)


def group_descriptors(points: DataFrame, groups: DataFrame, cfg: RectifyConfig, least_members: int = 2) -> DataFrame:
    """``(seq_id, group_id, desc)`` from the medians of the members that are visible at both frames of a step."""
    w = Window.partitionBy(SEQ, "query").orderBy("frame")
    nxt = points.select(SEQ, "query", "frame", "visible", *XYZ, F.lead(F.struct("frame", "visible", *XYZ)).over(w).alias("n"))
    both = nxt.where(F.col("visible") & F.col("n.visible") & (F.col("n.frame") == F.col("frame") + 1))
    members = both.join(groups.select(SEQ, "query", "group_id").hint("merge"), [SEQ, "query"])
    steps = members.groupBy(SEQ, "group_id", "frame").agg(
        F.count(F.lit(1)).alias("members"), *[(nan_median(F.col(f"n.{c}")) - nan_median(F.col(c))).alias("d" + c) for c in XYZ]
    )
    return _resampled(steps.where(F.col("members") >= least_members), [SEQ, "group_id"], cfg)


def direction_similarity(a: Column, b: Column, least: int) -> Column:
    """Mean dot product of two descriptors over their common frames; null with fewer than ``least``."""
    dot = lambda p, q: p["dx"] * q["dx"] + p["dy"] * q["dy"] + p["dz"] * q["dz"]
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    more = lambda t, p, q: F.struct((t["total"] + dot(p, q)).alias("total"), (t["n"] + 1).alias("n"))
    common = lambda t, p: F.aggregate(b, t, lambda u, q: F.when(q["frame"] == p["frame"], more(u, p, q)).otherwise(u))
    mean = lambda t: F.when(t["n"] >= F.greatest(F.lit(least), F.lit(1)), clip(t["total"] / t["n"], -1.0, 1.0))
    return F.aggregate(a, none, common, mean)


def group_motion(points: DataFrame, observations: DataFrame, groups: DataFrame) -> DataFrame:
    """``(seq_id, group_id, group_type, size, motion)``: distinct observable members, mean observable step length.

    A cell is observable when visible and observed; a step needs both of its frames.
    """
    cells = points.where("visible").join(observations.select(SEQ, "frame", "query").distinct().hint("merge"), [SEQ, "frame", "query"])
    w = Window.partitionBy(SEQ, "query").orderBy("frame")
    nxt = cells.select(SEQ, "query", "frame", *XYZ, F.lead(F.struct("frame", *XYZ)).over(w).alias("n"))
    length = F.when(F.col("n.frame") == F.col("frame") + 1, norm3(*[F.col(f"n.{c}") - F.col(c) for c in XYZ]))
    per_query = nxt.groupBy(SEQ, "query").agg(F.sum(length).alias("total"), F.count(length).alias("steps"))
    zero = F.lit(0.0)
    return groups.join(per_query.hint("merge"), [SEQ, "query"], "left").groupBy(SEQ, "group_id", "group_type").agg(
        F.count("steps").alias("size"), F.coalesce(F.try_divide(F.sum("total"), F.sum("steps")), zero).alias("motion")
    )
