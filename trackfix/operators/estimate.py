"""Per-group estimators over anchors: scales, translations, similarity fits, smoothing of scale series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.functions.scalars import SEQ, above, finite, nan_median, norm3
from trackfix.operators.medians import grouped_medians, largest_group

GROUP = [SEQ, "group_id"]
AXES = ("x", "y", "z")
MIN_RATIO, MIN_SCALE, MIN_SPREAD = 1e-3, 1e-8, 1e-12


def anchor_points(anchors: DataFrame, points: DataFrame, observations: DataFrame) -> DataFrame:
    """Anchors with their predicted (x, y, z) and observed (gx, gy, gz) positions, ``ord`` kept."""
    keys = [SEQ, "frame", "query"]
    return anchors.join(points.select(*keys, *AXES), keys).join(observations.hint("merge"), keys, "left")


def ratio(pred: list[Column], true: list[Column]) -> Column:
    """``|true| / |pred|`` where both norms are finite, the first positive and the second not tiny; else null."""
    n_pred, n_true = norm3(*pred), norm3(*true)
    return F.when(finite(n_pred, n_true) & above(n_pred, MIN_RATIO) & (n_true > 0), n_true / n_pred)


def _offsets(of: tuple[str, ...], origin: tuple[str, ...]) -> list[Column]:
    return [F.col(a) - F.col(b) for a, b in zip(of, origin, strict=True)]


def median_scale(r: Column) -> Column:
    """Median ratio of a group, null unless every ratio is finite and the median is positive."""
    return usable_scale(F.median(r), F.bool_and(all_finite(r)))


def all_finite(r: Column) -> Column:
    """A ratio is finite, or null and so doesn't count."""
    return finite(F.coalesce(r, F.lit(1.0)))


def usable_scale(median: Column, ok: Column) -> Column:
    return F.when(ok & finite(median) & (median > MIN_SCALE), median)


def camera_ratio() -> Column:
    """An anchor's ratio of distances from the camera (c0) of its group's first anchor."""
    centre = ("c0x", "c0y", "c0z")
    return ratio(_offsets(AXES, centre), _offsets(("gx", "gy", "gz"), centre))


def anchor_ratio() -> Column:
    """An anchor's ratio of distances from its group's first anchor, null for that one."""
    return F.when(F.col("ord") != 0, ratio(_offsets(AXES, ("a0x", "a0y", "a0z")), _offsets(("gx", "gy", "gz"), ("t0x", "t0y", "t0z"))))


def camera_scale(anchored: DataFrame, cameras: DataFrame) -> DataFrame:
    """``(seq_id, group_id, c0x, c0y, c0z, alpha)``: scale about the camera of the first anchor's frame; alpha may be null."""
    first = anchored.where("ord = 0").select(*GROUP, "frame").join(cameras, [SEQ, "frame"]).select(*GROUP, *[F.col("c" + a).alias("c0" + a) for a in AXES])
    keys = [*GROUP, *["c0" + a for a in AXES]]
    rows = anchored.join(first, GROUP).select(*keys, camera_ratio().alias("alpha"))
    judged = grouped_medians(rows, keys, ["alpha"], [F.bool_and(all_finite(F.col("alpha"))).alias("ok")], largest=largest_group(anchored, GROUP))
    return judged.select(*keys, usable_scale(F.col("alpha"), F.col("ok")).alias("alpha"))


def per_frame_scale(anchored: DataFrame, points: DataFrame, observations: DataFrame, cameras: DataFrame, least: int = 1) -> DataFrame:
    """``(seq_id, group_id, frame, alpha)``: scale of each frame from every observable cell of an anchor query.

    Frames with fewer than ``least`` such cells, before or after the ratio's conditions, have no row.
    """
    keys = [SEQ, "frame", "query"]
    queries = anchored.select(*GROUP, "query").distinct()
    cells = points.where("visible").select(*keys, *AXES).join(queries, [SEQ, "query"]).join(observations.hint("merge"), keys).join(cameras, [SEQ, "frame"])
    centre = ("cx", "cy", "cz")
    r = ratio(_offsets(AXES, centre), _offsets(("gx", "gy", "gz"), centre))
    out = cells.withColumn("r", r).groupBy(*GROUP, "frame").agg(F.count(F.lit(1)).alias("cells"), F.count("r").alias("n"), median_scale(F.col("r")).alias("alpha"))
    return out.where((F.col("cells") >= least) & (F.col("n") >= least) & F.col("alpha").isNotNull()).select(*GROUP, "frame", "alpha")


def interpolated_scale(alphas: DataFrame, frames: DataFrame) -> DataFrame:
    """``(seq_id, group_id, frame, alpha, filled)`` for every frame of ``(seq_id, frame)``: linear between known
    frames, held at the ends; groups without a known frame have no row."""
    groups = alphas.select(*GROUP).distinct()
    grid = groups.join(frames.select(SEQ, "frame").distinct(), SEQ).join(alphas, [*GROUP, "frame"], "left")
    w = Window.partitionBy(*GROUP).orderBy("frame")
    known = F.when(F.col("alpha").isNotNull(), F.struct("frame", "alpha"))
    back, ahead = F.last(known, True).over(w), F.first(known, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = grid.withColumns({"p": back, "q": ahead})
    span = F.col("q.frame") - F.col("p.frame")
    line = F.col("p.alpha") + (F.col("frame") - F.col("p.frame")) * F.try_divide(F.col("q.alpha") - F.col("p.alpha"), span)
    filled = F.coalesce("alpha", line, F.col("p.alpha"), F.col("q.alpha"))
    return both.select(*GROUP, "frame", "alpha", filled.alias("filled"))


def smoothed_scale(alphas: DataFrame, frames: DataFrame, sigma: float = 2.0) -> DataFrame:
    """``(seq_id, group_id, frame, alpha)``: Gaussian-smoothed scale at the frames that had one.

    The series is filled for the convolution only, and reflected at its ends. ``sigma <= 0`` changes nothing.
    """
    if sigma <= 0:
        return alphas.select(*GROUP, "frame", "alpha")
    radius = max(1, int(4 * sigma + 0.5))
    kernel = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    kernel = [v / sum(kernel) for v in kernel]
    packed = interpolated_scale(alphas, frames).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("frame", "alpha", "filled"))).alias("s"))
    n = F.size("s")
    period = F.greatest(F.lit(1), 2 * (n - 1))

    def at(i: Column) -> Column:
        m = F.pmod(i, period)
        return F.col("s")[F.when(m <= n - 1, m).otherwise(period - m)]["filled"]

    weights = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w")) for j, w in zip(range(-radius, radius + 1), kernel, strict=True)])
    smooth = F.transform("s", lambda v, t: F.struct(v["frame"].alias("frame"), v["alpha"].alias("known"), F.aggregate(weights, F.lit(0.0), lambda a, o: a + o["w"] * at(t + o["j"])).alias("alpha")))
    return packed.select(*GROUP, F.explode(smooth).alias("v")).where("v.known IS NOT NULL").select(*GROUP, "v.frame", "v.alpha")


def anchor_scale(anchored: DataFrame) -> DataFrame:
    """``(seq_id, group_id, a0x.., t0x.., s)``: scale about the first anchor (predicted a0, observed t0); s may be null."""
    return anchored.join(first_anchors(anchored), GROUP).groupBy(*GROUP, *FIRST).agg(median_scale(anchor_ratio()).alias("s"))


def group_translation(anchored: DataFrame) -> DataFrame:
    """``(seq_id, group_id, dx, dy, dz)``: median residual per axis; null where any residual isn't finite."""
    rows = anchored.select(*GROUP, *[(F.col("g" + a) - F.col(a)).alias("d" + a) for a in AXES])
    names = ["d" + a for a in AXES]
    judged = grouped_medians(rows, GROUP, names, [F.bool_and(finite(*[F.col(n) for n in names])).alias("ok")], largest=largest_group(anchored, GROUP))
    return judged.select(*GROUP, *[F.when(F.col("ok"), F.col(n)).alias(n) for n in names])


def anchor_moments(about_first: list[tuple[Column, Column]]) -> list[Column]:
    """Sums over a group's pairs of predicted and observed offsets from its first anchor, which are all that a similarity fit needs."""
    pred, true = zip(*about_first, strict=True)
    ok = F.bool_and(finite(*pred, *true)).alias("m_ok")
    means = [F.avg(c).alias(f"m_{name}{i}") for name, cs in (("p", pred), ("q", true)) for i, c in enumerate(cs)]
    products = [F.avg(q * p).alias(f"m_qp{i}{j}") for i, q in enumerate(true) for j, p in enumerate(pred)]
    return [F.count(F.lit(1)).alias("m_n"), ok, F.avg(sum((p * p for p in pred), F.lit(0.0))).alias("m_pp"), *means, *products]


def similarities(count: np.ndarray, mean_pred: np.ndarray, mean_true: np.ndarray, power: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares ``(fits, scale, rotation, translation)`` of many groups from their moments.

    A group fits with three points or more that spread and a positive scale. A best map that mirrors is made a
    rotation; its scale stays the plain sum of singular values over the spread.
    """
    spread = power - (mean_pred**2).sum(axis=1)
    fits = (count >= 3) & (spread >= MIN_SPREAD)
    cross = np.where(fits[:, None, None], products - mean_true[:, :, None] * mean_pred[:, None, :], 0.0)
    left, stretch, right = np.linalg.svd(cross)
    left[np.linalg.det(left) * np.linalg.det(right) < 0, :, 2] *= -1
    rotation = left @ right
    scale = stretch.sum(axis=1) / np.where(fits, spread, 1.0)
    fits &= np.isfinite(scale) & (scale > MIN_SCALE)
    return fits, scale, rotation, mean_true - scale[:, None] * np.einsum("gij,gj->gi", rotation, mean_pred)


def fit_similarity(src: np.ndarray, dst: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Scale, rotation and translation of one set of points; None where there is no fit."""
    if not len(src) or not (np.isfinite(src).all() and np.isfinite(dst).all()):
        return None
    p, q = src - src[0], dst - dst[0]
    n = np.array([len(p)])
    fits, scale, rotation, shift = similarities(n, p.mean(axis=0)[None], q.mean(axis=0)[None], (p * p).sum(axis=1).mean(keepdims=True), (q.T @ p / len(p))[None])
    return (float(scale[0]), rotation[0], shift[0] + dst[0] - scale[0] * rotation[0] @ src[0]) if fits[0] else None


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        column = lambda *names: b[list(names)].to_numpy(float)
        products = column(*[f"m_qp{i}{j}" for i in range(3) for j in range(3)]).reshape(-1, 3, 3)
        good = b["m_ok"].to_numpy(bool) & np.isfinite(products).all(axis=(1, 2))
        clean = lambda x: np.where(good.reshape(-1, *[1] * (x.ndim - 1)), x, 0.0)
        n = np.where(good, b["m_n"].to_numpy(), 0)
        fits, scale, rotation, shift = similarities(n, clean(column("m_p0", "m_p1", "m_p2")), clean(column("m_q0", "m_q1", "m_q2")), clean(b["m_pp"].to_numpy(float)), clean(products))
        shift = shift + column("t0x", "t0y", "t0z") - scale[:, None] * np.einsum("gij,gj->gi", rotation, column("a0x", "a0y", "a0z"))
        out = pd.DataFrame({SEQ: b[SEQ], "group_id": b["group_id"], "scale": scale, "r": list(rotation.reshape(-1, 9)), "tx": shift[:, 0], "ty": shift[:, 1], "tz": shift[:, 2]})
        yield out[fits]


def solve_similarities(moments: DataFrame) -> DataFrame:
    """``(seq_id, group_id, scale, r array<double> (row by row), tx, ty, tz)`` of the groups that have a fit.

    ``moments`` has one row a group: its ``anchor_moments`` and first anchor (a0, t0). Many groups are solved at once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    schema = f"{SEQ} {kinds[SEQ]}, group_id {kinds['group_id']}, scale double, r array<double>, tx double, ty double, tz double"
    return moments.mapInPandas(_solved, schema)


def first_anchors(anchored: DataFrame) -> DataFrame:
    """``(seq_id, group_id, a0x.., t0x..)``: each group's first anchor, predicted and observed."""
    return anchored.where("ord = 0").select(*GROUP, *[F.col(a).alias("a0" + a) for a in AXES], *[F.col("g" + a).alias("t0" + a) for a in AXES])


FIRST = [o + a for o in ("a0", "t0") for a in AXES]


def about_first() -> list[tuple[Column, Column]]:
    return [(F.col(a) - F.col("a0" + a), F.col("g" + a) - F.col("t0" + a)) for a in AXES]


def sim3_fit(anchored: DataFrame) -> DataFrame:
    """Similarity fits of groups: sums over the anchors in Spark, then one decomposition for many groups."""
    return solve_similarities(anchored.join(first_anchors(anchored), GROUP).groupBy(*GROUP, *FIRST).agg(*anchor_moments(about_first())))
