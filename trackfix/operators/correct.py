"""Correction forms, applied to all groups in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfix.config import FORMS, RectifyConfig
from trackfix.functions.scalars import SEQ
from trackfix.operators import estimate as est
from trackfix.session import materialize

GROUP, AXES = est.GROUP, est.AXES
CAMERA = ("scale_about_camera_per_frame_translation", "scale_about_camera_translation")
ANCHOR = ("scale_about_anchor_translation", "scale_about_anchor")


def choose_forms(parallax: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """``(seq_id, group_id, group_type, parallax, form)``: by type, and the low-parallax form below the threshold."""
    form = F.when(F.col("group_type") == "world_fixed", cfg.world_fixed_form).otherwise(F.lit(cfg.default_form))
    limit = cfg.parallax_threshold_rad()
    if limit > 0 and cfg.low_parallax_form != "none":
        form = F.when(F.col("parallax") < limit, cfg.low_parallax_form).otherwise(form)
    return parallax.withColumn("form", form)


def group_params(anchored: DataFrame, forms: DataFrame, points: DataFrame, observations: DataFrame, cameras: DataFrame, cfg: RectifyConfig) -> tuple[DataFrame, DataFrame]:
    """Parameters of each group with anchors, and the per-frame scales ``(seq_id, group_id, frame, alpha_t)``.

    ``mode`` says what applies: ``camera``, ``anchor``, ``sim3``, ``shift`` (translation alone) or ``none``;
    ``shifts`` whether a translation follows.
    """
    unknown = F.when(F.col("form").isin(*FORMS), F.col("form")).otherwise(F.raise_error(F.concat(F.lit("unsupported correction form: "), F.coalesce("form", F.lit("null")))).cast("string"))
    a = materialize(anchored.join(forms.select(*GROUP, unknown.alias("form")), GROUP))
    first = a.where("ord = 0").select(*GROUP, "frame").join(cameras, [SEQ, "frame"], "left").select(*GROUP, *[F.col("c" + x).alias("c0" + x) for x in AXES])
    about = a.join(est.first_anchors(a), GROUP).join(first, GROUP)
    alpha = F.when(F.col("form").isin(*CAMERA), est.camera_ratio())
    s = F.when(F.col("form").isin(*ANCHOR), est.anchor_ratio())
    centre = ["c0" + x for x in AXES]
    sums = about.groupBy(*GROUP, "form", *est.FIRST, *centre).agg(est.median_scale(alpha).alias("alpha"), est.median_scale(s).alias("s"), *est.anchor_moments(est.about_first()))
    fallback = F.col("form").isin(*CAMERA) & F.col("alpha").isNull() | (F.col("form") == "full_sim3")
    sums = materialize(sums.withColumn("fallback", fallback))
    p = sums.drop(*[c for c in sums.columns if c.startswith("m_")]).join(est.solve_similarities(sums.where("fallback").drop("form", "alpha", "s", *centre)), GROUP, "left")
    mode = (
        F.when(F.col("alpha").isNotNull(), "camera")
        .when(F.col("s").isNotNull(), "anchor")
        .when(F.col("scale").isNotNull(), "sim3")
        .when(F.col("fallback") | (F.col("form") == "scale_about_anchor_translation"), "shift")
        .otherwise("none")
    )
    shifts = F.col("mode").isin("camera", "shift") | ((F.col("mode") == "anchor") & (F.col("form") == "scale_about_anchor_translation"))
    params = p.withColumn("mode", mode).withColumn("shifts", shifts)
    framed = a.where(F.col("form") == CAMERA[0])
    alphas = est.per_frame_scale(framed, points, observations, cameras, cfg.per_frame_scale_min_anchors)
    series = est.smoothed_scale(alphas, cameras, cfg.per_frame_scale_smooth_sigma).withColumnRenamed("alpha", "alpha_t")
    return params, materialize(series)


def params_by_frame(params: DataFrame, series: DataFrame, cameras: DataFrame, frames: DataFrame) -> DataFrame:
    """Each group's parameters at each of ``frames`` (seq_id, frame) of its sequence, with the frame's scale and camera.

    A group has a row per frame, not per point, so that what is corrected meets all of it in one join.
    """
    own = [*(c for c in params.columns if c in ("dx", "dy", "dz")), "mode", "shifts", "form", "alpha", "c0x", "c0y", "c0z", "s", "a0x", "a0y", "a0z", "t0x", "t0y", "t0z", "scale", "r", "tx", "ty", "tz"]
    grid = params.select(*GROUP, *own).join(frames.select(SEQ, "frame").distinct(), SEQ)
    return grid.join(series.hint("merge"), [*GROUP, "frame"], "left").join(cameras.select(SEQ, "frame", "cx", "cy", "cz"), [SEQ, "frame"], "left")


def scaled(cells: DataFrame, params: DataFrame) -> DataFrame:
    """``cells`` (keys and raw x, y, z, with group_id) with mode, shifts and sx, sy, sz: positions before the translation.

    ``params`` are those by frame. Cells without a group or a group's parameters keep their positions, and have no mode.

    The camera form of per-frame scales applies the group's scale first and the frame's scale, estimated on
    raw positions as well, on top of it.
    """
    both = cells.join(params.hint("merge"), [*GROUP, "frame"], "left")
    kept = [c for c in ("dx", "dy", "dz", "mode", "shifts") if c in params.columns]
    whole = {a: F.col("c0" + a) + F.col("alpha") * (F.col(a) - F.col("c0" + a)) for a in AXES}
    frame_scale = F.coalesce(F.when(~F.isnan("alpha_t"), F.col("alpha_t")), F.col("alpha"))
    framed = {a: F.col("c" + a) + frame_scale * (c - F.col("c" + a)) for a, c in whole.items()}

    def turned(i: int) -> Column:
        return F.col("scale") * sum((F.col("r")[3 * i + j] * F.col(b) for j, b in enumerate(AXES)), F.lit(0.0)) + F.col("t" + AXES[i])

    def position(i: int, a: str) -> Column:
        camera = F.when(F.col("form") == CAMERA[0], framed[a]).otherwise(whole[a])
        anchor = F.col("t0" + a) + F.col("s") * (F.col(a) - F.col("a0" + a))
        return F.when(F.col("mode") == "camera", camera).when(F.col("mode") == "anchor", anchor).when(F.col("mode") == "sim3", turned(i)).otherwise(F.col(a))

    return both.select(*cells.columns, *kept, *[position(i, a).alias("s" + a) for i, a in enumerate(AXES)])


def apply_corrections(points: DataFrame, observations: DataFrame, cameras: DataFrame, groups: DataFrame, anchors: DataFrame, forms: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """Corrected ``points``: keys, visible, x, y, z, group_id (null where in no group) and ``moved``.

    Groups are disjoint, so all are corrected at once; points of groups without anchors or parameters keep
    their positions.
    """
    anchored = est.anchor_points(anchors, points, observations)
    params, series = group_params(anchored, forms, points, observations, cameras, cfg)
    at = scaled(anchored, params_by_frame(params, series, cameras, anchored)).where("shifts")
    moved = at.select(*GROUP, *[F.col("s" + a).alias(a) for a in AXES], "gx", "gy", "gz")
    shifted = params.join(est.group_translation(moved), GROUP, "left")
    by_frame = materialize(params_by_frame(shifted, series, cameras, points))
    new = scaled(points.join(groups.select(SEQ, "query", "group_id").hint("merge"), [SEQ, "query"], "left"), by_frame)
    place = {a: F.col("s" + a) + F.when(F.col("shifts"), F.coalesce("d" + a, F.lit(0.0))).otherwise(F.lit(0.0)) for a in AXES}
    return new.select(SEQ, "frame", "query", "visible", "group_id", *[F.coalesce(c, a).alias(a) for a, c in place.items()], F.col("mode").isNotNull().alias("moved"))


def apply_form(points: DataFrame, observations: DataFrame, cameras: DataFrame, groups: DataFrame, anchors: DataFrame, form: str, cfg: RectifyConfig | None = None) -> DataFrame:
    """One correction form for all groups that have anchors."""
    if form not in FORMS:
        raise ValueError(f"unsupported correction form: {form}")
    forms = anchors.select(*GROUP).distinct().withColumn("form", F.lit(form))
    return apply_corrections(points, observations, cameras, groups, anchors, forms, cfg or RectifyConfig())
