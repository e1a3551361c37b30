"""The whole pipeline over many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.config import RectifyConfig
from trackfix.functions.scalars import SEQ
from trackfix.operators.budget import allocate_budget
from trackfix.operators.correct import apply_corrections, choose_forms
from trackfix.operators.geometry import group_parallax, query_parallax
from trackfix.operators.grouping import motion_groups
from trackfix.operators.metrics import changed_groups
from trackfix.operators.motion import group_motion
from trackfix.operators.sampling import candidate_cells, sample_anchors, sample_anchors_numpy
from trackfix.operators.validate import validate_groups, validate_inputs
from trackfix.session import at_once, materialize


@dataclass(frozen=True)
class Result:
    """Corrected points, and everything that led to them."""

    corrected: DataFrame
    groups: DataFrame
    budget: DataFrame
    anchors: DataFrame
    forms: DataFrame
    diagnostics: DataFrame


def rectify(
    points: DataFrame,
    observations: DataFrame,
    cameras: DataFrame,
    cfg: RectifyConfig | None = None,
    seed: int = 0,
    groups: DataFrame | None = None,
    anchors: DataFrame | None = None,
    sampler: str = "hash",
    validate: bool = True,
) -> Result:
    """Validates, groups, allocates and samples anchors, corrects.

    ``groups`` and ``anchors`` replace the library's own; ``sampler`` is ``hash`` or ``numpy``. Sequences are
    independent and processed together.
    """
    cfg = cfg or RectifyConfig()
    points, observations, cameras = at_once(*[lambda t=t: materialize(t) for t in (points, observations, cameras)])
    if validate:
        validate_inputs(points, observations, cameras, cfg)
    supplied = groups
    groups, per_query = at_once(
        lambda: motion_groups(points, cfg) if supplied is None else materialize(validate_groups(supplied, points)),
        lambda: materialize(query_parallax(points, cameras)),
    )
    n_queries = points.groupBy(SEQ).agg(F.countDistinct("query").alias("n_queries"))
    sizes = groups.groupBy(SEQ, "group_id").agg(F.count(F.lit(1)).alias("members"))
    able = ~((F.col("form") == "scale_about_anchor") & (F.col("members") < 2))
    stats, forms = at_once(
        lambda: materialize(group_motion(points, observations, groups)),
        lambda: materialize(choose_forms(group_parallax(groups, per_query), cfg).join(sizes.hint("merge"), [SEQ, "group_id"]).where(able)),
    )
    budget = allocate_budget(stats, n_queries, cfg)
    if anchors is None:
        able = budget.join(forms.select(SEQ, "group_id").hint("merge"), [SEQ, "group_id"], "left_semi")
        cells = candidate_cells(points, observations, groups, able)
        anchors = {"hash": sample_anchors, "numpy": sample_anchors_numpy}[sampler](materialize(cells), seed)
    anchors = materialize(anchors)
    corrected = materialize(apply_corrections(points, observations, cameras, groups, anchors, forms, cfg))
    solved = changed_groups(points, corrected, groups.where("group_type <> 'independent_dynamic'"))
    zero = F.lit(0).cast("long")
    totals = groups.where("group_type <> 'independent_dynamic'").groupBy(SEQ).agg(F.countDistinct("group_id").alias("n_groups_total"))
    diagnostics = (
        points.select(SEQ).distinct()
        .join(totals, SEQ, "left")
        .join(solved.groupBy(SEQ).agg(F.count(F.lit(1)).alias("n_groups_solved")), SEQ, "left")
        .join(anchors.groupBy(SEQ).agg(F.count(F.lit(1)).alias("n_anchors_used")), SEQ, "left")
        .select(SEQ, *[F.coalesce(c, zero).alias(c) for c in ("n_groups_total", "n_groups_solved", "n_anchors_used")])
    )
    return Result(corrected, groups, budget, anchors, forms, diagnostics)
