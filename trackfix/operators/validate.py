"""Input validation as one aggregation per sequence."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfix.config import GROUP_TYPES, RectifyConfig
from trackfix.functions.scalars import SEQ, finite


class InputWarning(UserWarning):
    """Input that can be corrected but is likely a mistake."""


def tallied(rows: DataFrame, distinct: list[str], counts: dict[str, Column]) -> DataFrame:
    """Per sequence the number of distinct values of whole-number columns (``n_<name>``), and ``counts``.

    One pass over the rows makes bitmaps for each combination of the columns' blocks of 32,768 values, which are
    few; their union counts the values, so that no row is expanded for a column.
    """
    bucket = lambda c: F.bitmap_bucket_number(F.col(c)).alias("block_" + c)
    bits = [F.bitmap_construct_agg(F.bitmap_bit_position(F.col(c))).alias("bits_" + c) for c in distinct]
    blocks = rows.groupBy(SEQ, *[bucket(c) for c in distinct]).agg(*bits, *[v.alias(n) for n, v in counts.items()])
    out = blocks.groupBy(SEQ).agg(*[F.sum(n).alias(n) for n in counts])
    for c in distinct:
        one = blocks.where(F.col("block_" + c).isNotNull()).groupBy(SEQ, "block_" + c).agg(F.bitmap_count(F.bitmap_or_agg("bits_" + c)).alias("n"))
        out = out.join(one.groupBy(SEQ).agg(F.sum("n").alias("n_" + c)), SEQ, "left")
    return out.select(SEQ, *[F.coalesce("n_" + c, F.lit(0).cast("long")).alias("n_" + c) for c in distinct], *counts)


def validation_report(points: DataFrame, observations: DataFrame, cameras: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """One row per sequence: counts, and the problems that :func:`validate_inputs` raises or warns of."""
    keys = [SEQ, "frame", "query"]
    marked = observations.select(*keys, F.lit(True).alias("m")).distinct()
    counts = {
        "n_visible": F.count_if("visible"),
        "n_valid": F.count_if("m"),
        "n_candidates": F.count_if(F.col("visible") & F.col("m")),
        "n_visible_nan": F.count_if(F.col("visible") & ~finite(F.col("x"), F.col("y"), F.col("z"))),
    }
    cells = tallied(points.join(marked.hint("merge"), keys, "left"), ["frame", "query"], counts).withColumnsRenamed({"n_frame": "n_frames", "n_query": "n_queries"})
    c = ("cx", "cy", "cz")
    first = cameras.groupBy(SEQ).agg(*[F.min_by(n, "frame").alias(n + "0") for n in c])
    zero = F.lit(True)
    still = F.lit(True)
    for n in c:
        zero = zero & (F.abs(n) <= 1e-8)
        still = still & (F.abs(F.col(n) - F.col(n + "0")) <= 1e-8 + 1e-5 * F.abs(n + "0"))
    cams = cameras.join(first, SEQ).groupBy(SEQ).agg(
        F.bool_and(finite(*[F.col(n) for n in c])).alias("centers_finite"),
        F.bool_and(zero).alias("centers_zero"),
        (F.bool_and(still) & (F.count(F.lit(1)) > 1)).alias("camera_static"),
    )
    budget = F.floor(F.lit(cfg.target_anchor_frac) * F.col("n_queries")).cast("long")
    return cells.join(cams, SEQ, "left").withColumn("budget", budget).withColumn("budget_capped", F.col("budget") > F.col("n_candidates"))


def validate_inputs(points: DataFrame, observations: DataFrame, cameras: DataFrame, cfg: RectifyConfig, warn: bool = True, strict: bool = False) -> DataFrame:
    """The report, after raising on errors and warning of the rest (``strict``: raising on these too).

    Only counts of affected sequences come to the driver.
    """
    report = validation_report(points, observations, cameras, cfg)
    frames = points.groupBy(SEQ, "frame").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query").alias("distinct"))
    grid = frames.groupBy(SEQ).agg((F.sum("n") > F.sum("distinct")).alias("repeats"), (F.min("n") < F.max("n")).alias("ragged"))
    checks = {
        "points repeat a (seq_id, frame, query)": F.col("repeats"),
        "points are no complete grid of frames and queries": F.col("ragged"),
        "camera centres must be finite": F.coalesce(~F.col("centers_finite"), F.lit(True)),
        "no observation is valid": F.col("n_valid") == 0,
    }
    hints = {
        "visible points have non-finite coordinates": F.col("n_visible_nan") > 0,
        "all camera centres are zero": F.col("centers_zero"),
        "the camera does not move": F.col("camera_static") & ~F.col("centers_zero"),
        "the anchor budget is over the visible observations": F.col("budget_capped"),
    }
    row = report.join(grid, SEQ).agg(*[F.count_if(c).alias(k) for k, c in {**checks, **hints}.items()]).first().asDict()
    for text in checks:
        if row[text]:
            raise ValueError(f"{text} ({row[text]} sequences)")
    for text in hints:
        if row[text] and strict:
            raise ValueError(f"{text} ({row[text]} sequences)")
        if row[text] and warn:
            warnings.warn(f"{text} ({row[text]} sequences)", InputWarning, stacklevel=3)
    return report


def group_report(groups: DataFrame, points: DataFrame) -> DataFrame:
    """One row per sequence: members, unknown types, queries out of range, queries in several groups."""
    range_ = points.groupBy(SEQ).agg(F.max("query").alias("last"))
    member = groups.withColumn("group_type", F.coalesce("group_type", F.lit("co_moving")))
    shared = member.groupBy(SEQ, "query").agg(F.countDistinct("group_id").alias("n")).groupBy(SEQ).agg(F.count_if(F.col("n") > 1).alias("n_shared"))
    out = member.join(range_, SEQ, "left").groupBy(SEQ).agg(
        F.countDistinct("group_id").alias("n_groups"),
        F.count(F.lit(1)).alias("n_members"),
        F.count_if(~F.col("group_type").isin(*GROUP_TYPES)).alias("n_unknown_type"),
        F.count_if((F.col("query") < 0) | (F.col("query") > F.coalesce("last", F.lit(-1))) | F.col("query").isNull()).alias("n_out_of_range"),
    )
    return out.join(shared, SEQ)


def validate_groups(groups: DataFrame, points: DataFrame) -> DataFrame:
    """``groups`` with missing types as co_moving; raises on what :func:`group_report` counts."""
    r = group_report(groups, points).agg(F.sum("n_unknown_type").alias("t"), F.sum("n_out_of_range").alias("r"), F.sum("n_shared").alias("s")).first()
    for count, text in ((r.t, "unknown group type"), (r.r, "query out of range"), (r.s, "query in several groups")):
        if count:
            raise ValueError(f"{text} ({count})")
    return groups.withColumn("group_type", F.coalesce("group_type", F.lit("co_moving")))
