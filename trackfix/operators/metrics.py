"""Endpoint errors and reports on groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.functions.scalars import SEQ, norm3
from trackfix.operators.medians import grouped_medians, largest_group


def median_error(points: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Median distance of ``points`` (x, y, z) to ``truth`` (gx, gy, gz, and the columns ``by``).

    A label may hold any number of cells: large groups' medians are selected by histograms. What ``truth`` has of
    a label bounds its cells, so that the joined table is made once where no label is large.
    """
    d = norm3(*[F.col(a) - F.col("g" + a) for a in ("x", "y", "z")])
    keys = [SEQ, "frame", "query"]
    joined = points.select(*keys, "x", "y", "z").join(truth.select(*keys, "gx", "gy", "gz", *[c for c in by if c not in keys]), keys)
    return grouped_medians(joined.withColumn("epe", d), by, ["epe"], [F.count(F.lit(1)).alias("cells")], largest=largest_group(truth, by))


def group_type_counts(groups: DataFrame) -> DataFrame:
    return groups.select(SEQ, "group_id", "group_type").distinct().groupBy(SEQ, "group_type").agg(F.count(F.lit(1)).alias("n_groups"))


def coverage(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Per true object (``label``): its points, those in a group, groups that touch it, and mixed ones among them."""
    joined = labels.join(groups.select(SEQ, "query", "group_id"), [SEQ, "query"], "left")
    mixed = joined.where("group_id IS NOT NULL").groupBy(SEQ, "group_id").agg((F.countDistinct("label") > 1).alias("mixed"))
    return joined.join(mixed, [SEQ, "group_id"], "left").groupBy(SEQ, "label").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count("group_id").alias("n_covered"),
        F.countDistinct("group_id").alias("n_groups"),
        F.countDistinct(F.when(F.col("mixed"), F.col("group_id"))).alias("n_mixed"),
    )


def changed_groups(before: DataFrame, after: DataFrame, groups: DataFrame) -> DataFrame:
    """``(seq_id, group_id, change)`` of groups whose positions moved by more than 1e-6 in all."""
    keys = [SEQ, "frame", "query"]
    b = before.select(*keys, *[F.col(a).alias("b" + a) for a in ("x", "y", "z")])
    d2 = sum(((F.col(a) - F.col("b" + a)) * (F.col(a) - F.col("b" + a)) for a in ("x", "y", "z")), F.lit(0.0))
    own = groups.select(SEQ, "query", F.col("group_id").alias("g"))
    total = after.select(*keys, "x", "y", "z").join(b, keys).join(own.hint("merge"), [SEQ, "query"]).groupBy(SEQ, F.col("g").alias("group_id")).agg(F.sqrt(F.sum(d2)).alias("change"))
    return total.where("change > 1e-6")
