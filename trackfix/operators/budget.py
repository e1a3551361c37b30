"""Anchor budgets: largest-remainder apportionment without a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackfix.config import RectifyConfig
from trackfix.functions.scalars import SEQ


def allocate_budget(stats: DataFrame, n_queries: DataFrame, cfg: RectifyConfig) -> DataFrame:
    """``(seq_id, group_id, k)`` from group statistics (group_type, size, motion) and ``(seq_id, n_queries)``.

    The budget is ``floor(frac * n_queries)``, at most the summed sizes of groups that aren't independent.
    Shares follow size, or size times (1 + motion / largest motion). A group gets the floor of its share up
    to its size; what is left goes one by one to the largest remainder, which a group can win twice at most,
    so two slots a group, ranked, replace the loop. Where sizes bind, less than the budget is spent.
    """
    seq = Window.partitionBy(SEQ)
    able = stats.where("group_type <> 'independent_dynamic'").join(n_queries, SEQ)
    cap = F.least(F.floor(F.lit(cfg.target_anchor_frac) * F.col("n_queries")), F.sum("size").over(seq))
    most = F.max("motion").over(seq)
    weight = F.col("size") * F.lit(1.0)
    if cfg.anchor_allocation_strategy == "motion_weighted":
        weight = F.col("size") * (1 + F.col("motion") / F.when(most > 0, most).otherwise(F.lit(1.0)))
    shared = able.withColumns({"cap": cap, "score": weight}).withColumn("total", F.sum("score").over(seq)).where("cap > 0 AND total > 0")
    shared = shared.withColumn("f", F.col("cap") * F.col("score") / F.col("total")).withColumn("base", F.least(F.floor("f"), F.col("size")))
    extra = shared.withColumn("extra", F.col("cap") - F.sum("base").over(seq))
    slots = extra.withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
    slots = slots.withColumn("rest", F.col("f") - (F.col("base") + F.col("slot")))
    open_ = slots.where((F.col("base") + F.col("slot") + 1 <= F.col("size")) & (F.col("rest") > -1))
    won = open_.withColumn("rank", F.row_number().over(seq.orderBy(F.desc("rest"), "group_id"))).where("rank <= extra")
    more = won.groupBy(SEQ, "group_id").agg(F.count(F.lit(1)).alias("more"))
    k = F.coalesce("base", F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))
    k = k if cfg.max_anchors_per_group is None else F.least(k, F.lit(cfg.max_anchors_per_group))
    out = stats.select(SEQ, "group_id").join(extra.select(SEQ, "group_id", "base").hint("merge"), [SEQ, "group_id"], "left").join(more.hint("merge"), [SEQ, "group_id"], "left")
    return out.select(SEQ, "group_id", k.cast("int").alias("k"))
