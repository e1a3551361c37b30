"""Anchor sampling, by hashes or by numpy's generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.functions.scalars import SEQ


def _draw(seed: int, *names: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def candidate_cells(points: DataFrame, observations: DataFrame, groups: DataFrame, budget: DataFrame) -> DataFrame:
    """Observable cells ``(seq_id, group_id, k, query, frame, place)`` of groups with a budget.

    ``place`` is a member's place in its group: the column ``ord`` of ``groups`` where there is one, else the query.
    """
    keys = [SEQ, "frame", "query"]
    seen = points.where("visible").select(*keys).join(observations.select(*keys).distinct().hint("merge"), keys)
    able = groups.where("group_type <> 'independent_dynamic'").join(budget.where("k > 0").hint("merge"), [SEQ, "group_id"])
    place = F.col("ord" if "ord" in groups.columns else "query").alias("place")
    return seen.join(able.select(SEQ, "group_id", "query", "k", place).hint("merge"), [SEQ, "query"])


def sample_anchors(cells: DataFrame, seed: int = 0, prefer_common_frame: bool = True) -> DataFrame:
    """``(seq_id, group_id, ord, query, frame)``: k anchors of each group, drawn by md5 of seed and keys.

    Where some frame has k candidates, one such frame is drawn and k of its queries; else k queries and for
    each one of its frames. A group with fewer than k candidates gets none. Reruns agree.
    """
    group = [SEQ, "group_id"]
    queries = cells.groupBy(*group, "k", "query").agg(F.min_by("frame", F.struct(_draw(seed, SEQ, "group_id", "query", "frame"), "frame")).alias("own"))
    queries = queries.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("n >= k")
    frames = cells.groupBy(*group, "k", "frame").agg(F.countDistinct("query").alias("n")).where("n >= k")
    common = frames.groupBy(*group).agg(F.min_by("frame", F.struct(_draw(seed, SEQ, "group_id", "frame"), "frame")).alias("common"))
    if not prefer_common_frame:
        common = common.where(F.lit(False))
    inside = cells.select(*group, "k", "query", "frame").hint("merge").join(common, group).where("frame = common").select(*group, "k", "query", "frame").distinct()
    scattered = queries.join(common, group, "left_anti").select(*group, "k", "query", F.col("own").alias("frame"))
    pool = inside.unionByName(scattered).withColumn("draw", _draw(seed, SEQ, "group_id", "query"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("draw", "query"))
    return pool.withColumn("ord", (rank - 1).cast("int")).where("ord < k").select(*group, "ord", "query", "frame")


def sample_anchors_numpy(cells: DataFrame, seed: int = 0, prefer_common_frame: bool = True) -> DataFrame:
    """The same draw by one ``numpy`` generator per sequence, which goes through its groups by id and members by ``place``."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, rows = np.random.default_rng(seed), []
        for group_id, part in pdf.groupby("group_id", sort=True):
            k = int(part["k"].iloc[0])
            seen = part.drop_duplicates(["query", "frame"]).sort_values(["place", "frame"])
            members = seen["query"].unique()
            if len(members) < k:
                continue
            per_frame = seen.groupby("frame")["query"].nunique()
            full = per_frame.index[per_frame >= k].to_numpy() if prefer_common_frame else np.zeros(0, int)
            if len(full):
                frame = int(rng.choice(full))
                picked = [(int(q), frame) for q in rng.choice(seen.loc[seen["frame"] == frame, "query"].to_numpy(), size=k, replace=False)]
            else:
                picked = [(int(q), int(rng.choice(seen.loc[seen["query"] == q, "frame"].to_numpy()))) for q in rng.choice(members, size=k, replace=False)]
            rows += [(pdf[SEQ].iloc[0], group_id, i, q, t) for i, (q, t) in enumerate(picked)]
        return pd.DataFrame(rows, columns=[SEQ, "group_id", "ord", "query", "frame"]).astype({"ord": "int32", "query": "int32", "frame": "int32"})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    return cells.groupBy(SEQ).applyInPandas(draw, f"{SEQ} {kinds[SEQ]}, group_id {kinds['group_id']}, ord int, query int, frame int")
