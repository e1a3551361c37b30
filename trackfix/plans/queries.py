"""Registered queries of the trajectory engine, over trajectories that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackfix.config import RectifyConfig
from trackfix.functions.scalars import rounded
from trackfix.operators import correct, estimate, geometry, grouping, metrics, motion, neighbours, sampling, validate
from trackfix.operators.budget import allocate_budget
from trackfix.plans.fixtures import LARGE_POINTS, Scene, fragments, scene
from trackfix.plans.rectify import rectify
from trackfix.session import materialize, read_table
from trackfix.sources import tables

CFG, MANY = RectifyConfig(), RectifyConfig(target_anchor_frac=0.3)
QUERIES = {}
KEYS = ["seq_id", "frame", "query"]


#: Queries of many steps, which write their trajectories before the first.
SETTLED = {
    "direction_edges", "direction_edges_all_pairs", "knn_edges", "spatial_knn_graph", "radius_pairs", "connected_components", "motion_clusters", "spatial_split",
    "merge_fragments", "fragment_scale", "sample_anchors_common_frame", "sample_anchors_distinct", "sample_anchors_numpy", "anchor_points", "camera_scale",
    "per_frame_scale", "interpolated_scale", "smoothed_scale", "anchor_scale", "group_translation", "sim3_fit", "fragment_absorption", "split_world_fixed", "built_groups",
    "group_type_counts", "coverage_report",
}


def query(f):
    """Registers ``f(scene)`` under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(scene(spark, sf_dir, f.__name__ in SETTLED))

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return f


@query
def trajectory_points(s: Scene) -> DataFrame:
    """The predicted trajectories."""
    return s.points.select(*KEYS, *rounded("x", "y", "z"), "visible")


@query
def camera_centers(s: Scene) -> DataFrame:
    """Centres from world-to-camera matrices of a camera that turns about its vertical axis."""
    c, n = F.cos(F.col("frame") * 0.1), F.sin(F.col("frame") * 0.1)
    zero = F.lit(0.0)
    row = lambda a, b, d: F.array(a, b, d, -(a * F.col("cx") + b * F.col("cy") + d * F.col("cz")))
    matrix = F.array(row(c, zero, n), row(zero, F.lit(1.0), zero), row(-n, zero, c))
    return tables.camera_centers(s.cameras.select("seq_id", "frame", matrix.alias("w2c"))).select("seq_id", "frame", *rounded("cx", "cy", "cz"))


@query
def sparse_observations(s: Scene) -> DataFrame:
    """Observations from entries of which some write a cell twice; the last write wins."""
    first = s.observations.withColumn("pos", F.lit(0))
    again = s.observations.where("query % 7 = 0").withColumns({"gx": F.col("gx") + 1, "pos": F.lit(1)})
    return tables.scatter_observations(first.unionByName(again), 16, 1 << 30).select(*KEYS, *rounded("gx", "gy", "gz"))


@query
def dense_grid_scatter(s: Scene) -> DataFrame:
    """Observations on the whole grid."""
    return tables.dense_grid(s.points, s.observations).select(*KEYS, *rounded("gx", "gy", "gz"), "valid")


@query
def validation_report(s: Scene) -> DataFrame:
    return validate.validation_report(s.points, s.observations, s.cameras, CFG)


@query
def group_validation(s: Scene) -> DataFrame:
    """The groups' report, with a shared query, an unknown type and a query out of range put in."""
    bad = s.groups.where("query < 3").withColumns({"group_id": F.col("group_id") + 10, "group_type": F.lit("other"), "query": F.when(F.col("query") == 2, F.lit(-1)).otherwise(F.col("query"))})
    return validate.group_report(s.groups.unionByName(bad), s.points)


@query
def observed_pairs(s: Scene) -> DataFrame:
    """Predicted and observed position of every observable cell."""
    both = s.points.where("visible").join(s.observations, KEYS)
    return both.select(*KEYS, *rounded("x", "y", "z", "gx", "gy", "gz"))


@query
def median_positions(s: Scene) -> DataFrame:
    return motion.median_positions(s.points).select("seq_id", "query", *rounded("px", "py", "pz"))


@query
def world_fixed_points(s: Scene) -> DataFrame:
    return motion.world_fixed_points(s.points, CFG).select("seq_id", "query", "n_visible", *rounded("spread"))


@query
def velocities(s: Scene) -> DataFrame:
    return motion.velocities(s.points).select("seq_id", "query", "frame", *rounded("dx", "dy", "dz"))


def _rows(desc: DataFrame, key: str) -> DataFrame:
    d = desc.select("seq_id", key, F.explode("desc").alias("d")).select("seq_id", key, "d.frame", "d.dx", "d.dy", "d.dz")
    return d.select("seq_id", key, "frame", *rounded("dx", "dy", "dz"))


@query
def direction_descriptors(s: Scene) -> DataFrame:
    return _rows(motion.direction_descriptors(s.points, CFG), "query")


@query
def group_descriptors(s: Scene) -> DataFrame:
    return _rows(motion.group_descriptors(s.points, s.groups, CFG), "group_id")


@query
def camera_rays(s: Scene) -> DataFrame:
    return geometry.rays(s.points, s.cameras).select("seq_id", "query", "frame", *rounded("rx", "ry", "rz"))


@query
def query_parallax(s: Scene) -> DataFrame:
    return geometry.query_parallax(s.points, s.cameras).select("seq_id", "query", *rounded("parallax"))


@query
def group_parallax_form(s: Scene) -> DataFrame:
    """Each group's median parallax and the form that follows, with a threshold that both sides meet."""
    forms = correct.choose_forms(geometry.group_parallax(s.groups, geometry.query_parallax(s.points, s.cameras)), RectifyConfig(parallax_threshold_deg=30.0))
    return forms.select("seq_id", "group_id", "group_type", *rounded("parallax"), "form")


def _moving(s: Scene) -> DataFrame:
    fixed = motion.world_fixed_points(s.points, CFG).select("seq_id", "query")
    return materialize(motion.direction_descriptors(s.points, CFG).join(fixed.hint("merge"), ["seq_id", "query"], "left_anti"))


def _edges(s: Scene) -> DataFrame:
    return grouping.direction_edges(_moving(s), materialize(motion.median_positions(s.points)), CFG)


@query
def direction_edges(s: Scene) -> DataFrame:
    return _edges(s).select("seq_id", "a", "b", *rounded("similarity"))


@query
def direction_edges_all_pairs(s: Scene) -> DataFrame:
    """The direction graph of whole sequences without a neighbour limit."""
    return _unlimited(s)


def _unlimited(s: Scene) -> DataFrame:
    return grouping.direction_edges(_moving(s), motion.median_positions(s.points), RectifyConfig(direction_knn=None)).select("seq_id", "a", "b", *rounded("similarity"))


@query
def knn_edges(s: Scene) -> DataFrame:
    """The ten nearest points of every point of a sequence."""
    return _nearest_ten(s)


def _nearest_ten(s: Scene) -> DataFrame:
    return neighbours.nearest(motion.median_positions(s.points), ["seq_id"], 10).select("seq_id", "a", "b", "rank", *rounded("d2"))


@query
def spatial_knn_graph(s: Scene) -> DataFrame:
    """Undirected edges between each group's nearest members."""
    near = neighbours.nearest(s.groups.join(motion.median_positions(s.points), ["seq_id", "query"]), ["seq_id", "group_id"], 3)
    return near.select("seq_id", "group_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query
def radius_pairs(s: Scene) -> DataFrame:
    """Fragments whose centroids are within reach of the earlier one."""
    parts = fragments(s.groups)
    pos = materialize(motion.median_positions(s.points))
    items = grouping.group_centroids(parts, pos).join(grouping.fragment_scale(parts, pos), ["seq_id", "group_id"])
    return neighbours.radius_pairs(items.withColumn("reach", F.col("scale") * 3), ["seq_id"], "group_id", "reach").select("seq_id", "a", "b", *rounded("d2"))


@query
def nearest_centroids(s: Scene) -> DataFrame:
    """The nearest other fragment of each fragment."""
    items = grouping.group_centroids(fragments(s.groups), motion.median_positions(s.points))
    return neighbours.nearest_centroid(items, ["seq_id"], "group_id").select("seq_id", "a", "b", *rounded("d2"))


@query
def connected_components(s: Scene) -> DataFrame:
    """Components of the two-nearest-neighbour graph of each sequence."""
    return grouping.keyed_components(neighbours.nearest(motion.median_positions(s.points), ["seq_id"], 2), ["seq_id"])


def _clusters(s: Scene) -> DataFrame:
    fixed = motion.world_fixed_points(s.points, CFG).select("seq_id", "query")
    return grouping.motion_clusters(fixed, _moving(s), _edges(s), CFG)


@query
def motion_clusters(s: Scene) -> DataFrame:
    return _clusters(s)


@query
def spatial_split(s: Scene) -> DataFrame:
    """Objects split where their two-nearest-neighbour graphs fall apart."""
    return grouping.spatial_split(s.groups, materialize(motion.median_positions(s.points)), RectifyConfig(spatial_knn=2))


@query
def merge_fragments(s: Scene) -> DataFrame:
    """Interleaved fragments joined again by motion."""
    return grouping.merge_fragments(fragments(s.groups), s.points, materialize(motion.median_positions(s.points)), CFG)


@query
def fragment_scale(s: Scene) -> DataFrame:
    return grouping.fragment_scale(s.groups, motion.median_positions(s.points)).select("seq_id", "group_id", *rounded("scale"))


@query
def group_centroids(s: Scene) -> DataFrame:
    return grouping.group_centroids(s.groups, motion.median_positions(s.points)).select("seq_id", "group_id", "group_type", *rounded("px", "py", "pz"), "size")


@query
def group_motion(s: Scene) -> DataFrame:
    return motion.group_motion(s.points, s.observations.unionByName(_extra(s)), s.groups).select("seq_id", "group_id", "group_type", "size", *rounded("motion"))


def _extra(s: Scene) -> DataFrame:
    """The true positions of even frames' next frames, so that some cells are observed in a row."""
    return s.truth.where("query % 2 = 0 AND frame % 4 < 2").select(*KEYS, "gx", "gy", "gz").join(s.observations.select(*KEYS), KEYS, "left_anti")


def _budget(s: Scene, cfg: RectifyConfig) -> DataFrame:
    stats = motion.group_motion(s.points, s.observations.unionByName(_extra(s)), s.groups)
    n = s.points.groupBy("seq_id").agg(F.countDistinct("query").alias("n_queries"))
    return allocate_budget(materialize(stats), n, cfg)


@query
def anchor_budget_motion(s: Scene) -> DataFrame:
    return _budget(s, CFG)


@query
def anchor_budget_proportional(s: Scene) -> DataFrame:
    """A large budget by size, with a limit per group."""
    return _budget(s, RectifyConfig(anchor_allocation_strategy="proportional_size", target_anchor_frac=0.5, max_anchors_per_group=30))


def _cells(s: Scene, cfg: RectifyConfig = CFG) -> DataFrame:
    return materialize(sampling.candidate_cells(s.points, s.observations, s.groups, _budget(s, cfg)))


def _anchors(s: Scene, cfg: RectifyConfig = CFG) -> DataFrame:
    return materialize(sampling.sample_anchors(_cells(s, cfg), 7))


@query
def sample_anchors_common_frame(s: Scene) -> DataFrame:
    return _anchors(s)


@query
def sample_anchors_distinct(s: Scene) -> DataFrame:
    return sampling.sample_anchors(_cells(s), 7, prefer_common_frame=False)


@query
def sample_anchors_numpy(s: Scene) -> DataFrame:
    return sampling.sample_anchors_numpy(_cells(s), 7)


def _anchored(s: Scene, cfg: RectifyConfig = CFG) -> DataFrame:
    return materialize(estimate.anchor_points(_anchors(s, cfg), s.points, s.observations))


@query
def anchor_points(s: Scene) -> DataFrame:
    """Anchors with their predicted and observed positions."""
    return _anchored(s).select("seq_id", "group_id", "ord", "query", "frame", *rounded("x", "y", "z", "gx", "gy", "gz"))


@query
def camera_scale(s: Scene) -> DataFrame:
    return estimate.camera_scale(_anchored(s), s.cameras).select("seq_id", "group_id", *rounded("c0x", "c0y", "c0z", "alpha"))


def _frame_scales(s: Scene) -> DataFrame:
    return materialize(estimate.per_frame_scale(_anchored(s), s.points, s.observations, s.cameras))


@query
def per_frame_scale(s: Scene) -> DataFrame:
    return _frame_scales(s).select("seq_id", "group_id", "frame", *rounded("alpha"))


@query
def interpolated_scale(s: Scene) -> DataFrame:
    return estimate.interpolated_scale(_frame_scales(s), s.cameras).select("seq_id", "group_id", "frame", *rounded("filled"))


@query
def smoothed_scale(s: Scene) -> DataFrame:
    return estimate.smoothed_scale(_frame_scales(s), s.cameras, 2.0).select("seq_id", "group_id", "frame", *rounded("alpha"))


@query
def anchor_scale(s: Scene) -> DataFrame:
    return estimate.anchor_scale(_anchored(s)).select("seq_id", "group_id", *rounded("a0x", "t0x", "s"))


@query
def group_translation(s: Scene) -> DataFrame:
    return estimate.group_translation(_anchored(s)).select("seq_id", "group_id", *rounded("dx", "dy", "dz"))


@query
def sim3_fit(s: Scene) -> DataFrame:
    """Similarity fits of each object, from a budget that gives it three anchors or more."""
    return estimate.sim3_fit(_anchored(s, MANY)).select("seq_id", "group_id", *rounded("scale", "tx", "ty", "tz"))


def _corrected(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = scene(spark, sf_dir, settle=True)
        anchors = _anchors(s, MANY if form == "full_sim3" else CFG)
        return correct.apply_form(s.points, s.observations, s.cameras, s.groups, anchors, form, CFG).select(*KEYS, *rounded("x", "y", "z"))

    run.__doc__ = f"All groups corrected by the form {form}."
    return run


for _form in correct.FORMS:
    QUERIES[f"corrected_{_form}"] = _corrected(_form)


@query
def fragment_absorption(s: Scene) -> DataFrame:
    """Small fragments of each object absorbed by the nearest group."""
    size = F.when(F.col("query") % 40 == 0, F.col("group_id") + 20).otherwise(F.col("group_id")).cast("int")
    return grouping.absorb_fragments(s.groups.withColumn("group_id", size), materialize(motion.median_positions(s.points)), CFG)


@query
def split_world_fixed(s: Scene) -> DataFrame:
    """The still object cut where its nearest-neighbour graph falls apart, small parts absorbed."""
    return grouping.split_world_fixed(s.groups, materialize(motion.median_positions(s.points)), RectifyConfig(world_fixed_spatial_knn=1))


@query
def built_groups(s: Scene) -> DataFrame:
    """The library's own groups."""
    return grouping.motion_groups(s.points, CFG)


@query
def group_type_counts(s: Scene) -> DataFrame:
    return metrics.group_type_counts(_clusters(s))


@query
def coverage_report(s: Scene) -> DataFrame:
    """How the direction clusters cover the true objects."""
    labels = s.truth.where("frame = 0").select("seq_id", "query", "label")
    return metrics.coverage(_clusters(s), labels)


@query
def median_epe(s: Scene) -> DataFrame:
    """Median endpoint error of each object before and after a camera scale and translation from all observations."""
    cells = s.points.where("visible").join(s.observations, KEYS).join(s.groups, ["seq_id", "query"])
    order = F.row_number().over(Window.partitionBy("seq_id", "group_id").orderBy("frame", "query")) - 1
    anchored = materialize(cells.withColumn("ord", order.cast("int")).select(*KEYS, "group_id", "ord", *"xyz", "gx", "gy", "gz"))
    scale = materialize(estimate.camera_scale(anchored, s.cameras))
    place = lambda df: df.join(scale, ["seq_id", "group_id"]).withColumns({a: F.col("c0" + a) + F.col("alpha") * (F.col(a) - F.col("c0" + a)) for a in "xyz"})
    shift = materialize(estimate.group_translation(place(anchored)))
    moved = place(s.points.join(s.groups, ["seq_id", "query"])).join(shift, ["seq_id", "group_id"])
    moved = moved.withColumns({a: F.col(a) + F.col("d" + a) for a in "xyz"})
    before = metrics.median_error(s.points, s.truth, ["seq_id", "label"]).withColumnRenamed("epe", "epe_before")
    after = metrics.median_error(moved, s.truth, ["seq_id", "label"]).select("seq_id", "label", F.col("epe").alias("epe_after"))
    return before.join(after, ["seq_id", "label"]).select("seq_id", "label", "cells", *rounded("epe_before", "epe_after"))


def _whole(spark: SparkSession, sf_dir: str, **more):
    s = scene(spark, sf_dir)
    return s, rectify(s.points, s.observations, s.cameras, CFG, seed=7, **more)


def rectify_supplied_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with the true objects as groups."""
    s = scene(spark, sf_dir)
    return rectify(s.points, s.observations, s.cameras, CFG, seed=7, groups=s.groups).corrected.select(*KEYS, "group_id", *rounded("x", "y", "z"))


def rectify_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with the library's own groups."""
    return _whole(spark, sf_dir)[1].corrected.select(*KEYS, "group_id", *rounded("x", "y", "z"))


def rectify_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, solved groups and anchors of each sequence."""
    return _whole(spark, sf_dir)[1].diagnostics


def embedding_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unstructured trajectories: each embedding as 22 frames of a point, in one sequence per label; two coordinates of the last frame are missing."""
    e = read_table(spark, sf_dir, "embeddings")
    cell = F.posexplode(F.sequence(F.lit(0), F.lit(21)))
    at = lambda i: F.get("embedding", 3 * F.col("frame") + i).cast("double")
    pts = e.select(F.col("label").alias("seq_id"), F.col("vec_id").alias("query"), "embedding", cell.alias("frame", "f"))
    pts = pts.select("seq_id", "query", "frame", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.lit(True).alias("visible"))
    return motion.median_positions(pts).select("seq_id", "query", *rounded("px", "py", "pz"))


def _of_large_sequences(name: str):
    """The registered query ``name`` over sequences of 3,000 points, where limits of neighbours act."""
    by_scene = {"direction_edges": lambda s: _edges(s).select("seq_id", "a", "b", *rounded("similarity")), "direction_edges_all_pairs": _unlimited, "knn_edges": _nearest_ten}[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_scene(scene(spark, sf_dir, settle=True, points=LARGE_POINTS))

    return run


QUERIES |= {f"{name}_large": _of_large_sequences(name) for name in ("direction_edges", "direction_edges_all_pairs", "knn_edges")}
QUERIES |= {f.__name__: f for f in (rectify_supplied_groups, rectify_full, rectify_diagnostics, embedding_trajectories)}
