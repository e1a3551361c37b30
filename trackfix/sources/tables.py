"""Tidy tables of trajectories, their schemas, and adapters from other shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Logical schemas, keyed by sequence, frame and query point.
SCHEMAS = {
    "points": "seq_id long, frame int, query int, x double, y double, z double, visible boolean",
    "observations": "seq_id long, frame int, query int, gx double, gy double, gz double",
    "cameras": "seq_id long, frame int, cx double, cy double, cz double",
    "extrinsics": "seq_id long, frame int, w2c array<array<double>>",
    "groups": "seq_id long, group_id int, group_type string, query int",
    "anchors": "seq_id long, group_id int, ord int, query int, frame int",
    "budget": "seq_id long, group_id int, k int",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def camera_centers(extrinsics: DataFrame, w2c: str = "w2c") -> DataFrame:
    """World-to-camera matrices (3x4 or 4x4) to camera centres ``-R^T t``; other shapes raise."""
    m = F.col(w2c)
    ok = F.size(m).isin(3, 4) & ~F.exists(m, lambda row: F.size(row) != 4)
    at = lambda i, j: m[i][j]
    centre = lambda j: -(at(0, j) * at(0, 3) + at(1, j) * at(1, 3) + at(2, j) * at(2, 3))
    checked = extrinsics.withColumn(w2c, F.when(ok, m).otherwise(F.raise_error(F.lit("extrinsics must be 3x4 or 4x4")).cast(extrinsics.schema[w2c].dataType)))
    return checked.select(*[c for c in extrinsics.columns if c != w2c], centre(0).alias("cx"), centre(1).alias("cy"), centre(2).alias("cz"))


def scatter_observations(entries: DataFrame, n_frames: int, n_queries: int, position: str = "pos") -> DataFrame:
    """Sparse entries ``(seq_id, query, frame, gx, gy, gz, pos)`` to observations, the last write of a cell winning.

    Frames and queries outside the grid, negative ones included, raise when the rows are read.
    """
    if n_frames <= 0 or n_queries <= 0:
        raise ValueError("n_frames and n_queries must be positive")
    inside = F.col("frame").between(0, n_frames - 1) & F.col("query").between(0, n_queries - 1)
    checked = entries.withColumn("frame", F.when(inside, F.col("frame")).otherwise(F.raise_error(F.lit("observation outside the grid")).cast("int")))
    last = F.max_by(F.struct("gx", "gy", "gz"), position).alias("g")
    return checked.groupBy("seq_id", "frame", "query").agg(last).select("seq_id", "frame", "query", "g.gx", "g.gy", "g.gz")


def unpack_observations(entries: DataFrame, xyz: str = "xyz") -> DataFrame:
    """Entries with one coordinate array to entries with three columns."""
    c = F.col(xyz)
    return entries.select(*[n for n in entries.columns if n != xyz], c[0].alias("gx"), c[1].alias("gy"), c[2].alias("gz"))


def dense_grid(points: DataFrame, observations: DataFrame, fill: float | None = None) -> DataFrame:
    """One row per cell of ``points``' grid with its observation, or ``fill``, and whether it is ``valid``."""
    keys = ["seq_id", "frame", "query"]
    marked = observations.select(*keys, "gx", "gy", "gz", F.lit(True).alias("valid"))
    out = points.select(*keys).join(marked, keys, "left")
    value = lambda n: F.when(F.col("valid"), F.col(n)).otherwise(F.lit(fill).cast("double")).alias(n)
    return out.select(*keys, value("gx"), value("gy"), value("gz"), F.coalesce("valid", F.lit(False)).alias("valid"))
