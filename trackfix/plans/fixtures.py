"""Trajectory sequences derived from the ``customer`` table by closed-form SQL, valid in Spark and DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfix.session import materialize, read_table

#: Five rigid objects (the first stands still) of 120 points together, over 16 frames; every 120 customers make up a sequence.
FIXTURE_CTES = {
    "frames": "SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15)) AS f(t)",
    "motion": """SELECT * FROM (VALUES (0,-4e0,0e0,3e0,0e0,0e0,0e0,1e0),(1,-2e0,0e0,35e-1,35e-2,0e0,0e0,75e-2),
  (2,0e0,0e0,4e0,0e0,-3e-1,0e0,12e-1),(3,2e0,0e0,45e-1,-2e-1,2e-1,0e0,9e-1),(4,4e0,0e0,5e0,0e0,0e0,25e-2,11e-1))
  AS m(o,ox,oy,oz,vx,vy,vz,bias)""",
    "cam": "SELECT t, t*1e-1 AS cx, t*125e-4 AS cy, 0e0 AS cz FROM frames",
    "q": """SELECT CAST(FLOOR(c_custkey/120) AS INT) AS seq_id, c_nationkey % 5 AS o, c_custkey AS k, CAST(c_custkey % 120 AS INT) AS query,
  (((c_custkey*7919) % 1000)/1000e0 - 5e-1)*6e-1 AS sx, (((c_custkey*104729) % 997)/997e0 - 5e-1)*6e-1 AS sy,
  (((c_custkey*1299709) % 991)/991e0 - 5e-1)*6e-1 AS sz FROM customer""",
    "gt": """SELECT q.seq_id, f.t AS frame, q.query, q.o, m.bias,
  m.ox+q.sx+m.vx*f.t AS gx, m.oy+q.sy+m.vy*f.t AS gy, m.oz+q.sz+m.vz*f.t AS gz,
  ((q.k*31 + f.t*17 + (q.k*f.t) % 7) % 20) <> 0 AS visible, ((q.k+f.t) % 3) = 0 AS measured
  FROM q CROSS JOIN frames f JOIN motion m ON m.o=q.o""",
    "pts": """SELECT g.*, c.cx+g.bias*(g.gx-c.cx) AS x, c.cy+g.bias*(g.gy-c.cy) AS y, c.cz+g.bias*(g.gz-c.cz) AS z,
  c.cx, c.cy, c.cz FROM gt g JOIN cam c ON c.t=g.frame""",
}
#: Points of a sequence of the scene of large sequences.
LARGE_POINTS = 3000
#: Customers whose trajectories one task writes.
TASK_CUSTOMERS = 20_000


def resized(sql: str, points: int) -> str:
    """The fixture's SQL with ``points`` customers a sequence."""
    return sql.replace("c_custkey/120)", f"c_custkey/{points})").replace("c_custkey % 120 ", f"c_custkey % {points} ")


FIXTURE_SQL = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in FIXTURE_CTES.items()) + "\nSELECT * FROM pts"


@dataclass(frozen=True)
class Scene:
    """The tidy tables of the fixture; ``truth`` has every cell's true position and object."""

    points: DataFrame
    observations: DataFrame
    cameras: DataFrame
    groups: DataFrame
    truth: DataFrame


def scene(spark: SparkSession, sf_dir: str, settle: bool = False, points: int = 120) -> Scene:
    """The fixture's tables with sequences of ``points`` points; ``settle`` writes it first, for queries of many steps.

    What is written is dealt out by customers: their file is small, so that Spark would give millions of points to one task.
    """
    customer = read_table(spark, sf_dir, "customer")
    if settle:
        customer = customer.select("c_custkey", "c_nationkey").repartition(-(-customer.count() // TASK_CUSTOMERS) or 1, "c_custkey")
    pts = spark.sql(resized(FIXTURE_SQL, points).replace("FROM customer", "FROM {customer}"), customer=customer)
    pts = materialize(pts) if settle else pts
    kind = F.when(F.col("o") == 0, "world_fixed").otherwise("co_moving")
    return Scene(
        pts.select("seq_id", "frame", "query", "x", "y", "z", "visible"),
        pts.where("measured").select("seq_id", "frame", "query", "gx", "gy", "gz"),
        pts.select("seq_id", "frame", "cx", "cy", "cz").distinct(),
        pts.where("frame = 0").select("seq_id", F.col("o").alias("group_id"), kind.alias("group_type"), "query"),
        pts.select("seq_id", "frame", "query", "gx", "gy", "gz", F.col("o").alias("label"), "visible"),
    )


def fragments(groups: DataFrame) -> DataFrame:
    """Each object in three interleaved fragments."""
    return groups.withColumn("group_id", (F.col("group_id") * 3 + F.col("query") % 3).cast("int"))
