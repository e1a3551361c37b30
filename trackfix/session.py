"""Session helpers shared by the operators: reading tables, cutting lineage, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder for intermediate tables in the shared checkpoint folder that the session names.

    Only where ``spark.checkpoint.dir`` is unset and the master is local, as in tests on one machine, is a
    temporary folder made; on a cluster that raises. The folder goes when the application ends.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = context.get() if context.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/trackfix-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a copy that survives lost executors, and keeps costly steps from running twice.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """Tables that don't depend on each other, their jobs submitted side by side; the first failure is raised.

    Many small jobs wait for the driver rather than for executors; the scheduler shares these among the jobs.
    """
    spark = SparkSession.getActiveSession()
    inherit = inheritable_thread_target(spark) if spark is not None else lambda f: f
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(inherit(m)) for m in makers]]


def join_sized(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_rows: int = 50_000, row_bytes: int = 200
) -> DataFrame:
    """Join to a materialized ``right``: broadcast below a checked size, else a shuffled join.

    The check counts rows and the bytes of string columns, so what is broadcast is at most about
    ``max_rows * row_bytes``; beyond that the join sorts, its hot keys split by adaptive execution: left to itself, Spark
    would go by the size of the files, which for repeated values is a small part of what they hold in memory.
    """
    strings = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in right.dtypes if kind == "string"]
    wide = sum(strings, F.lit(0)).cast("long")
    rows, size = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0).cast("long"))).first()
    if rows <= max_rows and size <= max_rows * row_bytes:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)
