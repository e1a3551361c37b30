"""Correcting sequences as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackfix.config import RectifyConfig
from trackfix.functions.scalars import SEQ
from trackfix.plans.rectify import rectify
from trackfix.session import materialize


def complete_sequences(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """``(seq_id)`` of sequences in ``rows`` that have every frame of ``cameras``, all of one number of points."""
    frames = rows.groupBy(SEQ, "frame").agg(F.count(F.lit(1)).alias("n")).groupBy(SEQ).agg(F.count(F.lit(1)).alias("frames"), F.min("n").alias("least"), F.max("n").alias("most"))
    wanted = cameras.select(SEQ, "frame").distinct().groupBy(SEQ).agg(F.count(F.lit(1)).alias("wanted"))
    return frames.join(wanted, SEQ).where("frames = wanted AND least = most").select(SEQ)


def rectify_stream(
    points: DataFrame, observations: DataFrame, cameras: DataFrame, path: str, checkpoint: str, cfg: RectifyConfig | None = None, seed: int = 0, late: str = "keep"
) -> StreamingQuery:
    """Corrects sequences once all their frames have come, and writes them as Parquet below ``path``, one folder per batch.

    A sequence's frames may come over any number of micro-batches, a frame's points in one of them: its medians
    and smoothing need all frames, so it waits until it has as many as ``cameras`` has of it. Frames of a sequence
    that is done already are late: they go to ``path/_late``, or fail the query with ``late="raise"``.

    What waits and which sequences are done is kept beside the results, as tables per batch that only the next
    batch reads. So a batch that runs again finds what it found before and overwrites its own folders: results
    are written once. ``observations`` and ``cameras`` are tables; only a batch's sequences are read from them.
    """
    if late not in ("keep", "raise"):
        raise ValueError("late must be keep or raise")

    def correct(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = lambda name, n: f"{path}/_{name}/batch={n}"
        store = lambda df, name: df.write.mode("overwrite").parquet(table(name, number))
        if number:
            done = spark.read.parquet(table("done", number - 1))
            waiting = spark.read.schema(batch.schema).parquet(table("waiting", number - 1))
            behind = batch.join(done, SEQ, "left_semi")
            if late == "raise" and not behind.isEmpty():
                raise ValueError("frames came of sequences that were complete")
            store(behind, "late")
            rows = materialize(waiting.unionByName(batch.join(done, SEQ, "left_anti")))
        else:
            done, rows = batch.select(SEQ).limit(0), materialize(batch)
        ready = materialize(complete_sequences(rows, cameras.join(rows.select(SEQ).distinct(), SEQ, "left_semi")))
        store(rows.join(ready, SEQ, "left_anti"), "waiting")
        if not ready.isEmpty():
            own = lambda df: df.join(ready, SEQ, "left_semi")
            rectify(own(rows), own(observations), own(cameras), cfg, seed).corrected.write.mode("overwrite").parquet(f"{path}/batch={number}")
        store(done.unionByName(ready).distinct(), "done")

    return points.writeStream.foreachBatch(correct).option("checkpointLocation", checkpoint).start()
