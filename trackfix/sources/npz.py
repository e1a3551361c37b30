"""NumPy archives of one sequence each, read and written as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIDY = "path string, frame int, query int, x double, y double, z double, visible boolean, gx double, gy double, gz double, measured boolean, cx double, cy double, cz double"


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Archives below ``path`` as one row per file, frame and query; Spark lists and reads the files."""

    def tidy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    pred, gt, centers = (z[k].astype(float) for k in ("pred_m", "gt_m", "centers"))
                    visible, valid = z["pred_visible"].astype(bool), z["gt_valid"].astype(bool)
                t, n, _ = pred.shape
                out = {"path": name, "frame": np.repeat(np.arange(t, dtype=np.int32), n), "query": np.tile(np.arange(n, dtype=np.int32), t)}
                for names, value in ((("x", "y", "z"), pred), (("gx", "gy", "gz"), gt), (("cx", "cy", "cz"), np.broadcast_to(centers[:, None], pred.shape))):
                    out |= {c: value[..., i].reshape(-1) for i, c in enumerate(names)}
                frame = pd.DataFrame(out | {"visible": visible.reshape(-1), "measured": valid.reshape(-1)})
                yield frame[[c.split()[0] for c in TIDY.split(", ")]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(tidy, TIDY)


def to_npz(rows: DataFrame, key: str = "seq_id") -> DataFrame:
    """``(key, npz)``: each sequence's rows (the columns of ``read_npz`` but path) as a compressed archive of float32.

    A sequence is one archive and so one task's work; sequences are dealt out by key.
    """
    kind = rows.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        pdf = pdf.sort_values(["frame", "query"])
        t, n = pdf["frame"].nunique(), pdf["query"].nunique()
        cube = lambda names: pdf[names].to_numpy(np.float32).reshape(t, n, 3)
        grid = lambda name: pdf[name].to_numpy(bool).reshape(t, n)
        out = io.BytesIO()
        np.savez_compressed(out, pred_m=cube(["x", "y", "z"]), gt_m=cube(["gx", "gy", "gz"]), pred_visible=grid("visible"), gt_valid=grid("measured"), centers=cube(["cx", "cy", "cz"])[:, 0])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "npz": [out.getvalue()]})

    return rows.groupBy(key).applyInPandas(pack, f"{key} {kind}, npz binary").select(key, F.col("npz"))
