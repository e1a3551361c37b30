"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine at least c are at most ``eps = sqrt(2 - 2c)`` apart. Vectors are rotated onto the
principal axes and laid on a grid of cells of side eps over the first ``DIMS`` of them. As coordinates lie
in [-1, 1] there is a fixed number of cells at most, however many vectors there are. The sequence in grid
order is cut into intervals of about ``block`` vectors; two intervals whose cells are farther apart than eps
never meet. An interval pair is one task, which halves its intervals recursively, skips parts whose bounding
boxes on more axes, and on the length that is left to the others, are farther apart than eps, and compares
the rest. A task returns each vector's number of links and a spanning forest of them, never the links
themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.operators.components import connected_components
from trackfix.session import join_sized, materialize

DIMS, BOX_DIMS, LEAF = 4, 24, 512


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of doubles, padded with zeros to the longest."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = max([*sizes, 1]) if width is None else width
    out = np.zeros((len(column), width))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(values):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), width))
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all unit vectors as columns, from one sum of outer products."""
    sums = vectors.select("embedding").mapInArrow(_moments(width), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    second = np.zeros((width, width))
    for r in sums:
        second[r.i, r.j] = second[r.j, r.i] = r.v
    return np.linalg.eigh(second)[1][:, ::-1]


def _cells(axes, eps: float):
    side = 2 * math.ceil(1 / eps) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = axes.value[:, :DIMS]
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), len(lead))) @ lead
            cell = np.clip(np.floor(x / eps).astype(np.int64) + side // 2, 0, side - 1)
            number = np.zeros(len(x), np.int64)
            for k in range(cell.shape[1]):
                number = number * side + cell[:, k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "cell"])

    return run, side


def _intervals(counts: list[tuple[int, int]], side: int, dims: int, block: int) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]]]:
    """Cells in grid order to intervals: ``(cell, interval)``, parts per interval, and pairs that may link."""
    cells, sizes, boxes = [], [], []
    for cell, n in sorted(counts):
        place = np.array([cell // side**k % side for k in reversed(range(dims))])
        if not sizes or sizes[-1] + n > block:
            sizes.append(0)
            boxes.append([place, place])
        sizes[-1] += n
        boxes[-1] = [np.minimum(boxes[-1][0], place), np.maximum(boxes[-1][1], place)]
        cells.append((cell, len(sizes) - 1))
    parts = [-(-n // block) for n in sizes]
    low, high = (np.array([b[k] for b in boxes]).reshape(len(boxes), dims) for k in (0, 1))
    near = []
    for i in range(len(boxes)):
        gap = np.maximum(0, np.maximum(low[i:] - high[i] - 1, low[i] - high[i:] - 1))
        near += [(i, i + int(j)) for j in np.flatnonzero((gap**2).sum(axis=1) <= 1)]
    return cells, parts, near


def _boxes(x: np.ndarray, lo: int, hi: int, out: dict) -> None:
    part = x[lo:hi]
    out[lo, hi] = part.min(axis=0), part.max(axis=0)
    if hi - lo > LEAF:
        mid = (lo + hi) // 2
        _boxes(x, lo, mid, out)
        _boxes(x, mid, hi, out)


def _join(axes, eps: float, cosine: float):
    def pairs(a: tuple[int, int], b: tuple[int, int], boxes_a: dict, boxes_b: dict, same: bool):
        """Leaf intervals that may hold links."""
        (low_a, high_a), (low_b, high_b) = boxes_a[a], boxes_b[b]
        gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
        if (gap * gap).sum() > eps * eps * (1 + 1e-9):
            return
        size_a, size_b = a[1] - a[0], b[1] - b[0]
        if max(size_a, size_b) <= LEAF:
            yield a, b
        elif same and a == b:
            mid = (a[0] + a[1]) // 2
            left, right = (a[0], mid), (mid, a[1])
            for x, y in ((left, left), (left, right), (right, right)):
                yield from pairs(x, y, boxes_a, boxes_b, same)
        elif size_a >= size_b:
            mid = (a[0] + a[1]) // 2
            for x in ((a[0], mid), (mid, a[1])):
                yield from pairs(x, b, boxes_a, boxes_b, same)
        else:
            mid = (b[0] + b[1]) // 2
            for y in ((b[0], mid), (mid, b[1])):
                yield from pairs(a, y, boxes_a, boxes_b, same)

    def run(group: pa.Table) -> pa.Table:
        rotation = axes.value
        group = group.combine_chunks()
        column = group.column("embedding").combine_chunks()
        size = column.value_lengths().to_numpy(zero_copy_only=False)
        unit = _unit(_matrix(column, len(rotation)))
        x = unit @ rotation[:, :BOX_DIMS]
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))  # lengths of what other axes hold differ by no more than the vectors
        x = np.column_stack((x, rest))
        grid = np.floor(x[:, :DIMS] / eps)
        side = group.column("side").to_numpy()
        order = np.lexsort((*[x[:, k] for k in reversed(range(DIMS, x.shape[1]))][-8:], *[grid[:, k] for k in reversed(range(grid.shape[1]))], side))
        unit, x, side, size = unit[order], x[order], side[order], size[order]
        ids, keys, copies = (group.column(c).to_numpy()[order] for c in ("rep", "h1", "copies"))
        single = unit.astype(np.float32)
        n, same = len(ids), bool((side == 0).any())
        begin = 0 if same else int((side == 1).sum())
        links, label, forest = np.zeros(n, np.int64), np.arange(n), []
        if same or 0 < begin < n:
            boxes_a: dict = {}
            _boxes(x, 0, n if same else begin, boxes_a)
            boxes_b = boxes_a
            if not same:
                boxes_b = {}
                _boxes(x, begin, n, boxes_b)
            whole_a, whole_b = ((0, n), (0, n)) if same else ((0, begin), (begin, n))
            for (a0, a1), (b0, b1) in pairs(whole_a, whole_b, boxes_a, boxes_b, same):
                rows, cols = np.nonzero(single[a0:a1] @ single[b0:b1].T >= cosine - 1e-4)
                if same and a0 == b0:
                    rows, cols = rows[rows < cols], cols[rows < cols]
                rows, cols = rows + a0, cols + b0
                keep = [np.zeros(0, bool)]
                for k in range(0, len(rows), 32768):
                    r, c = rows[k : k + 32768], cols[k : k + 32768]
                    keep.append(((unit[r] * unit[c]).sum(axis=1) >= cosine) & (size[r] == size[c]))
                keep = np.concatenate(keep)
                rows, cols = rows[keep], cols[keep]
                np.add.at(links, rows, copies[cols])
                np.add.at(links, cols, copies[rows])
                edge = np.flatnonzero(np.diff(rows, prepend=-1, append=-1)) if len(rows) else []
                for k0, k1 in zip(edge[:-1], edge[1:], strict=True):
                    i, hits = rows[k0], cols[k0:k1]
                    for other, at in zip(*np.unique(label[hits], return_index=True), strict=True):
                        if other != label[i]:
                            forest.append((i, hits[at]))
                            label[label == other] = label[i]
        some = np.flatnonzero(links)
        f = np.array(forest, np.int64).reshape(-1, 2)
        nothing = lambda k: pa.nulls(k, pa.int64())
        a = pa.concat_arrays([pa.array(ids[some]), pa.array(ids[f[:, 0]])])
        return pa.table({
            "a": a,
            "b": pa.concat_arrays([nothing(len(some)), pa.array(ids[f[:, 1]])]),
            "h1": pa.concat_arrays([pa.array(keys[some]), nothing(len(f))]),
            "n": pa.concat_arrays([pa.array(links[some]), nothing(len(f))]),
        })

    return run


def cosine_components(vectors: DataFrame, cosine: float = 0.9, block: int = 8192) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows of cosine at least ``cosine``; ``component_id`` is the least vec_id
    reachable over links, ``kept`` whether it is the row's own. Equal vectors are one class, compared once.
    Vectors that are null, empty, zero, hold null or non-finite components, or have no vec_id link with
    nothing, as do vectors of different length with each other. Rows that repeat a vec_id are one node of
    the graph, each with its own n_links. An empty table gives an empty result.

    At most ``(2 / eps + 4) ** DIMS`` cell counts come to the driver, and as many rows go out again to tell each
    cell's interval. Of intervals there are at most as many as cells and as the input has blocks; their pairs
    are listed on the driver, at cosine 0.9 at most 0.84 million (1,296 cells that unit vectors reach), and
    grow with the square of the cells as the cosine nears 1. They are broadcast only where they are few. A vector goes to as many tasks as there are intervals near its own, in dense spaces all:
    the rows dealt out grow with the square of the input over ``block``.
    """
    spark = vectors.sparkSession
    x, e = F.col("embedding"), math.sqrt(2 - 2 * cosine)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(x, lambda v: v != 0)
    base = vectors.select("vec_id", F.when(F.coalesce(valid, F.lit(False)), x).alias("embedding")).withColumns({"h1": F.xxhash64(x), "h2": F.xxhash64(x, F.lit(1))})
    classes = materialize(base.where("embedding IS NOT NULL").groupBy("h1", "h2", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    zero = F.lit(0).cast("long")
    if width is None:
        return base.select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    axes = spark.sparkContext.broadcast(principal_axes(classes, width))
    cells_of, side = _cells(axes, e)
    kind = classes.schema["embedding"].dataType.simpleString()
    celled = materialize(classes.select("rep", "h1", "copies", "embedding").mapInArrow(cells_of, f"rep long, h1 long, copies long, embedding {kind}, cell long"))
    counts = [(r.cell, r["count"]) for r in celled.groupBy("cell").count().collect()]
    cells, parts, near = _intervals(counts, side, min(DIMS, width), block)
    intervals = spark.createDataFrame([(c, g, parts[g]) for c, g in cells], "cell long, interval int, parts int")
    both = [(i, i, j, parts[j], 0 if i == j else 1) for i, j in near] + [(j, i, j, parts[i], 2) for i, j in near if i != j]
    partners = materialize(spark.createDataFrame(both, "interval int, i int, j int, other int, side int"))
    placed = celled.join(F.broadcast(intervals), "cell").withColumn("s", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int"))
    placed = join_sized(placed, partners, ["interval"]).select("rep", "h1", "copies", "embedding", "s", F.struct("i", "j", "other", "side").alias("p"))
    placed = placed.select("rep", "h1", "copies", "embedding", "s", "p", F.explode(F.sequence(F.lit(0), F.col("p.other") - 1)).alias("t"))
    own = F.col("p.side") == 0
    turned = (own & (F.col("s") > F.col("t"))) | (F.col("p.side") == 2)
    role = F.when(own & (F.col("s") == F.col("t")), 0).when(turned, 2).otherwise(1)
    tasks = placed.select(
        "rep", "h1", "copies", "embedding", role.alias("side"), F.col("p.i").alias("gi"), F.col("p.j").alias("gj"),
        F.when(turned, F.col("t")).otherwise(F.col("s")).alias("si"), F.when(turned, F.col("s")).otherwise(F.col("t")).alias("sj"),
    )
    joined = materialize(tasks.groupBy("gi", "gj", "si", "sj").applyInArrow(_join(axes, e, cosine), "a long, b long, h1 long, n long"))
    links = joined.where("n IS NOT NULL").groupBy(F.col("a").alias("rep"), "h1").agg(F.sum("n").alias("n"))
    component = connected_components(joined.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "rep")
    table = classes.select("h1", "h2", "rep", "copies").join(links, ["rep", "h1"], "left").join(component, "rep", "left")
    table = materialize(table.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", zero)).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    some = F.col("embedding").isNotNull()
    keyed = base.select("vec_id", F.when(some, F.col("h1")).otherwise(F.xxhash64("vec_id")).alias("h1"), F.when(some, F.col("h2")).alias("h2"))
    found = keyed.join(table, ["h1", "h2"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(False)).alias("kept"))
