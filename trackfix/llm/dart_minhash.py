"""MinHash near-duplicates by DartMinHash signatures, banded joining and exact verification.

Every feature of a text (an occurrence of a five-word shingle) is a region of unit weight. Hashed darts
fall on it as a Poisson process over (region, rank), and each dart names one of ``K`` coordinates; the
earliest rank per coordinate is the text's signature. About ``K ln K + 2 K`` darts a text do, whatever
its length: a long text looks only at low ranks, and a text that leaves a coordinate empty looks further.

Signatures are joined in bands, one text of each class of equal shingle counts. First every text of a bucket
is held exactly against the bucket's least one, so that a group of near copies, however large, is settled by
as many comparisons as it has members. Only buckets whose texts are not of one component by then go on: what
they connect make up candidate groups, and inside a group texts that share any band are held against each
other exactly, in blocks of bounded size. A task reports a spanning forest of its links, which gives the same
components as all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.llm.hashing import batches, give_back, mix, salted, text_slices
from trackfix.llm.shingles import features
from trackfix.operators.components import connected_components
from trackfix.session import join_sized, materialize

ROWS, BANDS = 7, 36
K = ROWS * BANDS
#: Characters whose shingles take as much memory as the darts of a text, which it needs however short it is.
DARTS = 8000
#: Of a Poisson variable of mean 1: P(count <= c), as thresholds of a uint64 hash.
_POISSON = np.array([int(min(p, 1.0) * ((1 << 64) - 1)) for p in np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))], np.uint64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FRACTION = np.uint64(24)


def _throw(best: np.ndarray, key: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> None:
    """Throw the darts of rank blocks ``low <= q < high`` of each feature; ``limit`` cuts ranks within a text's last block."""
    n = high - low
    at = np.repeat(np.arange(len(key)), n)
    q = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)).astype(np.uint64)
    seed = mix(key[at] + q * np.uint64(0xD6E8FEB86659FD93))
    count = np.searchsorted(_POISSON, seed, side="left")
    dart = np.repeat(np.arange(len(seed)), count)
    c = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
    h = salted(seed[dart] + c.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 7)
    rank = (q[dart] << np.uint64(40)) | (h >> _FRACTION)
    coordinate = ((h & np.uint64(0xFFFFFF)) * np.uint64(K)) >> _FRACTION
    where = row[at[dart]]
    near = rank <= limit[where]
    np.minimum.at(best.reshape(-1), where[near] * K + coordinate[near].astype(np.int64), rank[near])


def signatures(key: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """``K`` earliest ranks of each text, and which texts have features at all."""
    size = np.bincount(owner, minlength=texts)
    best = np.full((texts, K), _NONE, np.uint64)
    reach = (K * np.log(K) + 2 * K) / np.maximum(size, 1)
    done = np.zeros(texts)
    todo = size > 0
    while todo.any():
        use = todo[owner]
        blocks = np.ceil(reach)
        limit = np.where(reach < 1, reach * (1 << 40), blocks * (1 << 40)).astype(np.uint64)
        _throw(best, key[use], owner[use], np.floor(done)[owner[use]].astype(np.int64), blocks[owner[use]].astype(np.int64), limit)
        done = np.where(reach < 1, 0, blocks)
        todo &= (best == _NONE).any(axis=1)
        reach = np.where(todo, np.where(reach < 1, reach, blocks) * 2, reach)
    return best, size > 0


def _sketch(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch, texts in text_slices(batches_in, lambda b: b.column("text"), each=DARTS):
        key, owner = features(texts)
        best, some = signatures(key, owner, len(texts))
        size = np.bincount(owner, minlength=len(texts))
        sums = []
        for salt in (11, 12):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(salted(key, salt))))
            end = np.cumsum(size)
            sums.append((total[end] - total[end - size]).view(np.int64))
        band = np.zeros((len(texts), BANDS), np.uint64)
        for r in range(ROWS):
            band = mix(band + best[:, r::ROWS])
        band = salted(band + np.arange(BANDS, dtype=np.uint64), 13).view(np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "t")), *map(pa.array, sums), pa.array(size), pa.ListArray.from_arrays(offsets, pa.array(band[some].reshape(-1)))],
            names=["doc_id", "t", "h1", "h2", "n_features", "bands"],
        )
    give_back()


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, h1, h2, n_features, bands)`` of every row; equal ``h1, h2`` mean equal shingle counts, ``t`` is a hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_sketch, f"doc_id {kind}, t long, h1 long, h2 long, n_features long, bands array<long>")


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct ones share."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def _exact_links(threshold: float):
    """Links of one task's groups, as a spanning forest on top of what is known already.

    Rows of a group are of sides: those of side 0 are held against each other, those of side 1 against those of
    side 2, where they share a band and are not yet connected. ``known`` is equal for what is.
    """

    def links(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.lexsort((group.column("side").to_numpy(), group.column("grp").to_numpy()))))  # side 1 before side 2
        grp, sides, known = (group.column(c).to_numpy() for c in ("grp", "side", "known"))
        text = group.column("text")
        bands = np.stack(group.column("bands").to_numpy()) if len(grp) else np.zeros((0, BANDS), np.int64)
        out: list[tuple[int, int]] = []
        cut = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
        for begin, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if end - begin < 2:
                continue
            texts = text.slice(begin, end - begin).to_pylist()
            sets: list[np.ndarray] = []
            for lo, hi in batches(texts):
                key, owner = features(texts[lo:hi])
                sets += [np.sort(s) for s in np.split(key, np.cumsum(np.bincount(owner, minlength=hi - lo))[:-1])]
            side, own, parent, first = sides[begin:end], bands[begin:end], list(range(end - begin)), {}
            for i, c in enumerate(known[begin:end].tolist()):
                parent[i] = first.setdefault(c, i)
            size = np.array([len(s) for s in sets])
            shared = [np.zeros((0, 3), np.int64)]
            for i in range(end - begin - 1):
                if side[i] == 2:
                    continue
                other = np.flatnonzero(side[i + 1 :] != side[i]) + i + 1 if side[i] else np.arange(i + 1, end - begin)
                other = other[np.minimum(size[other], size[i]) >= threshold * np.maximum(size[other], size[i])]
                same = (own[other] == own[i]).sum(axis=1)
                hit = same > 0
                shared.append(np.stack((same[hit], np.full(hit.sum(), i), other[hit]), axis=1))
            pairs = np.concatenate(shared)
            for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
                a, b = _find(parent, i), _find(parent, j)
                if a == b:
                    continue
                common = _common(sets[i], sets[j])
                if common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    parent[a] = b
                    out.append((begin + i, begin + j))
        ends = np.array(out, np.int64).reshape(-1, 2)
        give_back()
        return pa.table({c: group.column("node").take(pa.array(ends[:, k])).combine_chunks() for k, c in enumerate("ab")})

    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, block: int = 500, block_features: int = 1_000_000) -> DataFrame:
    """``(doc_id, class_id, component_id, kept)`` of every distinct doc_id of ``docs`` (columns doc_id, text).

    ``class_id`` is the least doc_id with the same shingle counts, ``component_id`` the least doc_id reachable
    over links of weighted Jaccard similarity of at least ``threshold``, ``kept`` whether it is this one.
    A text that is null or without words links with nothing. Rows that repeat a doc_id are one document,
    linked by any of its texts, and equal rows are compared once; a null doc_id gets no row. An empty table
    gives an empty result. ``doc_id`` is of any orderable type, a struct of fields that are never null included.

    A task compares blocks of about ``block`` texts and ``block_features`` shingles; a longer text is a block
    of its own.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    sketch = materialize(sketches(docs))
    some = sketch.where("n_features > 0")
    least = F.min(F.struct("doc_id", "t")).alias("least")
    classes = some.groupBy("h1", "h2").agg(least, F.first("n_features").alias("n_features"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("h1", "h2", F.col("least.doc_id").alias("node"), F.col("least.t").alias("t"), "n_features", "bands"))
    member = materialize(some.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", F.col("node").alias("class_id")), ["h1", "h2"]).select("doc_id", "class_id"))
    links = _links(docs, classes, threshold, block, block_features)
    several = member.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("last")).where("b < last").select("doc_id", "b")
    texts_of_one = member.join(several, "doc_id").select(F.col("class_id").alias("a"), "b").where("a <> b").distinct()
    component = materialize(connected_components(links.unionByName(texts_of_one), "a", "b"))
    own = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = sketch.select("doc_id").distinct().join(own, "doc_id", "left")
    found = ids.join(component.withColumnRenamed("node", "class_id"), "class_id", "left")
    component_id = F.coalesce("component", "class_id", "doc_id")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), component_id.alias("component_id"), (component_id == F.col("doc_id")).alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, threshold: float, block: int, block_features: int) -> DataFrame:
    """A spanning forest ``(a, b)`` of all links between classes that share a band."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub")
    shared = materialize(banded.join(hubs, "band").select("node", "band", "hub"))
    wanted = materialize(shared.select("node").distinct().join(classes.select("node", "t", "n_features", "bands"), "node"))
    keyed = docs.select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("t"), "text").groupBy("node", "t").agg(F.min("text").alias("text"))
    texts = join_sized(keyed, materialize(wanted.select("node", "t").distinct()), ["node", "t"], "left_semi")
    texts = materialize(texts.join(wanted, ["node", "t"]))
    size = texts.groupBy("node").agg(F.sum("n_features").alias("n"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / block_features)).cast("int").alias("blocks")
    number = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), n).cast("int")

    def compared(placed: DataFrame) -> DataFrame:
        """Links of ``placed`` (node, n, known, grp, side, blocks); groups of one block share tasks."""
        placed = materialize(placed)
        rows, features_ = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        tasks = max(1, -(-rows // block), -(-features_ // block_features))
        task = F.when(F.col("blocks") > 1, F.col("grp")).otherwise(F.pmod("grp", F.lit(tasks)))
        given = placed.select("node", "known", "grp", "side", task.alias("task")).join(texts, "node")
        kind = classes.schema["node"].dataType.simpleString()
        return materialize(given.select("node", "known", "grp", "side", "task", "bands", "text").groupBy("task").applyInArrow(_exact_links(threshold), f"a {kind}, b {kind}"))

    star = materialize(shared.where("node <> hub").select("node", "hub").distinct().join(size, "node"))
    parts = materialize(star.groupBy("hub").agg(blocks))
    spoke = join_sized(star, parts, ["hub"]).select("node", "n", "hub", "blocks", number("node", F.col("blocks")).alias("part"), F.lit(2).alias("side"))
    hub = parts.select(F.col("hub").alias("node"), F.lit(0).cast("long").alias("n"), "hub", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("side"))
    of_hubs = compared(spoke.unionByName(hub).select("node", "n", F.xxhash64("node").alias("known"), F.xxhash64("hub", "part").alias("grp"), "side", "blocks"))

    proven = materialize(connected_components(of_hubs, "a", "b"))
    known = F.coalesce("component", "node")
    labelled = materialize(shared.join(proven, "node", "left").select("node", "band", "hub", known.alias("component")))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one < other").select("band")
    rest = materialize(labelled.join(mixed, "band").select("node", "hub", "component").distinct())
    if rest.isEmpty():
        return of_hubs
    group = connected_components(rest.where("node <> hub"), "node", "hub").select("node", F.col("component").alias("g"))
    group = materialize(group.join(rest.select("node", "component").distinct(), "node").join(size, "node"))
    parts = materialize(group.groupBy("g").agg(blocks))
    placed = join_sized(group, parts, ["g"]).withColumn("own", number("node", F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    of_groups = compared(placed.select("node", "n", F.xxhash64("component").alias("known"), F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), side.alias("side"), "blocks"))
    return of_hubs.unionByName(of_groups)
