"""Document fingerprints by content-defined chunking.

A gear hash over the last ``WINDOW`` characters marks cut points: rare marks count up to the normal chunk
length, frequent ones beyond it (normalised chunking), between a least and a most length. As cuts depend on
the text around them alone, an edit changes the chunks that it touches and no others. The set of chunk
digests, each weighing its length, is the fingerprint; two texts are as alike as the heavier share of the
lighter one's chunks that the other holds.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfix.llm.hashing import batches as slices
from trackfix.llm.hashing import mix, span_hashes

WINDOW, LEAST, NORMAL, MOST = 8, 12, 32, 128
RARE_BITS, FREQUENT_BITS = 6, 4
_GEAR = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunk_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct chunks of each text as sorted numbers: 40 bits of digest, 8 bits of length."""
    lengths = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _GEAR[flat & 0xFFFF] + (flat >> np.uint32(16))
    h, w = symbols.astype(np.uint32), 1
    while w < WINDOW:  # a window twice as long each time
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    frequent = np.flatnonzero(h >> np.uint32(32 - FREQUENT_BITS) == 0) + 1
    rare = frequent[h[frequent - 1] >> np.uint32(32 - RARE_BITS) == 0].tolist()
    frequent = frequent.tolist()
    starts: list[int] = []
    counts: list[int] = []
    end = 0
    for n in lengths.tolist():
        at, end, before = end, end + n, len(starts)
        while at < end:
            starts.append(at)
            if end - at <= LEAST:
                break
            i = bisect_left(rare, at + LEAST)
            if i < len(rare) and rare[i] < at + NORMAL:
                at = rare[i]
                continue
            i = bisect_left(frequent, at + NORMAL)
            at = min(frequent[i] if i < len(frequent) else end, at + MOST)
        counts.append(len(starts) - before)
    first = np.array(starts, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    stop = np.minimum(np.append(first[1:], len(flat)), np.cumsum(lengths)[owner]) if len(first) else first
    value = (span_hashes(symbols, first, stop) >> np.uint64(24) << np.uint64(8)) | (stop - first).astype(np.uint64)
    return [np.unique(x) for x in np.split(value, np.cumsum(counts)[:-1])] if texts else []


def as_string(chunks: np.ndarray) -> str:
    """Eight characters a chunk, by digest; empty for an empty text."""
    return base64.urlsafe_b64encode(chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.urlsafe_b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).view(">u8").reshape(-1).astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Length of the shared chunks over that of the shorter set; 1 for two empty sets, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    byte = np.uint64(255)
    common = np.intersect1d(a, b, assume_unique=True)
    return int((common & byte).sum()) / min(int((a & byte).sum()), int((b & byte).sum()))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holds each row of a sorted partition against the one after it; ghost rows only end the partition."""
    waiting: tuple[int | None, str, np.ndarray] | None = None
    ended = False
    for batch in batches:
        ids, ghosts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
        for lo, hi in slices(texts):
            sets = chunk_sets(texts[lo:hi])
            chain = ([waiting] if waiting else []) + list(zip(ids[lo:hi], texts[lo:hi], sets, strict=True))
            own = ([False] if waiting else []) + ghosts[lo:hi]
            if ended:
                continue
            pairs = [(x, y) for x, y, g in zip(chain[:-1], chain[1:], own[:-1], strict=True) if not g]
            ended = own[-1]
            waiting = chain[-1]
            edited = [x[1][: len(x[1]) - len(x[1]) // 3] + y[1][: len(x[1]) // 3] for x, y in pairs]
            edited_sets = [s for a, b in slices(edited) for s in chunk_sets(edited[a:b])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                    pa.array([as_string(x[2]) for x, _ in pairs], pa.string()),
                    pa.array([as_string(s) for s in edited_sets], pa.string()),
                    pa.array([containment(x[2], s) for (x, _), s in zip(pairs, edited_sets, strict=True)], pa.float64()),
                    pa.array([containment(x[2], y[2]) for x, y in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _place(key: Column, heads: list[int]) -> Column:
    """How many of the sorted ``heads`` are below ``key``, by bisection in an expression."""
    table, n = F.array(*[F.lit(h) for h in heads]), len(heads)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    step = lambda at, s: F.when(F.coalesce(F.get(table, at + s - 1) < key, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    Rows follow each other by descending doc_id, null last, rows of one doc_id by ascending text; after the
    last comes the first. The edited text has the last third of the code points replaced by as many of the
    next row's first (or all of them). Null text is empty; an empty text has an empty fingerprint. A row
    that is alone is its own next. An empty table gives an empty result.

    A first pass over the ids alone finds the ranges of ids; the text is then dealt out once by range, and
    the row that begins a range goes, as a ghost, to the range before it as well. Only one id per shuffle
    partition comes to the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(lowest))
    ranged = docs.select(key.alias("key")).repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("head"))
    heads = sorted({r.head for r in ranged.collect()}) or [0]
    at = _place(F.col("key"), heads)
    is_head = F.coalesce(F.get(F.array(*[F.lit(h) for h in heads]), F.col("own")) == F.col("key"), F.lit(False))
    placed = docs.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("own", at)
    place = lambda p, ghost: F.struct(p.alias("part"), F.lit(ghost).alias("ghost"))
    own = place(F.col("own"), False)
    both = F.when(is_head, F.array(own, place(F.pmod(F.col("own") + 1, F.lit(len(heads))).cast("int"), True))).otherwise(F.array(own))
    dealt = placed.select("doc_id", "key", "text", F.explode(both).alias("to")).select("doc_id", "key", "text", "to.part", "to.ghost")
    sorted_rows = dealt.repartitionById(len(heads), F.col("part")).sortWithinPartitions("part", "ghost", F.col("key").desc(), "text")
    return sorted_rows.select("doc_id", "ghost", "text").mapInArrow(
        _neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
