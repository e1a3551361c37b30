"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become token pieces inside tasks. Pieces are packed best-fit, longest first, in groups of bounded
size; nearly full sequences are emitted, the others go on as items, several groups together, to further
best-fit rounds, until a round joins too little. A residual sequence carries its pieces, so that no round
looks anything up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.llm.hashing import KEPT, give_back, text_slices
from trackfix.llm.token_ids import TokenTable
from trackfix.session import materialize

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBERS = "array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long>>"


def _tokenize(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = KEPT[tokenizer] = KEPT.get(tokenizer) or TokenTable(tokenizer)
        end = np.array([end_id], np.uint32)
        for some, texts in text_slices(batches, lambda b: b.column(1)):
            rows = []
            for doc, ids in zip(some.column(0).to_pylist(), table.encode([t or "" for t in texts]), strict=True):
                ids = np.concatenate((ids, end)).astype("<u4", copy=False)
                total = len(ids)
                piece, begin, stop = 0, 0, total % capacity or min(total, capacity)
                while begin < total:
                    rows.append((doc, piece, begin, stop - begin, zlib.crc32(ids[begin:stop])))
                    piece, begin, stop = piece + 1, stop, stop + capacity
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back(keep=True)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32)`` of every row's text and ``end_id``.

    A document of more than ``capacity`` tokens is cut from its end, so that only its first piece is shorter.
    """
    return docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, capacity, end_id), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set where a bin with space s waits
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
            bins[b].append(i)
        else:
            b, space = len(bins), capacity
            bins.append([i])
        if space > n:
            by_space[space - n].append(b)
            spaces |= 1 << (space - n)
    return bins


def _pack(capacity: int, full: int, level: int):
    """Packs one partition's items; ``done`` marks sequences of at least ``full`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        fill, members = [], []
        for batch in batches:
            fill += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
        part = TaskContext.get().partitionId()
        bins = best_fit(fill, capacity)
        for lo in range(0, len(bins), 5000):
            some = bins[lo : lo + 5000]
            fills = [sum(fill[i] for i in b) for b in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(level << 56) | (part << 32) | (lo + k) for k in range(len(some))], pa.int64()),
                    pa.array(fills, pa.int32()),
                    pa.array([f >= full for f in fills], pa.bool_()),
                    pa.array([[m for i in b for m in members[i]] for b in some], MEMBER_TYPE),
                ],
                names=["sequence_id", "fill", "done", "members"],
            )

    return run


MEMBER_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group: int = 60_000, full: float = 0.999, gain: float = 0.002) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A task packs at most about ``group`` items. Sequences filled to ``full`` of ``capacity`` are emitted; the
    others are dealt anew to a quarter as many tasks (or as many as ``group`` asks for) and packed again, until
    one task has packed all that were left or a round joins less than ``gain`` of them. Null and empty texts
    are ``end_id`` alone. Strings of the tokenizer's added tokens get those tokens' ids. Every row of ``docs`` is packed, rows with equal doc_id each for itself; an empty
    table gives an empty result.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id))
    whole = f"array(struct({', '.join(x.split()[0] for x in PIECES.split(', '))}))"
    items = pieces.select(F.col("length").alias("fill"), F.expr(whole).alias("members"))
    schema = f"sequence_id long, fill int, done boolean, members {MEMBERS}"
    count, level, finished = items.count(), 0, []
    tasks = max(1, -(-count // group))
    while True:
        packed = materialize(items.repartition(tasks).mapInArrow(_pack(capacity, int(capacity * full), level), schema))
        left, total = packed.where("NOT done").count(), packed.count()
        if tasks == 1 or left == 0 or (level and count - total < gain * count):
            finished.append(packed)
            break
        finished.append(packed.where("done"))
        items, count, level = packed.where("NOT done").select("fill", "members"), left, level + 1
        tasks = max(-(-left // group), -(-tasks // 4))
    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    lengths = F.transform("members", lambda m: m["length"].cast("long"))
    placed = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("offset")))
    m = F.col("p.m")
    return result.select("sequence_id", F.explode(placed).alias("p")).select(
        m["doc_id"].alias("doc_id"), m["piece"].alias("piece"), m["start"].alias("start"), m["length"].cast("long").alias("length"),
        m["ids_crc32"].alias("ids_crc32"), "sequence_id", F.col("p.offset").alias("offset"),
    )
