"""Exact removal of repeated byte strings of a given length, by distributed prefix doubling.

Positions are sorted by pairs of ranks at growing offsets, and each round keeps only positions whose rank is
shared. The first round's positions are a sample that the content chooses: of the strings of ``SAMPLE`` bytes
inside a window of ``length`` bytes, the one of least hash stands for the window, so that equal windows are
stood for by equal strings at equal places. Windows in a row that one string stands for are a run.

1. Sampled positions are sorted by the pair of ranks of their two halves, then by their run's bytes: a string
   of its own ends all its windows; a run whose bytes came before is a repeat; strings with different runs go on.
2. Of these, only the first run of each kind is cut into blocks of ``BLOCK`` windows, which are sorted likewise: by
   the string that all windows of the block share, ``length - BLOCK + 1`` bytes, then by the block's bytes.
3. Windows of blocks that still differ are sorted by the pair of ranks of their two halves, at offset length / 2:
   all but the first of each pair are repeats.

Ranks of strings up to half the length are 64-bit fingerprints, and a position's rank is a pair of them. A
corpus whose texts are copies goes no further than the first round with all but one of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.llm.hashing import BYTES, POWERS, give_back, mix, salted
from trackfix.llm.hashing import batches as slices
from trackfix.session import materialize

LENGTH, SAMPLE, BLOCK = 100, 48, 8
#: Bits of a run's packed place below its start: windows, place of its string after the start, windows into its parent.
BITS = 6
OWN = (1 << BITS) - 1
RUNS = "k long, c long, o long, tie long, place long"


def _pack(at, n, d, j=0):
    return ((at << 3 * BITS) | (n << 2 * BITS)) | ((d << BITS) | j)


def _unpack(place: np.ndarray) -> list[np.ndarray]:
    return [place >> 3 * BITS, place >> 2 * BITS & OWN, place >> BITS & OWN, place & OWN]


class Ranks:
    """Fingerprints of the strings of a row of bytes."""

    def __init__(self, flat: np.ndarray) -> None:
        up, self.down = POWERS.upto(len(flat) + 1)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(BYTES[flat] * up[:-1], out=self.sums[1:])

    def of(self, at: np.ndarray, n: int | np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.down[at] + salted(np.asarray(salt, np.uint64).reshape(-1), 7))


def sampled_runs(data: list[bytes], length: int, sample: int) -> tuple[np.ndarray, ...]:
    """``(text, k, c, at, n, d)`` of the runs of all texts in order: text number, rank of the sampled string, rank
    of the run's bytes, first window (in its text), windows, and where the string lies after the first window's start."""
    size = np.array([len(x) for x in data])
    ends = np.cumsum(size)
    flat = np.frombuffer(b"".join(data), np.uint8)
    windows = len(flat) - length + 1
    none = np.zeros(0, np.int64)
    if windows < 1:
        return (none, none.view(np.uint64), none.view(np.uint64), none, none, none)
    ranks, half = Ranks(flat), sample // 2
    part = ranks.of(np.arange(len(flat) - half + 1), half)
    least = mix(part[: len(flat) - sample + 1] + salted(part[sample - half :].copy(), 1))
    whole = least
    spot, reach, width = np.arange(len(least)), 1, length - sample + 1
    while 2 * reach <= width:
        right = least[reach:] < least[:-reach]
        least, spot = np.where(right, least[reach:], least[:-reach]), np.where(right, spot[reach:], spot[:-reach])
        reach *= 2
    rest = width - reach
    right = least[rest : rest + windows] < least[:windows]
    spot = np.where(right, spot[rest : rest + windows], spot[:windows])
    inside = np.zeros(len(flat) + 1, np.int8)
    some = size >= length
    inside[(ends - size)[some]] = 1
    np.subtract.at(inside, (ends - length + 1)[some], 1)
    at = np.flatnonzero(np.cumsum(inside[:windows], dtype=np.int8))
    if not len(at):
        return (none, none.view(np.uint64), none.view(np.uint64), none, none, none)
    spot = spot[at]
    head = np.flatnonzero(np.diff(spot, prepend=-1) | (np.diff(at, prepend=-2) != 1))
    n = np.diff(np.append(head, len(at)))
    at, spot = at[head], spot[head]
    d = spot - at
    text = np.searchsorted(ends, at, side="right")
    return text, whole[spot], ranks.of(at, n - 1 + length, n << BITS | d), at - (ends - size)[text], n, d


def _sample(length: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, tie = (batch.column(i).to_numpy() for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts):
                text, k, c, at, n, d = sampled_runs([(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]], length, sample)
                order = np.lexsort((at, c, k, text))
                same = np.zeros(len(at), bool)
                t, a, b = text[order], k[order], c[order]
                same[order[1:]] = (t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                k[same] = salted(c[same] + at[same].astype(np.uint64), 3)  # repeats within a text need no partner
                d = np.where(same, OWN, d)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), c.view(np.int64), o[lo:hi][text], tie[lo:hi][text], _pack(at, n, d))], names=["k", "c", "o", "tie", "place"])
        give_back()

    return run


def _spans(length: int):
    """The bytes of the runs that go on, out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, tie, texts, runs = (batch.column(i) for i in range(4))
            row = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
            k, place = (runs.flatten().field(i).to_numpy() for i in (0, 1))
            data = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
            at, n, _, _ = _unpack(place)
            span = [data[r][a : a + m - 1 + length] for r, a, m in zip(row.tolist(), at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k), o.take(pa.array(row)), tie.take(pa.array(row)), pa.array(place), pa.array(span, pa.binary())], names=["k", "o", "tie", "place", "span"])
        give_back()

    return run


def _joined(spans: list[bytes]) -> tuple[Ranks, np.ndarray]:
    size = np.array([len(s) for s in spans], np.int64)
    return Ranks(np.frombuffer(b"".join(spans), np.uint8)), np.cumsum(size) - size


def _blocks(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, o, tie, place = (batch.column(i).to_numpy() for i in range(4))
            ranks, begin = _joined(batch.column(4).to_pylist())
            at, n, d, _ = _unpack(place)
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            number = (d[row] - j) // block
            head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
            m = np.diff(np.append(head, len(row)))
            row, j, number = row[head], j[head], number[head]
            after = d[row] - j
            c = ranks.of(begin[row] + j, m - 1 + length, m << BITS | after)
            shared = ranks.of(begin[row] + d[row] - block * number, length - block + 1, number)  # inside every window of the block
            name = salted(k[row].view(np.uint64) + shared, 5)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name.view(np.int64), c.view(np.int64), o[row], tie[row], _pack(at[row] + j, m, after, j))], names=["k", "c", "o", "tie", "place"])
        give_back()

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, tie, place = (batch.column(i).to_numpy() for i in range(3))
            ranks, begin = _joined(batch.column(3).to_pylist())
            at, n, _, j = _unpack(place)
            row = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            spot = begin[row] + j[row] + i
            one = np.ones(len(row), np.int64)
            left, right = ranks.of(spot, length // 2), ranks.of(spot + length // 2, length - length // 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (left.view(np.int64), right.view(np.int64), o[row], tie[row], _pack(at[row] + i, one, 0 * one))], names=["k", "c", "o", "tie", "place"])
        give_back()

    return run


def ranked(rows: DataFrame) -> DataFrame:
    """Runs sorted by the pair (k, c) and then by position; ``again``: not the first of its pair, else its k has other pairs.

    Runs that are the only kind of their k, and the first, drop out: nothing came before them.
    """
    by = Window.partitionBy("k").orderBy("c", "o", "tie", "place")
    group = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.shiftright("place", BITS).bitwiseAND(OWN) == OWN
    before = lambda name: F.lag(name).over(by)
    moved = (before("o") != F.col("o")) | (before("tie") != F.col("tie")) | (before("place") != F.col("place"))  # rows that repeat are one position
    follows = (before("c") == F.col("c")) & moved
    judged = rows.select("*", (F.coalesce(follows, F.lit(False)) | own).alias("again"), (F.first("c").over(group) != F.last("c").over(group)).alias("several"))
    return judged.where("again OR several").select("k", "o", "tie", "place", "again")


def repeated_windows(texts: DataFrame, length: int = LENGTH, sample: int = SAMPLE, block: int = BLOCK, copies: bool = False) -> DataFrame:
    """``(o, tie, at, n)``: rows of windows (starts ``at`` to ``at + n - 1``) of ``length`` bytes that also start earlier.

    ``texts`` has (o, tie, text); earlier means a smaller (o, tie), or the same and a smaller start. ``copies``:
    rows of ``texts`` may repeat; they are one text then.
    """
    assert 1 < sample < length and length - sample + 1 < OWN and length > 3
    first = materialize(ranked(texts.select("o", "tie", "text").mapInArrow(_sample(length, sample), RUNS)))
    goes_on = first.where("NOT again").groupBy("o", "tie").agg(F.collect_list(F.struct("k", "place")).alias("runs"))  # bounded by its text
    spans = texts.join(goes_on, ["o", "tie"]).select("o", "tie", "text", "runs").mapInArrow(_spans(length), "k long, o long, tie long, place long, span binary")
    spans = materialize(spans.dropDuplicates(["o", "tie", "place"]) if copies else spans)
    second = materialize(ranked(spans.mapInArrow(_blocks(length, block), RUNS)))
    start = F.shiftright("place", 3 * BITS)
    inner = second.where("NOT again").select("o", "tie", "place", (start - F.col("place").bitwiseAND(OWN)).alias("at"))
    outer = spans.select("o", "tie", start.alias("at"), "span")
    third = ranked(inner.join(outer, ["o", "tie", "at"]).select("o", "tie", "place", "span").mapInArrow(_windows(length), RUNS))
    found = [x.where("again").select("o", "tie", start.alias("at"), F.shiftright("place", 2 * BITS).bitwiseAND(OWN).alias("n")) for x in (first, second, third)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for at, n in sorted(zip(starts or (), counts or (), strict=True)):
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], at + n - 1 + length)
                    else:
                        spans.append([at, at + n - 1 + length])
                ends = [0, *[e for _, e in spans]]
                kept = b"".join(data[a:b] for a, b in zip(ends, [*[s for s, _ in spans], len(data)], strict=True))
                rows.append((len(data), len(data) - len(kept), [{"start": s, "end": e} for s, e in spans], kept))
            size, gone, spans, kept = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in (4, 5)], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "o", "tie", "n_bytes", "n_removed", "spans", "kept_sha256"])
        give_back()

    return run


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _ordered(docs: DataFrame, several: bool) -> DataFrame:
    """``docs`` with the order of its texts: ``o`` by doc_id, null last, and ``tie`` by text where doc_ids repeat."""
    last = F.lit((1 << 63) - 1)
    tie: Column = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(1))).otherwise(F.xxhash64("text") if several else F.lit(0).cast("long"))
    return docs.select("doc_id", F.coalesce("doc_id", last).alias("o"), tie.alias("tie"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What is left of every row of ``docs`` (doc_id, text) without the bytes of strings that came before.

    Texts are their UTF-8 bytes. A byte goes if a string of ``length`` bytes around it also starts earlier: in
    a smaller doc_id, or in its own text further left. Strings may overlap, never cross texts, and are judged on
    the input. Returns doc_id, n_bytes, n_removed, ``spans`` (structs of start, end in bytes: the maximal runs
    removed) and kept_sha256 of the bytes left.

    Null and empty texts keep their nothing; null doc_ids come last; texts that share a doc_id follow each other
    by hash, and of equal rows one comes first. Other columns are ignored; an empty table gives an empty result.
    """
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = not counts.isEmpty()
    texts = _ordered(docs, several)
    found = repeated_windows(texts, length, copies=several).groupBy("o", "tie").agg(F.collect_list("at").alias("starts"), F.collect_list("n").alias("counts"))  # bounded by its text
    cut = texts.join(found, ["o", "tie"], "left").select("doc_id", "text", "starts", "counts", "o", "tie").mapInArrow(
        _cut(length), "doc_id long, o long, tie long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    )
    if several:
        cut = cut.groupBy("doc_id", "o", "tie", "n_bytes", "n_removed", "spans", "kept_sha256").agg(F.count(F.lit(1)).alias("copies"))
        cut = cut.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        gone = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        cut = cut.withColumns({"n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")), "spans": F.when(gone, whole).otherwise(F.col("spans")), "kept_sha256": F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256"))})
    return cut.select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256")
