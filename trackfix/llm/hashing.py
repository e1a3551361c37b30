"""Vectorised 64-bit hashing used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_BASE, _BASE_INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser); overwrites and returns ``x``."""
    t = x >> np.uint64(30)
    x ^= t
    x *= _C1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _C2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """One of many independent hashes of uint64 values, named by a small number."""
    return mix(x + np.uint64((salt + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))


class Powers:
    """Powers of the base of polynomial hashes and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                    row = np.full(size, base, np.uint64)
                    row[0] = 1
                    setattr(self, name, np.multiply.accumulate(row))
        return self.up[:n], self.down[:n]


POWERS = Powers()
#: A random value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLD))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span ``values[start:end]`` of uint64 symbols, by differences of one prefix sum."""
    up, down = POWERS.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: What a worker keeps from one task for the next; tasks of another kind drop it.
KEPT: dict[str, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back(keep: bool = False) -> None:
    """Return the memory that Arrow and the allocator keep for later; called at a task's start or end, as workers outlive their tasks.

    Without ``keep``, what other tasks left in ``KEPT`` goes as well.
    """
    if not keep:
        KEPT.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _slices(lengths: list[int], size: int, each: int) -> Iterator[tuple[int, int]]:
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n + each > size:
            yield begin, i
            begin, total = i, 0
        total += n + each
    if begin < len(lengths):
        yield begin, len(lengths)


def batches(texts: list[str | None], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts of about ``size`` characters in all; a longer text comes alone."""
    return _slices([len(t) if t else 0 for t in texts], size, 0)


def text_slices(batches_in: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array], size: int = 1_000_000, each: int = 0) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of record batches, in order, with their texts as strings, which are made for one slice at a time.

    A slice's texts are of about ``size`` characters in all, each counting as ``each`` more; a longer text comes
    alone. Of the batches only the one at hand is held.
    """
    for batch in batches_in:
        column = text(batch)
        for lo, hi in _slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), size, each):
            yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist()
        del batch, column
