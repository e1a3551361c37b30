"""Word shingles of whole texts as 64-bit features."""

from __future__ import annotations

import numpy as np

from trackfix.llm.hashing import BYTES, mix, salted, span_hashes

#: Words are maximal runs of ASCII letters, digits and bytes of other characters, lower-cased.
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of the text of each."""
    data = [(t or "").lower().encode() for t in texts]
    sizes = np.array([len(d) + 1 for d in data])
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = _WORD[flat]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return span_hashes(BYTES[flat], starts, ends), np.searchsorted(np.cumsum(sizes), starts, side="right")


def features(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(feature, text number)`` sorted by text: one feature for each occurrence of an ``n``-word shingle.

    The m-th occurrence of a shingle in a text is a feature of its own, so that the Jaccard similarity of
    two feature sets is the weighted Jaccard similarity of the shingle counts. A text of 1 to n-1 words is
    one shingle; a text without words has none.
    """
    words, owner = word_hashes(texts)
    if not len(words):
        return words, owner
    total = len(words)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = np.arange(total) - first[owner]
    left = count[owner] - place
    key = np.zeros(total, np.uint64)
    for j in range(n):
        part = np.zeros(total, np.uint64)
        part[: total - j] = words[j:]
        part[left <= j] = 0
        key += salted(part, j)
    key = mix(key)
    keep = (left >= n) | (place == 0)
    key, owner = key[keep], owner[keep]
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return salted(key, 100) + salted((np.arange(len(key)) - begin).astype(np.uint64), 101), owner
