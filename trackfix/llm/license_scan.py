"""Licence scan: passages against licence templates by the Dice coefficient over word bigrams.

A passage is a line, cut after ``.``, ``!`` or ``?`` before a space. Text and templates are normalised to
lower-cased words (runs of ASCII letters, digits and other characters than ASCII). Passages that share no
bigram with any template drop out in one vectorised step; for the others, the Dice threshold t bounds the
number of bigrams of a template by n t / (2 - t) and n (2 - t) / t, and only templates within are compared.
Beyond that, windows of consecutive words are compared across passages, so that wrapped, embedded and long
texts are found; a place that has enough bigrams of a template close together anchors a window.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackfix.llm.hashing import BYTES, batches as slices
from trackfix.llm.hashing import salted, span_hashes
from trackfix.llm.shingles import _WORD

#: Sentences by which texts state their licence, and the licences' own texts or notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("reserved", "All rights reserved."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def passage_bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bigram, text number, passage, within)`` of all word bigrams of texts, line breaks or not.

    Passages with words are counted from 0 in each text; a bigram has that of its first word, and ``within``
    tells whether its second word is in it too.
    """
    data = [(t or "").lower().encode() for t in texts]
    flat = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = _WORD[flat]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    cut = flat == ord("\n")
    cut[:-1] |= _STOP[flat[:-1]] & (flat[1:] == ord(" "))
    part = np.cumsum(cut)[starts]
    owner = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    words = span_hashes(BYTES[flat], starts, ends)
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    order = np.cumsum(new) - 1
    begins = np.searchsorted(owner, np.arange(len(texts)))
    passage = order - (order[np.minimum(begins, len(order) - 1)][owner] if len(order) else 0)
    both = owner[1:] == owner[:-1]
    return (salted(words[:-1], 1) + salted(words[1:], 2))[both], owner[:-1][both], passage[:-1][both], ~new[1:][both]


class Templates:
    """Templates by number of bigrams."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        bigram, owner, _, _ = passage_bigrams([t for _, t in templates])
        sets = [(name, frozenset(bigram[owner == i].tolist())) for i, (name, _) in enumerate(templates)]
        self.sets = sorted((s for s in sets if s[1]), key=lambda s: (len(s[1]), s[0]))
        self.sizes, self.threshold = [len(s) for _, s in self.sets], threshold
        self.known = np.unique(bigram)
        self.members = [np.isin(self.known, np.fromiter(s, self.known.dtype, len(s))) for _, s in self.sets]

    def best(self, passage: frozenset[int]) -> tuple[float, str] | None:
        """The licence of the highest Dice coefficient of at least the threshold; the first by name on a tie."""
        n, t, found = len(passage), self.threshold, None
        low, high = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        for name, bigrams in self.sets[low:high]:
            dice = 2 * len(bigrams & passage) / (len(bigrams) + n)
            if dice >= t and (found is None or (-dice, name) < (-found[0], found[1])):
                found = dice, name
        return found

    def windows(self, bigram: np.ndarray, owner: np.ndarray) -> list[tuple[float, int, int, str]]:
        """``(dice, first, last, licence)`` of windows of consecutive bigrams of one text that are like a template.

        A window of n bigrams that is like a template of N has at least N t / (2 - t) of them and is no longer
        than N (2 - t) / t; it begins and ends with one of them. Of windows with the same start the best stays.
        Repeats in a window count towards its length, so that one may be longer where words repeat.
        """
        t, out = self.threshold, []
        at = np.minimum(np.searchsorted(self.known, bigram), len(self.known) - 1)
        hits = np.flatnonzero(self.known[at] == bigram)
        which = at[hits]
        for (name, bigrams), member in zip(self.sets, self.members, strict=True):
            mine = hits[member[which]]
            need, longest = math.ceil(len(bigrams) * t / (2 - t) - 1e-9), int(2 * len(bigrams) * (2 - t) / t + 1e-9)
            if len(mine) < need:
                continue
            first, last = mine[: len(mine) - need + 1], mine[need - 1 :]
            for lo in first[(last - first < longest) & (owner[first] == owner[last])].tolist():
                seen: set[int] = set()
                common, done, best = 0, lo, None
                for hi in mine[np.searchsorted(mine, lo) : np.searchsorted(mine, lo + longest)].tolist():
                    if owner[hi] != owner[lo]:
                        break
                    for x in bigram[done : hi + 1].tolist():
                        if x not in seen:
                            seen.add(x)
                            common += x in bigrams
                    done = hi + 1
                    dice = 2 * common / (len(bigrams) + len(seen))
                    if dice >= t and (best is None or dice > best[0]):
                        best = dice, lo, hi, name
                if best:
                    out.append(best)
        return out

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, str, float]]:
        """``(text number, passage, licence, dice)`` of every passage in which a licence is stated."""
        bigram, owner, passage, within = passage_bigrams(texts)
        if not len(bigram) or not len(self.known):
            return []
        inner = np.flatnonzero(within)
        found: dict[tuple[int, int, str], float] = {}
        claimed = np.zeros(len(bigram), bool)
        if len(inner):
            start = np.flatnonzero(np.concatenate(([True], (owner[inner][1:] != owner[inner][:-1]) | (passage[inner][1:] != passage[inner][:-1]))))
            at = np.minimum(np.searchsorted(self.known, bigram[inner]), len(self.known) - 1)
            some = np.add.reduceat(self.known[at] == bigram[inner], start) > 0
            stop = np.append(start[1:], len(inner))
            for lo, hi in zip(start[some].tolist(), stop[some].tolist(), strict=True):
                if hit := self.best(frozenset(bigram[inner[lo:hi]].tolist())):
                    found[int(owner[inner[lo]]), int(passage[inner[lo]]), hit[1]] = hit[0]
                    claimed[inner[lo] : inner[hi - 1] + 1] = True
        for dice, lo, hi, name in sorted(self.windows(bigram, owner), key=lambda w: (-w[0], w[1] - w[2], w[3], w[1])):
            if 2 * int(claimed[lo : hi + 1].sum()) <= hi + 1 - lo:
                found.setdefault((int(owner[lo]), int(passage[lo]), name), dice)
                claimed[lo : hi + 1] = True
        return [(*key, dice) for key, dice in sorted(found.items())]


def _scan(templates: list[tuple[str, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for lo, hi in slices(texts):
                rows += [(ids[lo + i], *rest) for i, *rest in known.scan(texts[lo:hi])]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "passage", "license", "dice"])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, passage, license, dice)`` of every passage of ``docs`` (doc_id, text) that states a licence.

    ``passage`` counts the text's passages with words from 0. A passage that is like a template as a whole has
    one row, with the best template. Windows of words of which no more than half is told already follow, the
    best first, each with a row at the passage in which it begins unless that has one of the same licence. A
    template is one run of words, whatever its punctuation. Null and empty texts and texts of one word state nothing; rows that repeat a doc_id each
    return their passages, a null doc_id returns null; an empty table gives an empty result. Whole texts are
    scanned where they lie, without a shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(TEMPLATES if templates is None else templates, threshold), "doc_id long, passage long, license string, dice double")
