"""Periodic stretches of words: maximal repetitions of each text, and the text with the repeats dropped.

A suffix automaton of a text's words is read along the text again: each word appended makes a path of suffix
links, from the state of the prefix to the root, the one last visited. Segments of that path that were last
visited together, at the same earlier word, are recoloured (link-cut access, its preferred paths kept as
stacks on the heavy paths of the link tree). A segment whose longest suffix is at least as long as the distance
to its last visit is a square; squares are extended both ways to runs. The innermost occurrence of a primitive
square is always the last one, so every run shows itself.

Only stretches of words that can lie in a run go through the automaton: those covered by strings of half the
least length that occur again in the same stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackfix.llm.hashing import BYTES, give_back, mix, salted, span_hashes
from trackfix.llm.hashing import batches as slices

LEAST = 12
#: Bytes that are no part of a word.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """``(link, length, state)``: the suffix links and longest strings of the states, and the state of each prefix."""
    step: list[dict[int, int]] = [{}]
    link, length, state = [-1], [0], []
    last = 0
    for c in word:
        new = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        state.append(new)
    return link, length, state


def heavy_paths(link: list[int], length: list[int]) -> list[int]:
    """For each state the top (shortest state) of its heavy path in the tree of suffix links."""
    order = np.argsort(length, kind="stable").tolist()
    size, heavy, top = [1] * len(link), [0] * len(link), list(range(len(link)))
    for v in reversed(order[1:]):
        size[link[v]] += size[v]
    for v in order[1:]:
        u = link[v]
        if not heavy[u] or size[v] > size[heavy[u]]:
            heavy[u] = v
    for v in order[1:]:
        if link[v] and heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` words, by start, then period."""
    link, length, state = automaton(word)
    top = heavy_paths(link, length)
    n, visited, reach = len(word), {}, {}
    found: dict[tuple[int, int], int] = {}
    for i, v in enumerate(state):
        while v:
            t, deep, before = top[v], length[v], 0
            stack = visited.setdefault(t, [])  # (longest string, last visit) of the segments, the shortest on top
            squares = []
            while stack and stack[-1][0] <= deep:
                before, seen = stack.pop()
                if before >= i - seen:
                    squares.append(i - seen)
            if stack and before < deep and deep >= i - stack[-1][1]:
                squares.append(i - stack[-1][1])
            stack.append((deep, i))
            for p in squares:
                if reach.get(p, -1) < i:
                    a, b = i - 2 * p + 1, i + 1
                    while a and word[a - 1] == word[a - 1 + p]:
                        a -= 1
                    while b < n and word[b] == word[b - p]:
                        b += 1
                    reach[p] = b - 1
                    if b - a >= least and found.get((a, b), n) > p:
                        found[a, b] = p
            v = link[t]
    return sorted((a, b - a, p) for (a, b), p in found.items())


def stretches(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of ``words`` (hashes; ``owner`` tells their texts apart) outside of which no run of ``least`` words lies.

    A run of period q repeats, q words on, a string of at least half the least length, and these two strings
    cover it. So words that no repeated string of that length covers are in no run, and what is left falls
    apart into stretches, in which strings must repeat again.
    """
    m = (least + 1) // 2
    place, label = np.arange(len(words)), owner.astype(np.int64)
    while len(place) >= least:
        ends = len(place) - m + 1
        key = np.zeros(ends, np.uint64)
        for j in range(m):
            key += salted(words[place[j : j + ends]], j)
        whole = label[:ends] == label[m - 1 :]
        key = mix(key + salted(label[:ends].astype(np.uint64), m))[whole]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(whole)[count[back] > 1]
        depth = np.zeros(len(place) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.subtract.at(depth, at + m, 1)
        covered = np.cumsum(depth[:-1]) > 0
        kept, kind = place[covered], label[covered]
        cut = np.ones(len(kept), bool)
        cut[1:] = (kept[1:] != kept[:-1] + 1) | (kind[1:] != kind[:-1])
        number = np.cumsum(cut) - 1
        long = np.bincount(number, minlength=1)[number] >= least if len(kept) else np.zeros(0, bool)
        done = len(kept) == len(place) and long.all()
        place, label = kept[long], number[long]
        if done:
            break
    else:
        return []
    begin = np.flatnonzero(np.diff(label, prepend=-1))
    last = np.append(begin[1:], len(place)) - 1
    return list(zip(place[begin].tolist(), (place[last] + 1).tolist(), strict=True))


def _find(least: int, collapse: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, runs, left = [], [], []
            for lo, hi in slices(texts):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
                flat = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
                edge = np.flatnonzero(np.diff((~_SPACE[flat]).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                starts, ends = edge[::2], edge[1::2]
                owner = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
                count = np.bincount(owner, minlength=len(data))
                first = np.cumsum(count) - count
                words = span_hashes(BYTES[flat], starts, ends) if len(starts) else np.zeros(0, np.uint64)
                found: list[list[dict]] = [[] for _ in data]
                keep = np.ones(len(words), bool)
                for a, b in stretches(words, owner, least):
                    doc = owner[a]
                    for s, n, p in runs_of(np.unique(words[a:b], return_inverse=True)[1].tolist(), least):
                        found[doc].append({"start": a - int(first[doc]) + s, "length": n, "period": p})
                        keep[a + s + p : a + s + n] = False
                sizes += count.tolist()
                runs += [sorted(f, key=lambda r: (r["start"], r["period"])) for f in found]
                if collapse:
                    depth = np.zeros(len(flat) + 1, np.int8)
                    depth[starts[keep]] = 1
                    np.subtract.at(depth, ends[keep] + 1, 1)
                    spaced = flat.copy()
                    spaced[_SPACE[flat]] = 0x20
                    rest = spaced[np.cumsum(depth[:-1], dtype=np.int8) > 0].tobytes()
                    width = np.bincount(owner[keep], weights=(ends - starts + 1)[keep], minlength=len(data)).astype(np.int64)
                    until = np.cumsum(width).tolist()
                    left += [rest[u - w : u - 1] if w else b"" for u, w in zip(until, width.tolist(), strict=True)]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN))]
            names = ["doc_id", "n_words", "runs"]
            if collapse:
                columns.append(pa.array(left, pa.binary()).cast(pa.string()))
                names.append("collapsed")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return find


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, collapse: bool = True) -> DataFrame:
    """The runs of every row of ``docs`` (doc_id, text), over whole texts.

    Words are what spaces and the bytes 9 to 13 separate. A run is a stretch of words of smallest period q and
    at least ``least`` and 2q words that no neighbour extends. Returns doc_id, n_words, ``runs`` (structs of
    start, length, period in words, by start, then period) and, with ``collapse``, ``collapsed``: the words
    that no run holds after its first q, joined by one space. Nothing is shuffled; memory follows the longest
    text. Null and empty texts have no words; rows that repeat a doc_id each return; other columns are ignored;
    an empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>" + (", collapsed string" if collapse else "")
    return docs.select("doc_id", "text").mapInArrow(_find(least, collapse), schema)


def looped_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a tenth of the texts, by a checksum of doc_id, going round in circles from some word on.

    With h the checksum and g = h // 10, texts of h % 10 = 0 and n > 0 words have each word i from a = g % n on
    replaced by word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null doc_id has no checksum.
    """
    check = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", check.alias("h"), F.floor(check / 10).alias("g"))
    words = words.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    size = F.size("w").cast("long")
    words = words.withColumn("a", F.when(size > 0, F.col("g") % size)).withColumn("p", 1 + F.floor((size - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    looped = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda i: F.get("w", source(i))), " ")
    return words.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each row of :func:`periodic_runs` and digests of all runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
