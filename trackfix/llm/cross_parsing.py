"""Language identification by cross-parsing entropy.

A suffix automaton is built per language from a bounded sample of labelled passages. A text is parsed against
each automaton into the fewest phrases, every phrase being the longest match from where the last one ended;
the language that needs the fewest phrases, weighed by the bits that name a place in its sample, wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trackfix.llm.hashing import give_back, text_slices

#: Texts are parsed from so many places at once, which is put right where a phrase crosses one of them.
BLOCK = 512
#: Letters times languages that are parsed together.
CELLS = 8_000_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = 64, passage: int = 200, max_languages: int = 200) -> list[tuple[str, str]]:
    """``(lang, passage)``: the ``per_language`` passages of least hash of each language.

    Rows that aren't held out, with an id, a language and a letter in their text, are cut into passages of
    ``passage`` characters; all of them, wherever they lie in a text, may be drawn, equal ones once. Of more
    languages than ``max_languages`` those with the most rows are learned, by name on a tie. So at most
    ``per_language * max_languages`` passages come to the driver.

    The hash below which there are enough passages is guessed from a count of them and raised for languages
    where repeats left too few, so that no passage but those drawn is shuffled.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    parts = F.ceil(F.length("text") / passage).cast("int")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(parts).alias("passages")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    share = {r.lang: min(1.0, 4 * per_language / r.passages) for r in counts}
    drawn: list[tuple[str, str]] = []
    while share:
        bounds = [_HIGH if v == 1 else _LOW + int(v * 2.0**64) for v in share.values()]
        limits = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(share), pa.string()), "limit": pa.array(bounds, pa.int64())}))  # a list of rows would start Python workers of another kind
        keyed = known.join(F.broadcast(limits), "lang").select("lang", "text", "limit", F.xxhash64("doc_id", "text").alias("row"))
        spots = F.filter(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64("row", i) <= F.col("limit"))
        some = keyed.select("lang", "text", "row", F.explode(spots).alias("i"))
        some = some.select("lang", F.xxhash64("row", "i").alias("h"), F.substring("text", F.col("i") * passage + 1, F.lit(passage)).alias("passage"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        rows = some.groupBy("lang", "h").agg(F.min("passage").alias("passage")).withColumn("rank", rank).where(F.col("rank") <= per_language).collect()
        got: dict[str, list[tuple[int, str]]] = {lang: [] for lang in share}
        for r in rows:
            got[r.lang].append((r.h, r.passage))
        done = {lang for lang, found in got.items() if len(found) == per_language or share[lang] == 1}
        drawn += [(lang, text) for lang in done for _, text in sorted(got[lang])]
        share = {lang: min(1.0, 16 * v) for lang, v in share.items() if lang not in done}
    return sorted(drawn)


class Automaton:
    """Suffix automaton of a text over small integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, c: int) -> None:
        new, p = len(self.next), self.last
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        self.last = new


class CrossParser:
    """Automata of all languages as one hashed table of transitions, which grows with the sample alone.

    Letters are lower-cased; runs of anything else are one space. A letter that no sample has is a phrase by
    itself.
    """

    def __init__(self, sample: list[tuple[str, str]]) -> None:
        pieces: dict[str, list[str]] = {}
        for lang, text in sample:
            if part := _normal(text):
                pieces.setdefault(lang, []).append(part)
        self.languages = sorted(pieces)
        #: Phrases cost as many bits as name a place in the sample.
        self.bits = np.array([np.log2(sum(map(len, pieces[lang])) + 1) for lang in self.languages])
        letters = sorted(set().union(*(set(p) for parts in pieces.values() for p in parts)))
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 1
        self.code = np.zeros(0x110000, np.int32)
        for c, i in code.items():
            self.code[ord(c)] = i
        keys, values, roots, base = [], [], [], 0
        for lang in self.languages:
            automaton = Automaton()
            for part in pieces[lang]:
                for c in part:
                    automaton.extend(code[c])
                automaton.last = 0
            for state, row in enumerate(automaton.next):
                keys += [(base + state) * self.width + c for c in row]
                values += [base + t for t in row.values()]
            roots.append(base)
            base += len(automaton.next)
        self.root = np.array(roots, np.int64)
        self._fill(np.array(keys, np.int64), np.array(values, np.int32))
        #: Where a phrase that begins with a letter leads; back to the root where the sample hasn't the letter.
        first = self._find(self.root[:, None] * self.width + np.arange(self.width))
        self.first = np.where(first < 0, self.root[:, None], first)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Linear probing in a table at most a quarter full."""
        self.shift = 64 - max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << (64 - self.shift), -1, np.int64), np.zeros(1 << (64 - self.shift), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, at = np.unique(slot[free], return_index=True)
            won = free[at]
            self.keys[taken], self.values[taken] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        slot = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot >>= np.uint64(self.shift)
        return slot.view(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The state that each ``state * width + letter`` leads to, -1 for none."""
        flat = key.reshape(-1)
        slot = self._slot(flat)
        there = self.keys[slot]
        hit = there == flat
        out = np.where(hit, self.values[slot], np.int64(-1))
        on = np.flatnonzero(~hit & (there >= 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == flat[on]
            out[on[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            on, slot = on[more], slot[more]
        return out.reshape(key.shape)

    def _step(self, state: np.ndarray, letter: np.ndarray, root: np.ndarray, first: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a letter, and where it begins a phrase: after a whole one, and where the match ends."""
        to = self._find(state * self.width + letter)
        ended = to < 0
        at = np.nonzero(ended)
        to[at] = first[np.broadcast_to(lang, to.shape)[at], np.broadcast_to(letter, to.shape)[at]]
        ended |= state == root[lang]
        return to, ended

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text against each language, and the letters of each text."""
        normal = [_normal(t) for t in texts]
        n = np.array([len(t) for t in normal])
        letters = np.array([len(t) - t.count(" ") for t in normal])
        flat = self.code[np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32)]
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        some = max(1, CELLS // max(1, len(flat)))
        for lo in range(0, len(self.languages) if len(flat) else 0, some):
            total[lo : lo + some] = self._counts(flat, n, slice(lo, lo + some))
        return total, letters

    def _counts(self, flat: np.ndarray, n: np.ndarray, languages: slice) -> np.ndarray:
        """Phrases of each text of ``n`` letters of ``flat`` against some languages.

        Every block of a text is parsed as if a phrase began with it. The parse that comes from the block
        before is then led on to the first place where both begin a phrase, from where they are one.
        """
        root, first = self.root[languages], self.first[languages]
        every = np.arange(len(root))[:, None]
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(n)), blocks)
        stop = np.cumsum(n)[owner]
        begin = stop - n[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        end = np.minimum(begin + BLOCK, stop)
        order = np.argsort(begin - end, kind="stable")
        size = (end - begin)[order]
        state = np.repeat(root[:, None], len(owner), axis=1)
        starts = np.zeros((len(root), len(flat)), bool)
        active = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
        for step in range(int(size[0])):
            at = begin[order[: active[step]]] + step
            letter = flat[at]
            state[:, : len(at)], starts[:, at] = self._step(state[:, : len(at)], letter, root, first, every)
        count = np.add.reduceat(starts, begin, axis=1, dtype=np.int64)
        own = np.empty_like(order)
        own[order] = np.arange(len(order))
        more, meet = np.zeros_like(count), np.full_like(count, -1)
        open_ = np.flatnonzero(end < stop)
        lang, block = np.repeat(np.arange(len(root)), len(open_)), np.tile(open_, len(root))
        at, now = end[block], state[lang, own[block]]
        while len(at):
            letter = flat[at]
            now, begins = self._step(now, letter, root, first, lang)
            met = begins & starts[lang, at]
            meet[lang[met], block[met]] = at[met]
            more[lang, block] += begins & ~met
            at = at + 1
            on = ~met & (at < stop[block])
            lang, block, at, now = lang[on], block[on], at[on], now[on]
        total = np.zeros((len(root), len(n)), np.int64)
        head = np.cumsum(blocks) - blocks
        total[:, blocks > 0] = count[:, head[blocks > 0]]
        for text in np.flatnonzero(blocks > 1).tolist():
            h = int(head[text])
            for k in range(len(root)):
                b = h
                while True:
                    total[k, text] += more[k, b]
                    if (p := int(meet[k, b])) < 0:
                        break
                    b = h + (p - int(begin[h])) // BLOCK
                    total[k, text] += np.count_nonzero(starts[k, p : end[b]])
        return total

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score: the share by which the runner-up needs more phrases."""
        total, letters = self.phrases([t or "" for t in texts])
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = total * self.bits[:, None]
        best = cost.argmin(axis=0)
        ranked = np.sort(cost, axis=0)
        score = 1.0 - ranked[0] / np.maximum(ranked[1], 1e-9) if len(self.languages) > 1 else np.ones(len(texts))
        some = letters > 0
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


class _Folding(dict):
    """Lower-cased letters by code point; anything else is a space."""

    def __missing__(self, c: int) -> str:
        value = self[c] = chr(c).lower() if chr(c).isalpha() else " "
        return value


_FOLD = _Folding()


def _normal(text: str) -> str:
    return " ".join(text.translate(_FOLD).split())


def _predict(parser, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        model = parser.value
        for some, texts in text_slices(batches, lambda b: b.column(0).field("text")):
            row = some.column(0)
            langs, scores = model.judge(texts)
            yield pa.RecordBatch.from_arrays([row if keep else row.field("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row" if keep else "doc_id", "lang_pred", "score"])
        give_back()

    return run


def identify_languages(docs: DataFrame, per_language: int = 64, passage: int = 200, max_languages: int = 200, keep_rows: bool = False) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs`` (doc_id, text, lang).

    With ``keep_rows`` the row itself, with all its columns, comes as the struct ``row`` in place of doc_id.

    The automata are learned from ``per_language`` passages of ``passage`` characters of each of at most
    ``max_languages`` languages, from rows that aren't held out. ``lang_pred`` is a learned language, the first
    by name on a tie; ``und`` (score 0) for a null text or one without letters, and where no language could be
    learned. ``score`` is 1 less the winner's cost over the runner-up's, 1 where only one language was learned.
    A null doc_id isn't held out and isn't learned from. Whole texts are parsed, each as one. Equal texts get
    equal results; an empty table gives an empty result. The model that is broadcast grows with these three
    parameters alone: by at most some 150 bytes for each of its letters.
    """
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(training_sample(docs, per_language, passage, max_languages)))
    row = F.struct("*") if keep_rows else F.struct("doc_id", "text")
    rows = docs.select(row.alias("row"))
    first = rows.schema["row"] if keep_rows else docs.schema["doc_id"]
    schema = StructType([first, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    judged = rows.mapInArrow(_predict(parser, keep_rows), schema)
    key = F.col("row.doc_id") if keep_rows else F.col("doc_id")
    return judged.select(first.name, held_out(key).alias("held_out"), "lang_pred", "score")
