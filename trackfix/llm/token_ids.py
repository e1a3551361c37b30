"""Token ids of whole texts, by a byte-level tokenizer that sees each distinct pre-token once.

Texts are cut into pre-tokens by array operations on code points; a pre-token's ids don't depend on what
stands around it, so those of known ones are put together from a table.
"""

from __future__ import annotations

import os

import numpy as np

from trackfix.llm.hashing import mix, span_hashes

LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
SPACE, QUOTE = 0x20, 0x27
#: Endings that a quotation mark takes into its pre-token.
ONE_LETTER, TWO_LETTERS = "sdmt", ("ll", "ve", "re")
#: Code points of a pre-token that may be known by its hash; a longer one is encoded wherever it stands.
HASHED = 48
WINDOW = 1_000_000
_SYMBOLS: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """A random value for each code point."""
    global _SYMBOLS
    if _SYMBOLS is None:
        _SYMBOLS = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _SYMBOLS


class _Index:
    """Numbers of uint64 keys other than 0, looked up and added many at a time; linear probing, at most half full."""

    def __init__(self, bits: int = 17) -> None:
        self.bits, self.held = bits, 0
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for an unknown one."""
        out, todo, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._first(keys)
        while len(todo):
            there = self.key[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.key) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if 2 * (self.held + len(keys)) > len(self.key):
            old = self.key > 0
            keys, values = np.append(self.key[old], keys), np.append(self.value[old], values)
            self.__init__((2 * len(keys)).bit_length() + 1)
        self.held += len(keys)
        at = self._first(keys)
        while len(keys):
            free = np.flatnonzero(self.key[at] == 0)
            slot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[slot], self.value[slot] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.key) - 1)


class TokenTable:
    """Ids of texts as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Texts that hold the string of an added token go through the tokenizer as a whole. Other texts are put
    together from pre-tokens; when the table of known ones holds over ``limit`` of them, the half used most
    stays. The class of a character is asked of the tokenizer's own pre-tokenizer, once.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if hasattr(self.words.model, "_resize_cache"):  # no word comes twice
            self.words.model._resize_cache(0)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of each token: one a character in the vocabulary's own letters.
        self.bytes = np.array([len(self.words.id_to_token(i) or "") for i in range(self.words.get_vocab_size())])
        self.kind = np.zeros(0x110000, np.uint8)
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.index, self.n = _Index(), 0
        self.begin, self.size, self.uses = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.key = np.zeros(1 << 16, np.uint64)  # 0 for a pre-token that isn't in the index
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _forget_rare(self) -> None:
        """Keep the most used half of ``limit`` pre-tokens, of those used more than once."""
        uses, half = self.uses[: self.n], self.limit // 2
        least = max(2, int(np.partition(uses, -half)[-half])) if half < self.n else 2
        keep = np.flatnonzero((uses >= least) & (self.key[: self.n] > 0))[:half]
        size, key, uses = self.size[keep], self.key[keep], uses[keep] // 2
        ids = self._gathered(keep, size)
        self._forget()
        self._append(ids, size, key)
        self.uses[: self.n] = uses
        self.index.add(key, np.arange(self.n, dtype=np.int32))

    def _gathered(self, number: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of some pre-tokens in order."""
        stop = np.cumsum(size)
        return self.ids[np.repeat(self.begin[number] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]

    def _kinds(self, flat: np.ndarray) -> np.ndarray:
        kind = self.kind[flat]
        if not kind.all():
            pieces = lambda text: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
            for c in np.unique(flat[kind == 0]).tolist():
                self.kind[c] = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if pieces(before + chr(c)) == 1), WHITE)
            kind = self.kind[flat]
        return kind

    def _cuts(self, flat: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of texts that begin at ``text_start``; none is empty.

        A run of one kind is a pre-token; the last character of white space before a run stands alone, or
        belongs to the run if it is a space; a lone quotation mark without a space takes some endings along.
        """
        n, kind = len(flat), self._kinds(flat)
        cut = np.zeros(n + 4, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        cut[text_start] = True
        first = np.zeros(n + 1, bool)
        first[text_start] = first[n] = True
        white_end = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~first[1:n])
        cut[white_end] = True
        cut[white_end[flat[white_end] == SPACE] + 1] = False
        quote = np.flatnonzero(flat == QUOTE)
        quote = quote[cut[quote] & ~first[quote + 1]]
        quote = quote[kind[quote + 1] == LETTER]
        after = flat[quote + 1]
        one = quote[np.isin(after, [ord(c) for c in ONE_LETTER])]
        two = quote[~first[quote + 2] & (quote + 2 < n)]
        pair = flat[two + 1].astype(np.uint64) << np.uint64(32) | flat[two + 2]
        two = two[np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in TWO_LETTERS], np.uint64))]
        cut[one + 1], cut[one + 2] = False, True
        cut[two + 1], cut[two + 3] = False, True
        return np.flatnonzero(cut[:n])

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum([len(w.encode()) for w in words])  # tokens part the bytes of a word among them
        stop = np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="right")
        return ids.astype(np.uint32), np.diff(stop, prepend=0)

    def _numbers(self, text: str, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number in the table of each pre-token, after adding the new ones."""
        key = span_hashes(_symbols()[flat], start, stop) | np.uint64(1)
        number = self.index.find(key)
        short = stop - start <= HASHED
        number[~short] = -1
        if (number < 0).any():
            new, long = np.flatnonzero((number < 0) & short), np.flatnonzero(~short)
            keys, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            place = np.concatenate((new[at], long))
            words = [text[s:e] for s, e in zip(start[place].tolist(), stop[place].tolist(), strict=True)]
            self._append(*self._word_ids(words), np.append(keys, np.zeros(len(long), np.uint64)))
            numbers = np.arange(self.n - len(words), self.n, dtype=np.int32)
            self.index.add(keys, numbers[: len(keys)])
            number[new], number[long] = numbers[back], numbers[len(keys) :]
        self.uses[: self.n] += np.bincount(number, minlength=self.n).astype(np.int32)
        return number

    def _append(self, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        grown = lambda a, least: np.concatenate((a, np.zeros(max(least - len(a), len(a)), a.dtype))) if least > len(a) else a
        self.ids = grown(self.ids, self.used + len(ids))
        self.begin, self.size, self.uses, self.key = (grown(a, self.n + len(sizes)) for a in (self.begin, self.size, self.uses, self.key))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)], self.key[self.n : self.n + len(sizes)] = sizes, keys
        self.used, self.n = self.used + len(ids), self.n + len(sizes)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.n > self.limit or self.used > 4 * self.limit:
            self._forget_rare()
        length = np.array([len(t) for t in texts])
        text = "".join(texts)
        flat = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        text_start = np.cumsum(length) - length
        start = self._cuts(flat, text_start)
        number = self._numbers(text, flat, start, np.append(start[1:], len(flat)))
        size = self.size[number]
        total = np.concatenate(([0], np.cumsum(size)))
        return np.split(self._gathered(number, size), total[np.searchsorted(start, text_start[1:])])

    def _windows(self, text: str) -> list[str]:
        """Parts of about ``WINDOW`` characters, cut where white space follows something else."""
        out, begin = [], 0
        while len(text) - begin > WINDOW:
            flat = np.frombuffer(text[begin : begin + 2 * WINDOW].encode("utf-32-le"), np.uint32)
            white = self._kinds(flat) == WHITE
            places = np.flatnonzero(white[1:] & ~white[:-1]) + 1
            k = int(np.searchsorted(places, WINDOW)) - 1
            step = int(places[max(k, 0)]) if len(places) else 0
            if not step:
                break
            out.append(text[begin : begin + step])
            begin += step
        return [*out, text[begin:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; works on about ``WINDOW`` characters at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        some: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            if some:
                for (i, _), ids in zip(some, self._encode([t for _, t in some]), strict=True):
                    out[i].append(ids)
                some.clear()

        for i, text in enumerate(texts):
            if any(t in text for t in self.added):
                flush()
                held = 0
                out[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            for part in self._windows(text) if len(text) > WINDOW else [text] if text else []:
                if held + len(part) > WINDOW:
                    flush()
                    held = 0
                some.append((i, part))
                held += len(part)
        flush()
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint32) for parts in out]
