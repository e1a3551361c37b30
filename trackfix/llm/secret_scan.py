"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

Runs are cut at ``=`` and tested whole and in their parts between ``/``, ``-`` and ``_``. A token's encoding
(one of ``ALPHABETS``) is inferred from its letters. Under the hypothesis that it is random
text of that encoding, chi-squared uniformity of its symbols, the runs test and the lag-one serial
correlation each give a p-value (letters also their likeness to prose), joined by Fisher's method. Random tokens have uniform joint p-values, other
tokens have small ones; so per encoding and length class the corpus's own p-values bound the number of random
tokens, and the least threshold is taken above which at most ``fdr`` of the tokens are estimated not to be
random.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackfix.llm.hashing import batches as slices
from trackfix.llm.hashing import give_back
from trackfix.session import materialize

#: The base patterns, with the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 8, 16, 32, 20
KINDS = ("assign", "access", "hex", "random")

#: The alphabets of the encodings, in order of their symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base26": "abcdefghijklmnopqrstuvwxyz",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
#: Rough shares of the letters a to z in prose, in per mille; rare ones are rounded up.
PROSE = (80, 16, 30, 44, 128, 20, 24, 52, 72, 5, 10, 40, 25, 72, 68, 20, 5, 64, 66, 84, 32, 12, 16, 5, 14, 8)
SEGMENT, PART = re.compile("[A-Za-z0-9+/_-]+=*"), re.compile("[A-Za-z0-9+]+=*")
BINS = 100
#: Symbols that a token has for each of its alphabet's before single ones are counted.
SHORT = 5
_KIND = {c: i for i, some in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")) for c in some}
_LIKE = np.log(np.array(PROSE) * 26 / sum(PROSE))

_HEX, _TOKEN = np.zeros(128, bool), np.zeros(128, bool)
_HEX[[ord(c) for c in ALPHABETS["hex"]]] = True
_TOKEN[[ord(c) for c in ALPHABETS["base64"] + "-_="]] = True


def _runs(flat: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least ``least`` code points of a class."""
    inside = members[np.minimum(flat, 127)] & (flat < 128)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans to test in a run: what ``=`` separates (padding stays), and the parts of that between ``/``, ``-`` and ``_``."""
    found = set()
    for segment in SEGMENT.finditer(text, start, end):
        found |= {segment.span(), *(part.span() for part in PART.finditer(text, *segment.span()))}
    return sorted((s, e) for s, e in found if e - s >= TOKEN_LEAST)


def infer_encoding(token: str) -> str | None:
    """The name of the least of ``ALPHABETS`` that fits, or None for numbers, letters of hex only and names with ``-_+/``.

    Letters and digits of one case are base32 (upper) or base36, letters alone base26 or base52.
    """
    has = lambda pattern: re.search(pattern, token) is not None
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        return "hex" if has("[A-Fa-f]") and has("[0-9]") else None
    if not has("[0-9]"):
        if re.fullmatch("[A-Z]+=+", token):
            return "base32"
        if re.fullmatch("[a-z]+=*|[A-Z]+", token):
            return "base26"
        return "base52" if re.fullmatch("[A-Za-z]+=*", token) else None
    if re.fullmatch("[A-Z2-7]+=*", token):
        return "base32"
    if re.fullmatch("([a-z0-9]+|[A-Z0-9]+)=*", token):
        return "base36" if has("[A-Za-z]") else None
    if not (re.fullmatch("[A-Za-z0-9+/_-]+=*", token) and has("[a-z]") and has("[A-Z]")):
        return None
    return "base64" if has("[+/_-]") else "base62"


def random_p(token: str, encoding: str) -> float:
    """Joint p-value of the tests under the hypothesis that the token is random.

    The symbols of short tokens are counted by kind (upper case, lower case, digit, other), as there are too
    few for single ones; runs are of symbols of one kind, or of one half of an alphabet of one kind. Names that
    are put together from words have too few runs and upper-case letters.

    All but hex get a fourth one, as the others tell long words from random letters only weakly: the
    log-likelihood of the letters in prose, which is too high for words.
    """
    body = token.rstrip("=").translate(str.maketrans("-_", "+/"))
    alphabet = ALPHABETS[encoding]
    body = body.lower() if encoding in ("hex", "base36", "base26") else body
    x = np.array([alphabet.index(c) for c in body], float)
    n, k = len(x), len(alphabet)
    kinds = np.array([_KIND.get(c, 3) for c in body])
    shares = np.bincount([_KIND.get(c, 3) for c in alphabet], minlength=4) / k
    few = n < SHORT * k and (shares > 0).sum() > 1  # too short for its single symbols: kinds of symbols are counted
    expected = n * (shares[shares > 0] if few else np.full(k, 1 / k))
    counts = np.bincount(kinds, minlength=4)[shares > 0] if few else np.bincount(x.astype(int), minlength=k)
    chi, free = float(((counts - expected) ** 2 / expected).sum()), len(expected) - 1
    z = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    groups = kinds if (shares > 0).sum() > 1 else (x >= k / 2).astype(int)
    of = np.bincount(groups).astype(float)
    two, three = float((of**2).sum()), float((of**3).sum())
    runs, mean = 1 + int((groups[1:] != groups[:-1]).sum()), n + 1 - two / n
    spread = (two * (two + n * (n + 1)) - 2 * n * three - n**3) / (n * n * (n - 1))
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if spread > 1e-9 else 2.0 ** (1 - n)
    centred = x - x.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    tests = [p_chi, p_runs, p_serial]
    if letters := [ord(c) - ord("a") for c in body.lower() if "a" <= c <= "z"] if encoding != "hex" else []:
        like = float(_LIKE[letters].sum()) - len(letters) * float(_LIKE.mean())
        tests.append(0.5 * math.erfc(like / float(_LIKE.std()) / math.sqrt(2 * len(letters))))
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(tests)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for lo, hi in slices(texts):
            part = texts[lo:hi]
            flat = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            begin = np.cumsum([0, *[len(t) + 1 for t in part[:-1]]])
            found: list[list[tuple[int, int, int]]] = [[] for _ in part]
            for kind, (starts, ends) in ((2, _runs(flat, _HEX, HEX_LEAST)), (3, _runs(flat, _TOKEN, TOKEN_LEAST))):
                owner = np.searchsorted(begin, starts, side="right") - 1
                for o, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    found[o].append((s - int(begin[o]), kind, e - int(begin[o])))
            for text, spans in zip(part, found, strict=True):
                low = text.lower()
                if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
                    spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
                if "AKIA" in text:
                    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
                base = sorted(x for x in spans if x[1] < 3)
                tokens = []
                for s, e in (c for f, _, g in sorted(x for x in spans if x[1] == 3) for c in candidates(text, f, g)):
                    if encoding := infer_encoding(text[s:e]):
                        alone = all(e <= b or s >= f for b, _, f in base)
                        tokens.append({"start": s, "end": e, "encoding": encoding, "length": int(2 * math.log2(e - s)), "p": random_p(text[s:e], encoding), "alone": alone})
                names = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                rows.append((sum(k == 0 for _, k, _ in base), sum(k == 1 for _, k, _ in base), sum(k == 2 for _, k, _ in base), hashlib.sha256(names.encode()).hexdigest(), [{"start": s, "kind": k, "end": e} for s, k, e in base], tokens))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens"])
    give_back()


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int32()), ("p", pa.float64()), ("alone", pa.bool_())])
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_CANDIDATE))
_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, "
    "tokens array<struct<start:long,end:long,encoding:string,length:int,p:double,alone:boolean>>"
)


def thresholds(scanned: DataFrame, fdr: float = 0.05, prior: float = 50.0) -> list[tuple[str, int, float]]:
    """``(encoding, length class, least p)`` from the p-values of all tokens of the corpus.

    The histogram has at most 7 encodings, two classes per doubling of length and ``BINS`` bins, whatever the
    corpus. ``prior`` random and as many other tokens (of p below 0.01) are added to each class, so that a
    class of few tokens keeps those whose randomness isn't rejected at 1 %.
    """
    t = F.col("t")
    tokens = scanned.select(F.explode("tokens").alias("t"))
    bins = tokens.groupBy(t["encoding"].alias("encoding"), t["length"].alias("length"), F.least(F.floor(t["p"] * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    seen: dict[tuple[str, int], np.ndarray] = {}
    for r in bins.collect():
        seen.setdefault((r.encoding, r.length), np.zeros(BINS))[r.bin] = r["count"]
    return [(encoding, length, least_p(counts, fdr, prior)) for (encoding, length), counts in sorted(seen.items())]


def least_p(counts: np.ndarray, fdr: float, prior: float, doubt: float = 2.0) -> float:
    """The least p-value, a multiple of 1 / BINS, from which at most ``fdr`` of a class's tokens are taken to be not random.

    Every count from some p-value on bounds the number of random tokens, of which the rest of the unit interval
    holds its share. The counts vary by chance, so each bound is ``doubt`` deviations wider, and the tightest one
    holds: a lack of random tokens that is within the noise of a small class never raises the threshold.
    """
    start = np.arange(BINS) / BINS
    own = np.cumsum(counts[::-1])[::-1]
    added = prior * (1 - start) + prior * (start == 0)
    bound = (own + doubt * np.sqrt(own) + doubt**2 / 2 + added) / (1 - start)
    random = min(bound[: BINS * 4 // 5])
    above = own + added
    false = np.maximum(0, above - random * (1 - start)) / above
    return int(np.argmax(false <= fdr)) / BINS if (false <= fdr).any() else 1.1


def scan_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text), over whole texts.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as ``kind:start:end``),
    ``spans`` (base spans and the random tokens that touch none of them, the widest of nested ones, by start) and ``found`` (the same as
    an array of structs). Offsets are code points, ends exclusive. A null or empty text has no spans; rows
    that repeat a doc_id each return; an empty table gives an empty result.
    """
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan, _SCHEMA))
    limits = thresholds(scanned, fdr)
    added = F.filter("tokens", lambda t: t["alone"] & (t["p"] >= _limit(t, limits)))
    inside = lambda t, u: (u["start"] <= t["start"]) & (u["end"] >= t["end"]) & (u["end"] - u["start"] > t["end"] - t["start"])
    widest = F.filter("added", lambda t: ~F.exists("added", lambda u: inside(t, u)))
    scanned = scanned.withColumn("added", added)
    spans = F.array_sort(F.concat(F.col("base"), F.transform(widest, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.withColumn("found", spans).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found")


def _limit(token: Column, limits: list[tuple[str, int, float]]) -> Column:
    out = F.lit(1.1)
    for encoding, length, least in limits:
        out = F.when((token["encoding"] == encoding) & (token["length"] == length), least).otherwise(out)
    return out


def redact(docs: DataFrame, mark: str = "[secret]", fdr: float = 0.05) -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``mark``, and ``n_chars`` (where there is one) anew.

    Overlapping spans are replaced as one. Rows without spans stay as they are, null texts included. The
    spans are found again in the task that holds the text, with the corpus's thresholds, so that no text
    is shuffled.
    """
    scanned = materialize(docs.select("doc_id", "text").mapInArrow(_scan, _SCHEMA))
    limits = {(e, n): p for e, n, p in thresholds(scanned, fdr)}

    @F.pandas_udf("string")
    def replaced(texts):
        import pandas as pd

        ids = pa.array(np.zeros(len(texts), np.int64))
        batch = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])
        done = next(iter(_scan(iter([batch]))))
        out = []
        for text, base, tokens in zip(texts, done.column("base").to_pylist(), done.column("tokens").to_pylist(), strict=True):
            spans = sorted([(b["start"], b["end"]) for b in base] + [(t["start"], t["end"]) for t in tokens if t["alone"] and t["p"] >= limits.get((t["encoding"], t["length"]), 1.1)])
            parts, at = [], 0
            for s, e in spans:
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]) if spans else text)
        return pd.Series(out, dtype=object)

    text = replaced(F.col("text"))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
