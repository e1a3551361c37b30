"""The filter audit, periodic runs and repeated passages against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from test_operators import DOCS, SF, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def values(df, names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_filter_audit_matches_its_sql(spark, sf):
    from trackfix.llm.oracle import ORACLE
    from trackfix.llm.queries import QUERIES

    folder = SF.replace("sf0.001", sf)
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(ORACLE["op11_filter_audit"])
    names = [c[0] for c in want.description]
    got = QUERIES["op11_filter_audit"](spark, folder)
    assert sorted(got.columns) == sorted(names) and values(got, names) == collections.Counter(want.fetchall())


def test_filter_audit_of_odd_rows_matches_a_walk_through_all_orders(spark):
    from trackfix.llm.filter_audit import audit_filters

    rng = random.Random(3)
    some = ["", "word " * 120, " ".join(f"w{i}" for i in range(130)), "SHOUT " * 3, "a # b", " ".join(f"W{i}$" for i in range(101)), None]
    rows = [(rng.choice([None, *range(40)]), rng.choice(some), rng.choice([None, "en", "de", ""]), None, None, "x", 1.0) for _ in range(300)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    docs, truth = spark.createDataFrame(rows, DOCS + ", mask string, n double"), spark.createDataFrame(labels, LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit_filters(docs, truth).collect()}
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}

    def fails(doc, text):
        t, w = text or "", (text or "").split()
        copies = [d for d, other, *_ in rows if (other or "") == t and d is not None]
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), doc is not None and min(copies) < doc]
        return {n for n, x in zip("ABCDE", tests, strict=True) if x}

    judged = [(lang or "", doc, fails(doc, text)) for doc, text, lang, *_ in rows]
    want, share = {}, collections.Counter()
    for part in {p for p, _, _ in judged}:
        for order in itertools.permutations("ABCDE"):
            left = [(d, f) for p, d, f in judged if p == part]
            for step, name in enumerate(order, 1):
                gone, left = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                all_of = [f for p, _, f in judged if p == part and name in f]
                share[part, name] += len(gone)
                want[part, "".join(order), step] = (len(left), len(gone), len(all_of) - len(gone), sum(f == {name} for f in all_of), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name)
    want = {k: (*v[:-1], share[k[0], v[-1]]) for k, v in want.items()}
    assert got == want
    assert audit_filters(odd_documents(spark), truth).count() == 600 * 4
    assert audit_filters(docs.limit(0), truth).count() == 0 and audit_filters(docs, truth.limit(0)).count() == len(want)


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_shapley_map_is_the_mean_over_all_orders(n):
    from trackfix.llm.filter_audit import shapley_map

    rng = random.Random(n)
    worth = [0, *[rng.randrange(1000) for _ in range((1 << n) - 1)]]
    want = [0] * n
    for order in itertools.permutations(range(n)):
        at = 0
        for i in order:
            want[i] += worth[at | 1 << i] - worth[at]
            at |= 1 << i
    assert [sum(m * w for m, w in zip(row, worth, strict=True)) for row in shapley_map(n)] == want


def runs_by_definition(w, least):
    """All maximal stretches of smallest period q with at least ``least`` and 2q words."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= 2 * q and j > i:
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_match_their_definition(least):
    import numpy as np

    from trackfix.llm.hashing import mix
    from trackfix.llm.periodic_runs import runs_of, stretches

    rng = random.Random(least)
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            u = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
            w = [*w[: len(w) // 2], *(u * 5)[: rng.randrange(2, 80)], *w[len(w) // 2 :]]
        want = runs_by_definition(w, least)
        assert runs_of(w, least) == want, w
        got = []
        for a, b in stretches(mix(np.array(w, np.uint64)), np.zeros(len(w), np.int64), least):
            got += [(a + s, n, p) for s, n, p in runs_of(w[a:b], least)]
        assert sorted(got) == want, w


def test_long_repetitive_texts_take_time_in_proportion():
    import time

    from trackfix.llm.periodic_runs import runs_of

    began = time.perf_counter()
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert runs_of(list(range(700)) * 100) == [(0, 70_000, 700)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 50_000:
        fib.append(fib[-1] + fib[-2])
    assert len(runs_of(fib[-1])) > 1000
    assert time.perf_counter() - began < 30


def looped(doc, text):
    w = (text or "").encode("utf-8").split()
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_row(doc, text):
    w = looped(doc, text)
    runs = runs_by_definition(w, 12)
    gone = {j for s, n, q in runs for j in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest())


def test_periodic_runs_of_a_table_match_their_definition(spark):
    from trackfix.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = values(QUERIES["op12_periodic_runs"](spark, SF), names)
    short = [r for r in docs if len((r.text or "").split()) < 1500]
    want = collections.Counter(run_row(r.doc_id, r.text) for r in short)
    assert len(short) > 150 and sum(w[1] > 0 for w in want) > 10
    assert sum(got.values()) == len(docs) and not want - got


def test_periodic_runs_of_odd_rows(spark):
    from trackfix.llm.periodic_runs import looped_documents, periodic_runs, run_digests

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    odd = odd_documents(spark).withColumnRenamed("row", "runs").withColumnRenamed("score", "w")
    more = spark.createDataFrame([(60, "\x0b\x0ca b " * 20), (61, "é " * 11), (62, "é " * 12), (-7, "x y z " * 9), (63, "é\n" * 400)], "doc_id long, text string")
    got = values(run_digests(periodic_runs(looped_documents(odd))), names)
    assert sum(got.values()) == 9 and next(r for r in got if r[0] == 6)[1:5] == (1, 0, 60_000, 3)
    assert values(run_digests(periodic_runs(looped_documents(more))), names) == collections.Counter(run_row(r.doc_id, r.text) for r in more.collect())
    assert all(r in got for r in [run_row(1, None), run_row(2, ""), run_row(None, "no id at all")])
    assert periodic_runs(odd.limit(0)).count() == 0


def kept(rows, length):
    """Per (doc_id, text) in order: what the definition leaves, with a set of all strings seen."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len([1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])])
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return collections.Counter(out)


CUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_removed_repeats_of_a_table_match_a_set_of_strings(spark, sf):
    from trackfix.llm.queries import QUERIES

    folder = SF.replace("sf0.001", sf)
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want = kept([(r.doc_id, r.text) for r in docs], 100)
    assert values(QUERIES["op13_suffix_dedup"](spark, folder), CUT) == want and sum(w[2] > 0 for w in want) > 10


def test_removed_repeats_of_random_and_periodic_texts(spark):
    from pyspark.sql import functions as F

    from trackfix.llm.suffix_dedup import remove_repeats

    rng = random.Random(5)
    draw = lambda n, letters="ab": "".join(rng.choice(letters) for _ in range(n))
    some = [draw(rng.randrange(90, 260), "abcdé ") for _ in range(12)]
    texts = ["", None, "a" * 99, "a" * 100, "a" * 350, "ab" * 300, draw(700), draw(400) * 2, "日" * 500, some[0] * 4]
    for _ in range(150):
        parts = [rng.choice(some) for _ in range(rng.randrange(1, 5))]
        texts.append("".join(p[rng.randrange(60) : len(p) - rng.randrange(60)] + draw(rng.randrange(3), "xyz") for p in parts))
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(len(texts), texts[7]), (len(texts) + 1, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = remove_repeats(df).withColumn("n_spans", F.size("spans"))
    assert values(got, CUT) == kept(rows, 100)
    assert all(s.end - s.start >= 100 for r in got.collect() for s in r.spans)


def test_removed_repeats_of_odd_rows(spark):
    from pyspark.sql import functions as F

    from trackfix.llm.suffix_dedup import remove_repeats

    odd = odd_documents(spark).withColumnRenamed("row", "o").withColumnRenamed("score", "k")
    got = values(remove_repeats(odd).withColumn("n_spans", F.size("spans")), CUT)
    rows = sorted([(r.doc_id, r.text) for r in odd.collect()], key=lambda r: (r[0] is None, r[0] or 0))
    short = [r for r in rows if r[0] != 6]
    assert sum(got.values()) == 9 and not kept(short, 100) - got
    long = next(r for r in got if r[0] == 6)
    period = len("lorem ipsum é日本 ".encode())
    assert long[1] == 20_000 * period and long[2] == 20_000 * period - period and long[3] == 1
    clash = spark.createDataFrame([(1, "x" * 30 + draw, "x") for draw in ("p" * 100, "q" * 100, "p" * 100)] + [(None, "p" * 120, "y"), (None, None, "y")], "doc_id long, text string, tie string")
    out = remove_repeats(clash).collect()
    assert sorted(r.n_removed for r in out)[:2] == [0, 0] and sum(r.n_removed == 130 for r in out) == 1 and len(out) == 5
    assert remove_repeats(odd.limit(0)).count() == 0
