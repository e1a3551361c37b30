"""Brute force of its own for operators that share no code with it, and the odd cases: hot keys, repeats, unlike texts of one id."""

import collections
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_operators import DOCS, components, documents, odd_documents, shingle_counts

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, piece string, times long"


def test_chat_parts_of_tied_and_unnumbered_turns_join_to_the_whole(spark):
    from trackfix.llm.chat_perspectives import rotate_perspectives

    rng = random.Random(0)
    turns = [(1, k, rng.choice("abc"), f"text {k} é") for k in range(30)] + [(1, 3, "b", "tied")] * 2
    turns += [(2, 5, rng.choice("ab"), f"same number {k % 40}") for k in range(60)] + [(2, 5, "a", "again")] * 25
    turns += [(3, None, rng.choice(["x", None, "system"]), f"t{k}") for k in range(40)]
    turns += [(4, 0, "system", "alone"), (None, 0, "a", "no dialogue"), (5, 0, "a<|b\n", None), (5, 1, "z", "<|end|> in text"), (6, -7, "q", "x" * 100_000)]
    df = spark.createDataFrame([(*t, "clash", 9) for t in turns], TURNS)
    rows = rotate_perspectives(df, turns_per_piece=8).collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(t[0], t[2]) for t in turns if t[0] is not None and t[2] not in (None, "system")}
    plain = lambda t: (t or "").replace("<|", "< |")

    def render(role, text, who):
        role = "unknown" if role is None else role
        head = "<|assistant|>" if role == who else "<|system|>" if role == "system" else "<|user|>" + plain(role).replace("\n", " ")
        return f"{head}\n{plain(text)}<|end|>\n"

    by = collections.defaultdict(list)
    for r in rows:
        by[r.conv_id, r.perspective].append(r)
    for (conv, who), parts in by.items():
        at, text, masked = 0, "", collections.Counter()
        for r in sorted(parts, key=lambda r: (r.piece, r.part)):
            assert r.start == at and r.n_turns <= 40
            at, text = at + len(r.text), text + r.text
            spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",") if s]
            assert sum(e - s for s, e in spans) == r.n_trained
            masked.update(r.text[s:e] for s, e in spans)
        own = [t for t in turns if t[0] == conv]
        assert collections.Counter(text.split("<|end|>\n")) == collections.Counter("".join(render(*t[2:], who) for t in own).split("<|end|>\n"))
        assert masked == collections.Counter(plain(t[3]) + "<|end|>" for t in own if t[2] == who)
        assert sum(r.n_turns for r in parts) == len(own)
    first = "".join(r.text for r in sorted(by[1, "a"], key=lambda r: (r.piece, r.part)))
    ordered = sorted((t for t in turns if t[0] == 1), key=lambda t: t[1:])
    assert first == "".join(render(*t[2:], "a") for t in ordered)
    assert rotate_perspectives(df.limit(0)).count() == 0


def test_license_scan_of_odd_rows(spark):
    from trackfix.llm.license_scan import scan_licenses

    line = "This project is licensed under the MIT License."
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", "x"), (4, line, "x"), (4, line, "x"), (5, "word " * 40_000 + "\n" + line, "x"), (None, line, "x"), (6, f"{line} {line}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = collections.Counter((r.doc_id, r.license) for r in scan_licenses(df).collect())
    assert got == {(4, "MIT"): 2, (5, "MIT"): 1, (None, "MIT"): 1, (6, "MIT"): 2}
    assert scan_licenses(df.limit(0)).count() == 0


def chunks(text):
    """Chunks by their description, a character at a time: a gear hash of the last eight characters."""
    from trackfix.llm.chunk_fingerprint import _GEAR  # a table of random numbers

    gear = lambda c: (int(_GEAR[ord(c) & 0xFFFF]) + (ord(c) >> 16)) & 0xFFFFFFFF
    out, begin = [], 0
    while begin < len(text):
        end = begin
        while end < len(text):
            end += 1
            n = end - begin
            if n == 128:
                break
            h = sum(gear(c) << k for k, c in enumerate(reversed(text[max(0, end - 8) : end]))) & 0xFFFFFFFF
            if n >= 12 and end < len(text) and len(text) - begin > 12 and h >> (26 if n < 32 else 28) == 0:
                break
        out.append(text[begin:end])
        begin = end
    return out


def test_chunks_and_containment_match_a_walk_over_characters():
    from trackfix.llm.chunk_fingerprint import chunk_sets, containment

    rng = random.Random(2)
    texts = [d["text"] for d in documents()[:60]] + ["", "short", "a" * 700, "".join(chr(rng.choice([97, 0x4E00, 0x1F600, 32]) + rng.randrange(20)) for _ in range(3000))]
    found = chunk_sets(texts)
    parts = [set(chunks(t)) for t in texts]
    for t, s, p in zip(texts, found, parts, strict=True):
        assert "".join(chunks(t)) == t
        assert sorted(int(x) & 255 for x in s) == sorted(map(len, p))
    for i, j in [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(200)] + [(0, 0)]:
        light = min(sum(map(len, parts[i])), sum(map(len, parts[j])))
        want = sum(map(len, parts[i] & parts[j])) / light if light else float(not parts[i] and not parts[j])
        assert abs(containment(found[i], found[j]) - want) < 1e-12


def test_long_texts_and_large_alphabets_are_parsed_as_one(monkeypatch):
    from trackfix.llm import cross_parsing

    rng = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(6000)]
    source = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    sample = [("aa", source("abcd ef", 200)) for _ in range(30)] + [("bb", source("abcdefgh", 150)) for _ in range(30)]
    sample += [(f"l{k}", source(han[300 * k : 300 * (k + 1)], 200)) for k in range(20)]
    parser = cross_parsing.CrossParser(sample)
    trains = {lang: [cross_parsing._normal(t) for x, t in sample if x == lang] for lang, _ in sample}

    def brute(text, parts):
        n, i = 0, 0
        while i < len(text):
            k = 1
            while i + k < len(text) and any(text[i : i + k + 1] in p for p in parts):
                k += 1
            i, n = i + k, n + 1
        return n

    monkeypatch.setattr(cross_parsing, "CELLS", 30_000)  # some languages at a time
    texts = ["abcd" * 400, source("abcdef gh", 3000), "", "zzz 12", source("abc", 513) + "z" + source("de ", 511), sample[0][1] * 9, source(han, 700), "ab" * 512 + "b"]
    total, letters = parser.phrases(texts)
    normal = [cross_parsing._normal(t) for t in texts]
    for row, lang in zip(total, parser.languages, strict=True):
        assert row.tolist() == [brute(t, trains[lang]) for t in normal]
    assert letters.tolist() == [len(t.replace(" ", "")) for t in normal]
    langs, _ = parser.judge([sample[60 + k][1][10:60] for k in range(20)])
    assert langs == [f"l{k}" for k in range(20)]


def test_training_sample_is_bounded_and_reaches_into_texts(spark):
    from trackfix.llm.cross_parsing import identify_languages, training_sample

    rng = random.Random(6)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(7, words("abcde", 20), "aa")] * 5000 + [(9, words("fghij", 2000), "bb"), (11, "12 34", "cc"), (12, None, "cc"), (13, words("klm", 9), None)]
    rows += [(100 + k, f"dirty label {k}", f"label{k:03}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = training_sample(df, per_language=8, passage=50, max_languages=30)
    count = collections.Counter(lang for lang, _ in sample)
    assert count["aa"] == 3 and count["bb"] == 8 and "cc" not in count and len(count) == 30 and max(map(len, (t for _, t in sample))) <= 50
    assert len({t for lang, t in sample if lang == "bb"}) == 8 and any(t not in rows[5000][1][:400] for lang, t in sample if lang == "bb")
    got = {r.doc_id: r.lang_pred for r in identify_languages(df, per_language=8, passage=50).where("doc_id IN (7, 9, 11, 12)").distinct().collect()}
    assert got == {7: "aa", 9: "bb", 11: "und", 12: "und"}


def test_near_duplicates_of_many_repeats_and_of_a_large_group(spark):
    from trackfix.llm.dart_minhash import near_duplicates

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(5, " ".join(base))] * 1000 + [(5, "quite another text of this very document, which is like number six")]
    rows += [(6, "Quite another text of this very document which is like number six")]
    changed = lambda k: " ".join([*base[:k], "x", *base[k + 1 :]])
    rows += [(1000 + i, changed(rng.randrange(120))) for i in range(900)]
    far = [rng.choice(words) for _ in range(40)]
    rows += [(3000 + i, " ".join([*base[:80], *far[: 10 + i]])) for i in range(30)]  # alike among themselves, not to the others
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    nodes = [(i, t) for i, ts in texts.items() for t in ts]
    counts = [shingle_counts(t) for _, t in nodes]
    edges = [(nodes[a][0], nodes[b][0]) for a in range(len(nodes)) for b in range(a) if (c := (counts[a] & counts[b]).total()) >= 0.8 * (counts[a].total() + counts[b].total() - c)]
    want = components(texts, edges)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, block=64).collect()}
    assert got == want
    assert want[6] == 5


def test_near_duplicates_match_all_pairs_of_a_table(spark):
    from trackfix.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: shingle_counts(d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    where = collections.defaultdict(list)
    for i, c in docs.items():
        for s in c:
            where[s].append(i)
    pairs = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[:k]}
    edges = [(a, b) for a, b in pairs if (c := (docs[a] & docs[b]).total()) >= 0.8 * (docs[a].total() + docs[b].total() - c)]
    got = {r.doc_id: r.component_id for r in QUERIES["op10_dart_minhash"](spark, sf).collect()}
    assert len(edges) > 50 and got == components(docs, edges)


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline as p

    stage = dict(p.STAGES)["near_duplicates"]
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (None, b), (None, "c d e f g h"), (None, "c d e f g h"), (3, ""), (3, ""), (4, None), (0, "z y x w v u t"), (None, "z y x w v u t")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "v", 2.0) for i, t in rows], DOCS + ", __text string, node double")
    got = stage(spark, df, SF)
    assert got.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(1, a), (1, b), (None, "c d e f g h"), (3, ""), (4, None), (0, "z y x w v u t")])
    odd = odd_documents(spark)
    packed = dict(p.STAGES)["packing"](spark, odd, SF)
    assert packed.count() >= odd.count() and dict(p.STAGES)["packing"](spark, odd.limit(0), SF).count() == 0


def test_stages_keep_the_values_of_clashing_columns(spark):
    import corpus_pipeline as p

    names = ["__text", "__hash", "__epochs", "__id", "row", "skey", "hash", "epochs", "left", "copy", "digest", "none", "a.b"]
    words = [f"Alpha beta gamma delta {i} epsilon zeta eta theta iota kappa {i * 7}" for i in range(30)]
    rows = [(i, w, "en", "st"[i % 2], len(w), *[f"{n}-{i}" for n in names[:-1]], {"deep": i}) for i, w in enumerate(words)]
    kind = DOCS + ", " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", `a.b` struct<deep:int>"
    docs = spark.createDataFrame(rows, kind)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        got = out.collect()
        assert got and all(tuple(r)[5:] == (*[f"{n}-{r.doc_id}" for n in names[:-1]], (r.doc_id,)) for r in got), name


def test_embedding_links_of_repeated_ids_and_clashing_columns(spark):
    from trackfix.llm.epsilon_grid import cosine_components

    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 16))
    x = np.repeat(centre, 40, axis=0) + rng.normal(0, 0.25, (200, 16))
    ids = [i // 2 for i in range(200)]  # each id twice
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(200, dtype=bool)
    want = components(set(ids), [(ids[i], ids[j]) for i, j in np.argwhere(link)])
    df = spark.createDataFrame([(ids[i], x[i].tolist(), 1, 2, "l") for i in range(200)], "vec_id long, embedding array<double>, h1 int, cell int, label string")
    got = cosine_components(df, block=32).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == collections.Counter((ids[i], int(link[i].sum()), want[ids[i]]) for i in range(200))
    assert link.any() and all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_url_reputation_matches_numpy(spark):
    """The query's verdicts by the same statistics written with math.lgamma, group by group."""
    from trackfix.llm.queries import QUERIES, URL_RULES
    from trackfix.llm.url_reputation import DOUBT, STRENGTHS, TWO_LABEL_SUFFIXES

    labels = collections.defaultdict(list)
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        labels[r["doc_id"]].append(r["quality"] == 0 or r["toxic"] == 1)
    pages, tally = [], collections.defaultdict(lambda: [0, 0])
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        rest = (r["url"] or "").partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        pages.append((r["page_id"], host.lower(), slash + path))
        tally[host.lower()][0] += len(labels[r["page_id"]])
        tally[host.lower()][1] += sum(labels[r["page_id"]])

    def suffix(h):
        two = ".".join(h.split(".")[-2:])
        return two if two in TWO_LABEL_SUFFIXES and two != h else h.split(".")[-1]

    def domain(h):
        return ".".join(h.split(".")[-3 if ".".join(h.split(".")[-2:]) in TWO_LABEL_SUFFIXES else -2 :])

    def rolled(groups, up):
        out = collections.defaultdict(lambda: [0, 0])
        for g, (n, bad) in groups.items():
            out[up(g)][0] += n
            out[up(g)][1] += bad
        return out

    def posterior(groups, prior):
        ev = {}
        for g, (n, bad) in groups.items():
            m = min(max(prior(g), 1e-9), 1 - 1e-9)
            lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
            ev[g] = [lb(k * m + bad, k * (1 - m) + n - bad) - lb(k * m, k * (1 - m)) for k in STRENGTHS]
        total = np.sum([e for g, e in ev.items() if groups[g][0] > 0] or [[0] * len(STRENGTHS)], axis=0)
        weight = (1 - DOUBT) * np.exp(total - total.max()) / np.exp(total - total.max()).sum() + DOUBT / len(STRENGTHS)
        out = {}
        for g, (n, bad) in groups.items():
            m = min(max(prior(g), 1e-9), 1 - 1e-9)
            share = weight * np.exp(np.array(ev[g]) - max(ev[g]))
            mean = np.array([(k * m + bad) / (k + n) for k in STRENGTHS])
            square = np.array([p * p + p * (1 - p) / (k + n + 1) for k, p in zip(STRENGTHS, mean, strict=True)])
            rate = (share * mean).sum() / share.sum()
            out[g] = rate, max((share * square).sum() / share.sum() - rate**2, 0)
        return out

    domains = rolled(tally, domain)
    of = {domain(h): suffix(h) for h in tally}
    suffixes = rolled(domains, lambda d: of[d])
    overall = sum(b for _, b in tally.values()) / max(1, sum(n for n, _ in tally.values()))
    s = posterior(suffixes, lambda g: overall)
    d = posterior(domains, lambda g: s[of[g]][0])
    h = posterior(tally, lambda g: d[domain(g)][0])
    limit = max(0.25, overall + 0.1 * (1 - overall))
    got = {r.page_id: r for r in QUERIES["op2_url_reputation"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page, host, path in pages:
        fits = [r for r in URL_RULES if (host == r.parts()[0] or host.endswith("." + r.parts()[0])) and path.startswith(r.parts()[1])]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        lower = h[host][0] - 1.645 * math.sqrt(h[host][1])
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule and rule.text)
        assert got[page].verdict == (rule.verdict if rule else "block" if lower > limit else "allow")


def test_long_hosts_and_repeated_pages(spark):
    from trackfix.llm.queries import URL_RULES
    from trackfix.llm.url_reputation import filter_urls

    rows = [(1, "http://" + "a." * 60_000 + "example.org/es/x"), (2, "http://b.com/de/"), (2, "http://b.com/de/"), (None, "http://b.com/fr/")]
    labels = spark.createDataFrame([], "doc_id long, is_bad boolean")
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, URL_RULES).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got) == [(0, "com/fr/", "allow"), (1, "example.org/es/", "block"), (2, "com/de/", "block"), (2, "com/de/", "block")]


#: Names, paths and words of 20 characters or more that are no secrets.
NAMES = """MyProject2024FinalReportVersion org/apache/Spark3/sqlFunctions getUserAccountInformation2 ThisIsAVeryLongCamelCaseName2 Http2ClientConnectionManagerFactory
com/example/Project1/MainActivity BuildConfig2023ReleaseCandidate someVeryLongIdentifierName42 UTF8EncodedStringRepresentation SHA256WithRSAEncryptionProvider
iPhone15ProMaxCaseCoverBlack Lorem1Ipsum2Dolor3Sit4Amet5Consect internationalization electroencephalographically AbstractSingletonProxyFactoryBean /usr/share/documentation/packages/readme
kubernetesClusterAutoscaler2 WindowsServer2019DatacenterEdition node_modules/react/dist/index x86_64-unknown-linux-gnu-v2 user_profile_image_2024_final_v2 PostgreSQL14ReplicationGuide
2024-01-15T10-30-00Z-backup deploymentConfigurationV2Beta1 OpenSSLCertificateStore3 ResponseEntityExceptionHandler20 ABCDEFGHIJKLMNOPQRSTUVWXYZ123 12345678901234567890123456789""".split()


def test_false_discoveries_among_names_and_paths(spark):
    from trackfix.llm.secret_scan import scan_secrets

    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(letters) for _ in range(rng.randrange(24, 60))) for _ in range(40)]
    rows = [(i, f"see {n} please") for i, n in enumerate(NAMES)] + [(1000 + i, f"KEY={t} end") for i, t in enumerate(tokens)]
    got = {r.doc_id: r.spans for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    false, true = sum(got[i] != "" for i in range(len(NAMES))), sum(got[1000 + i] != "" for i in range(40))
    assert true >= 37 and false <= 0.05 * (true + false)


PARTS = "user account information package project data file config server handler request response manager factory builder parser stream buffer network protocol store cache index table column schema query engine worker thread process queue event message service client".split()


def test_thresholds_of_classes_of_all_sizes():
    """Classes of random tokens alone lose at most 3 % of them; among names, at most 5 % of what passes is false."""
    from trackfix.llm.secret_scan import BINS, candidates, infer_encoding, least_p, random_p

    rng, draw = np.random.default_rng(17), random.Random(17)
    least = lambda p: least_p(np.histogram(p, BINS, (0, 1))[0].astype(float), 0.05, 50.0)
    for n in (1, 2, 3, 5, 10, 30, 100, 300, 1000):
        lost = np.mean([(p < least(p)).mean() for p in rng.random((400, n))])
        assert lost <= 0.03, (n, lost)
    names = []
    while len(names) < 600:
        parts = [draw.choice(PARTS) for _ in range(draw.randrange(2, 6))]
        name = draw.choice(["".join(w.title() for w in parts), "_".join(parts), "/".join(parts) + str(draw.randrange(100)), parts[0] + "".join(w.title() for w in parts[1:]) + str(draw.randrange(1000))])
        names += [random_p(name[s:e], kind) for s, e in candidates(name, 0, len(name)) if (kind := infer_encoding(name[s:e]))]
    for n, others in ((3, 3), (10, 20), (30, 60), (100, 400), (1000, 2000)):
        passed = false = 0
        for _ in range(200):
            tokens, wrong = rng.random(n), rng.choice(names, others)
            limit = least(np.concatenate((tokens, wrong)))
            passed += (tokens >= limit).sum() + (wrong >= limit).sum()
            false += (wrong >= limit).sum()
        assert false <= 0.05 * passed, (n, others, false / passed)
    spread = np.concatenate((rng.random(1000), rng.random(2000) * 0.05))  # names that look random far more often
    assert least(spread) >= 0.04


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_url_reputation_matches_its_sql_on_larger_tables(spark, sf):
    import duckdb

    from trackfix.llm.oracle import ORACLE
    from trackfix.llm.queries import QUERIES

    db, folder = duckdb.connect(), f"/root/testdata/{sf}"
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(ORACLE["op2_url_reputation"])
    names = [c[0] for c in want.description]
    rows = collections.Counter(want.fetchall())
    got = collections.Counter(tuple(r[n] for n in names) for r in QUERIES["op2_url_reputation"](spark, folder).collect())
    assert got == rows and len({r[names.index("bad_lower")] for r in rows}) > 20
