"""Every stage of the pipeline on its own input, against brute force."""

import collections
import re

import public_tokenizers
from test_operators import components, odd_documents, shingle_counts
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    language = dict(p.STAGES)["language"](spark, docs, SF)
    assert language.columns == docs.columns
    kept = {r.doc_id for r in language.collect()}
    assert kept == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}

    near = dict(p.STAGES)["near_duplicates"](spark, docs, SF)
    counts = {i: shingle_counts(r.text) for i, r in rows.items()}
    ids, edges = list(counts), []
    for x in range(len(ids)):
        for y in range(x):
            a, b = counts[ids[x]], counts[ids[y]]
            common = sum((a & b).values())
            if common and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common):
                edges.append((ids[x], ids[y]))
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == set(components(ids, edges).values())

    clean = {r.doc_id: r for r in dict(p.STAGES)["secrets"](spark, docs, SF).collect()}
    assert clean.keys() == rows.keys()
    secret = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,})|[0-9a-f]{32,}""")
    for i, r in rows.items():
        assert not secret.search(clean[i].text) and clean[i].n_chars == len(clean[i].text)
        assert secret.search(r.text) or clean[i].text == r.text or "[secret]" in clean[i].text

    mixed = dict(p.STAGES)["mixing"](spark, docs, SF)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows.values())
    assert sum(r.length for r in dict(p.STAGES)["packing"](spark, docs, SF).collect()) == want


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    odd = odd_documents(spark)
    empty = odd.limit(0)
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, empty, SF).count() == 0, name
    assert p.STAGES[1][1](spark, odd, SF).where("doc_id = 4").count() == 1


def test_run(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).count() > 100


def test_workers_drop_what_other_stages_kept():
    """A worker outlives its stage: its table of tokens serves tasks of packing, and goes with the next task of another kind."""
    import pyarrow as pa

    from trackfix.llm import best_fit_packing, dart_minhash
    from trackfix.llm.hashing import KEPT

    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"])
    run = best_fit_packing._tokenize(path, 2048, 0)
    first = list(run(iter([batch])))
    table = KEPT[path]
    assert list(run(iter([batch]))) == first and KEPT[path] is table
    assert not list(dart_minhash._sketch(iter([]))) and not KEPT


def test_memory_of_a_task_follows_its_characters():
    """Short texts need as many darts as long ones, so a slice of them holds fewer."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from trackfix.llm import dart_minhash
    from trackfix.llm.hashing import text_slices

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out, most

    texts = [f"w{i} a b c d e f" for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array(texts)], names=["doc_id", "t", "text"])
    found, most = peak(lambda: list(dart_minhash._sketch(iter([batch]))))
    assert pa.Table.from_batches(found).column("doc_id").to_pylist() == list(range(1500)) and most < 120, most

    rng = np.random.default_rng(1)
    odd = [None if n == 7 else "é" * int(n) for n in rng.integers(0, 60, 300)]
    batches = pa.table({"k": range(300), "text": odd}).to_batches(max_chunksize=70)
    parts = list(text_slices(iter(batches), lambda b: b.column(1), size=100, each=10))
    assert [t for _, some in parts for t in some] == odd and [k for b, _ in parts for k in b.column(0).to_pylist()] == list(range(300))
    assert all(len(some) == 1 or sum(len(t or "") + 10 for t in some) <= 100 for _, some in parts)
