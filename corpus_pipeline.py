"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfix.llm.best_fit_packing import pack_documents
from trackfix.llm.cross_parsing import identify_languages
from trackfix.llm.dart_minhash import near_duplicates
from trackfix.llm.secret_scan import redact
from trackfix.llm.source_mixing import mixed_rows, whole_row
from trackfix.session import join_sized, materialize, read_table, scratch_dir


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, where the session leaves Spark's 64 MB as they are.

    A task of whole texts holds its batches several times, in the JVM and in Python. No result depends on
    it; the setting stays, as a stage's rows are read after it returns.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: null texts and those without a letter."""
    bound_batches(spark)
    return identify_languages(docs, keep_rows=True).where("lang_pred <> 'und'").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one of the least doc_id; a null one comes last.

    A document is a doc_id with a text: rows that repeat both leave one, rows of one doc_id with different
    texts are documents of their own and stay unless they are alike. Texts without words are like nothing.
    """
    bound_batches(spark)
    named = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "digest": F.xxhash64("text")}
    keyed = docs.select(whole_row(docs), *[c.alias(n) for n, c in named.items()])
    kept = near_duplicates(keyed.select(F.struct(*named).alias("doc_id"), F.col("row.text").alias("text"))).where("kept").select("doc_id.*")
    repeats = materialize(keyed.groupBy(*named).count().where("count > 1").select(*named))
    if not repeats.isEmpty():
        once = join_sized(keyed, repeats, [*named], "left_semi").dropDuplicates([*named])
        keyed = join_sized(keyed, repeats, [*named], "left_anti").unionByName(once)
    return keyed.join(kept.hint("merge"), [*named], "left_semi").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark."""
    bound_batches(spark)
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents, up to three times, to the target of each source."""
    return mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    bound_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the language model nor tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared scratch folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
