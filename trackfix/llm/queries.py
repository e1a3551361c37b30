"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackfix.llm.best_fit_packing import pack_documents
from trackfix.llm.chat_perspectives import rotate_perspectives
from trackfix.llm.chunk_fingerprint import fingerprint_neighbours
from trackfix.llm.cross_parsing import identify_languages
from trackfix.llm.dart_minhash import near_duplicates
from trackfix.llm.epsilon_grid import cosine_components
from trackfix.llm.filter_audit import audit_filters
from trackfix.llm.license_scan import scan_licenses
from trackfix.llm.periodic_runs import looped_documents, periodic_runs, run_digests
from trackfix.llm.secret_scan import scan_secrets
from trackfix.llm.source_mixing import mix_documents
from trackfix.llm.suffix_dedup import remove_repeats
from trackfix.llm.url_reputation import Rule, filter_urls
from trackfix.session import read_table

#: The url rules of the production list.
URL_RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's perspective."""
    return rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; a page is bad where its label is of low quality or toxic."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("is_bad"))
    return filter_urls(read_table(spark, sf_dir, "pages"), labels, URL_RULES).withColumn("bad_lower", F.round("bad_lower", 6) + F.lit(0.0))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that state a licence."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op5_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return cosine_components(read_table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mix_documents(read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens of all documents."""
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan_secrets(read_table(spark, sf_dir, "documents")).drop("found")


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-copy class and near-duplicate component of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters removes of each language's documents."""
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, a tenth of which is made periodic first."""
    return run_digests(periodic_runs(looped_documents(read_table(spark, sf_dir, "documents"))))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that came before."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_url_reputation": op2_url_reputation,
    "op3_license_scan": op3_license_scan,
    "op4_chunk_fingerprint": op4_chunk_fingerprint,
    "op5_epsilon_grid": op5_epsilon_grid,
    "op6_source_mixing": op6_source_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_cross_parsing": op8_cross_parsing,
    "op9_secret_scan": op9_secret_scan,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_dedup": op13_suffix_dedup,
}
