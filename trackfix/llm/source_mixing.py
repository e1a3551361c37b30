"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Targets share all words by weight, a source stopping at ``max_epochs`` times its own words. A source takes
as many whole epochs as its target holds and, for the rest, the documents whose hash is below a threshold.
The threshold comes from nested histograms: words per source and hash bucket, then again inside the bucket
where the budget runs out, until that bucket holds one hash. Nothing is sorted by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.session import join_sized, materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Number of runs without white space (space, tab to carriage return); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to one row per source (``skey``, ``source``, ``source_size``).

    Sources by code point, null last, weigh ``weights`` in turn. Where ``max_epochs`` times its size stops a
    source, the excess goes to the others by weight until none is above: a common level, the largest that a
    prefix of sources in order of cap per weight implies. The table has one row per source, so its one
    window needs one task of as many rows as there are sources.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * max_epochs
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - before) / left
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("level", "cap", "weight")


def _thresholds(slim: DataFrame, budgets: DataFrame) -> tuple[DataFrame, int]:
    """``(skey, path, left, bucket_size)`` per source with a rest, and the bits of ``path``.

    ``path`` is the prefix of the hash at which the budget runs out, ``left`` what the documents of that
    prefix, of ``bucket_size`` words, may still take.
    """
    state = materialize(budgets.where("rest > 0").select("skey", F.lit(0).cast("long").alias("path"), F.col("rest").alias("left"), F.lit(0).cast("long").alias("bucket_size")))
    bits = 0
    while bits < HASH_BITS:
        inside = join_sized(slim, state.select("skey", "path", "left"), ["skey"]).where(F.shiftright("hash", HASH_BITS - bits) == F.col("path"))
        bits += LEVEL_BITS
        buckets = inside.groupBy("skey", "left", F.shiftright("hash", HASH_BITS - bits).alias("bucket")).agg(
            F.sum("size").alias("words"), (F.min("hash") < F.max("hash")).alias("many")
        )
        upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        state = materialize(
            buckets.withColumn("upto", upto)
            .where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
            .select("skey", F.col("bucket").alias("path"), (F.col("left") - F.col("upto") + F.col("words")).alias("left"), F.col("words").alias("bucket_size"), "many")
        )
        if state.where("many").isEmpty():
            break
    return state.select("skey", "path", "left", "bucket_size"), bits


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The slim rows ``(doc_id, skey, size, hash)`` of ``docs`` and one row per source with its budget and threshold."""
    skey = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    slim = materialize(docs.select("doc_id", "source", skey.alias("skey"), word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash")))
    sizes = slim.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    budget = F.round("target").cast("long")
    some = F.greatest("source_size", F.lit(1).cast("long"))
    targets = materialize(source_targets(sizes, weights, max_epochs).withColumns({"epochs": F.floor(budget / some).cast("long"), "rest": F.pmod(budget, some)}))
    thresholds, bits = _thresholds(slim, targets)
    sources = materialize(targets.drop("source").join(thresholds, "skey", "left").withColumn("bits", F.lit(bits)))
    return slim.drop("source"), sources


def _place(hash_name: str = "hash", bits: str = "bits", path: str = "path") -> Column:
    """-1, 0 or 1: the row's hash is below, at or above its source's threshold; null without one."""
    return F.signum((F.expr(f"shiftright({hash_name}, {HASH_BITS} - {bits})") - F.col(path)).cast("double"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words that the mix takes, repeats included: the document's whole epochs, one more
    below its source's threshold, and a part of the document at the threshold, so that a source's words
    meet its target rounded to whole words. Null text has size 0; a null source is a source of its own,
    the last. Rows with equal doc_id have equal hashes and share the threshold's part by size. An empty
    table gives an empty result. Reruns agree.
    """
    slim, sources = plan_mix(docs, weights, max_epochs)
    place = _place()
    share = F.floor(F.col("left") * F.col("size") / F.greatest("bucket_size", F.lit(1).cast("long"))).cast("long")
    extra = F.when(place < 0, F.col("size")).when(place == 0, share).otherwise(F.lit(0).cast("long"))
    return join_sized(slim, sources, ["skey"]).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``, so that no name of theirs meets one that a step adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns as they are.

    Documents are taken whole: the one at the threshold where at least half of it fits. A null text is
    taken with its source's epochs.
    """
    _, sources = plan_mix(docs, weights, max_epochs)
    keyed = docs.select(whole_row(docs), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"), row_hash(F.col("doc_id")).alias("hash"))
    plan = sources.select("skey", "epochs", "path", "left", "bucket_size", "bits")
    place = _place()
    extra = F.when(place < 0, 1).when((place == 0) & (2 * F.col("left") >= F.col("bucket_size")), 1).otherwise(0)
    times = (F.col("epochs") + extra).cast("int")
    joined = join_sized(keyed, plan, ["skey"]).where(times > 0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(True), times)).alias("copy")).select("row.*")
