"""Audit of how document filters interact: what each removes in every order, and its Shapley share.

Every document has the set of filters that it fails. All removals that an audit asks for follow from the
removals of the 32 coalitions of five filters: a step of an order removes what the coalition after it removes
less what the one before it does. Shapley values are the solution of the kernel-weighted least squares fit of
an additive model to the coalitions' removals, held to the removal of all filters together. As its normal
equations depend on the number of filters alone, they are solved once, in rationals, as a linear map of the
coalitions' removals.
"""

from __future__ import annotations

import itertools
import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failure_conditions(text: Column) -> dict[str, Column]:
    """The production filters that look at one text: too short, too repetitive, too many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def shapley_map(n: int) -> list[list[int]]:
    """For each of ``n`` players, what the Shapley value times ``n!`` takes of each coalition's worth (by bit set).

    Minimises the squared error of an additive fit, coalitions of size s weighing (n-1) / (C(n,s) s (n-s)), held
    to the worth of all players; the worth of nobody is 0. Exact: the equations are eliminated in rationals.
    """
    whole = (1 << n) - 1
    inner = range(1, whole)
    weight = {c: Fraction(n - 1, math.comb(n, s) * s * (n - s)) for c in inner for s in [c.bit_count()]}
    rows = []
    for i in range(n):
        left = [sum((weight[c] for c in inner if c >> i & 1 and c >> j & 1), Fraction(0)) for j in range(n)]
        right = [weight[c] if c in weight and c >> i & 1 else Fraction(0) for c in range(whole + 1)]
        rows.append([*left, Fraction(1), *right])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(c == whole) for c in range(whole + 1)]])
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                rows[r] = [v - rows[r][k] * w for v, w in zip(rows[r], rows[k], strict=True)]
    out = [[v * math.factorial(n) for v in rows[i][n + 1 :]] for i in range(n)]
    assert all(v.denominator == 1 for r in out for v in r)
    return [[int(v) for v in r] for r in out]


def failures(docs: DataFrame, filters: dict[str, Column], keep: list[str]) -> DataFrame:
    """``(doc_id, keep..., digest, own)``: the bit set of the filters that each text fails, and a digest of the text.

    What follows works on these narrow rows; no text is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    return docs.select("doc_id", *keep, F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("own"))


def counted(rows: DataFrame, bit: int, keep: list[str]) -> DataFrame:
    """``(keep..., mask, n)``: rows (doc_id, digest, own, keep...) by bit set, with ``bit`` for a text that a smaller doc_id has.

    Rows are counted by digest and doc_id first, so that a text with very many copies is a few rows where its
    least doc_id is looked up. A null doc_id is smaller than none and has no smaller one.
    """
    by_id = rows.groupBy("digest", "own", *keep, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    unnamed = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0))
    by_text = by_id.groupBy("digest", "own", *keep).agg(F.sum("n").alias("n"), unnamed.alias("unnamed"), first.alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("fresh").alias("n")), F.struct(F.lit(bit).alias("bit"), (F.col("n") - F.col("fresh")).alias("n"))))
    cells = by_text.withColumn("least", least).withColumn("fresh", fresh).select(*keep, "own", split.alias("s")).where("s.n > 0")
    return cells.groupBy(*keep, (F.col("own") + F.col("s.bit")).alias("mask")).agg(F.sum("s.n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, duplicates: str = "E") -> DataFrame:
    """What every order of the filters removes, by language.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic. ``filters`` names conditions on
    the text under which it fails (at most six), ``duplicates`` the filter of texts that a smaller doc_id has.
    Returns for each ``part`` (lang; null is the empty string), ``filter_order`` and ``step`` (from 1): kept
    after the step, removed by it, redundant (failing its filter, removed earlier), unique_fails (failing its
    filter alone), good_lost and toxic_lost (removed rows with a label quality = 1, toxic = 1) and shapley
    (what its filter removes, summed over all orders).

    Null texts are empty. A doc_id with several labels has each value that one of them has; a row without
    doc_id has none and is no copy. Repeated rows of one doc_id are no copies of each other. Other columns are
    ignored; an empty table gives an empty result.
    """
    filters = failure_conditions(F.coalesce("text", F.lit(""))) if filters is None else filters
    names = [*filters, duplicates]
    n, whole = len(names), (1 << len(names)) - 1
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    judged = failures(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")), filters, ["part"])
    rows = judged.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    cells = counted(rows, 1 << len(filters), ["part", "good", "toxic"])
    count = lambda c: F.sum(c).cast("long")
    masks = cells.groupBy("part", "mask").agg(count(F.col("n")).alias("n"), count(F.col("n") * F.col("good")).alias("good"), count(F.col("n") * F.col("toxic")).alias("toxic"))
    packed = masks.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most one of each coalition

    def removals(name: str) -> Column:
        hit = lambda c: F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(m["mask"].bitwiseAND(c) != 0, m[name]).otherwise(F.lit(0)))
        return F.transform(F.sequence(F.lit(0), F.lit(whole)), hit)

    tabled = packed.select("part", "total", *[removals(c).alias(c) for c in ("n", "good", "toxic")])
    worth = [sum((F.lit(m) * F.col("n")[c] for c, m in enumerate(row) if m), F.lit(0)).cast("long") for row in shapley_map(n)]
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[j] for j in order), "step": step, "i": i, "bit": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,i:int,bit:int,before:int,after:int>>")
    planned = tabled.withColumn("shapley", F.array(*worth)).withColumn("s", F.explode(plan)).select("*", "s.*")
    at = lambda name, c: F.get(F.col(name), F.col(c) if isinstance(c, str) else c)
    lost = lambda name: at(name, "after") - at(name, "before")
    return planned.select(
        "part", "filter_order", "step", (F.col("total") - at("n", "after")).alias("kept"), lost("n").alias("removed"), (at("n", "bit") - lost("n")).alias("redundant"),
        (at("n", F.lit(whole)) - at("n", F.lit(whole) - F.col("bit"))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), at("shapley", "i").alias("shapley"),
    )
