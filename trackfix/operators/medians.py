"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.session import join_sized, materialize

#: Rows from which a group's median is selected by histograms instead of in one task.
LARGE = 1_000_000
#: Buckets of a histogram that divides a range of values.
BUCKETS = 4096


def _octave(v: Column) -> Column:
    """A bucket for any double that never falls as the value grows: by sign and power of two; NaN is the largest."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    return F.when(F.isnan(v), F.lit(9999)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * 9000).otherwise(F.signum(v) * power).cast("int")


def _selected(rows: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """``(by..., v, upto)``: the value of the given ``rank`` (from 0) among each group's ``v``, and how many are no larger.

    Each round counts a group's values by bucket as partial aggregates and goes on with the bucket that holds
    the rank: first octaves, then equal parts of what they hold, so a state is at most one histogram per group
    and task, and the bits of a double are through after six rounds.
    """
    state = ranks.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("nan")), "below": F.lit(0).cast("long"), "upto": F.lit(0).cast("long")})
    found, first = None, True
    while True:
        inside = rows.join(F.broadcast(state), by).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        part = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS)
        bucket = _octave(F.col("v")) if first else F.least(part, F.lit(BUCKETS - 1)).cast("int")
        counted = inside.groupBy(*by, "rank", "below", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        w = Window.partitionBy(*by, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = counted.withColumn("upto", F.col("below") + F.sum("n").over(w))
        hit = counted.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        hit = materialize(hit.select(*by, "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below"), "upto"))
        done = hit.where("low = high").select(*by, F.col("low").alias("v"), "upto")
        found = done if found is None else found.unionByName(done)
        state, first = hit.where("low <> high"), False
        if state.isEmpty():
            return found


def exact_medians(rows: DataFrame, by: list[str], columns: list[str], large: int = LARGE, total: int | None = None, largest: int | None = None) -> DataFrame:
    """``(by..., columns...)``: the median of each column in each group, as ``median`` gives it.

    Nulls don't count, NaN is the largest value, an even count gives the mean of the middle two, a group
    without values null. Groups of more than ``large`` rows are told by a count and selected by nested
    histograms, in state that is bounded whatever the group holds; at most ``total / large`` of them exist, which
    is what is broadcast. Null keys make no group. ``total``, where the caller knows a bound of the rows, spares
    the count of a small table, and ``largest``, a bound of the largest group's, a pass over many small groups.
    Other tables are written before they are read several times.
    """
    plain = lambda df: df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])
    if largest is not None and largest <= large or total is not None and total <= large:
        return plain(rows.dropna(subset=by))
    known = materialize(rows.dropna(subset=by).select(*by, *columns))
    if known.count() <= large:
        return plain(known)
    sizes = materialize(known.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), *[F.count(c).alias(c) for c in columns]).where(F.col("size") > large))
    if sizes.isEmpty():
        return plain(known)
    small = plain(join_sized(known, sizes.select(*by), by, "left_anti"))
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    each, keys = known.select(*by, melted.alias("m")).select(*by, "m.name", "m.v").where("v IS NOT NULL"), [*by, "name"]
    count = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns])).alias("m")).select(*by, "m.name", "m.n").where("n > 0")
    count = materialize(count)
    lower = materialize(_selected(each, keys, count.select(*keys, F.floor((F.col("n") - 1) / 2).alias("rank"))).join(count, keys))
    alone = lower.where((F.col("n") % 2 == 0) & (F.col("upto") <= F.floor(F.col("n") / 2)))  # the upper middle value is a larger one
    above = each.join(F.broadcast(alone.select(*keys, F.col("v").alias("least"))), keys).where(F.col("v") > F.col("least")).groupBy(*keys).agg(F.min("v").alias("next"))
    middle = lower.join(above, keys, "left").withColumn("v", F.when(F.col("next").isNull(), F.col("v")).otherwise(0.5 * F.col("v") + 0.5 * F.col("next")))
    wide = middle.groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns])
    return small.unionByName(sizes.select(*by).join(wide, by, "left"))


def grouped_medians(rows: DataFrame, by: list[str], columns: list[str], others: list[Column], nan: bool = False, large: int = LARGE, total: int | None = None, largest: int | None = None) -> DataFrame:
    """:func:`exact_medians` beside the aggregates ``others``; with ``nan``, a NaN in a group makes its median NaN.

    A table that is small, or of groups that are (``largest`` bounds them), is one aggregation.
    """
    total = rows.count() if total is None and largest is None else total
    flagged = {c: F.max(F.isnan(c)) for c in columns} if nan else {}
    if largest is not None and largest <= large or total is not None and total <= large:
        median = lambda c: F.when(flagged[c], F.lit(float("nan"))).otherwise(F.median(c)) if nan else F.median(c)
        return rows.groupBy(*by).agg(*[median(c).alias(c) for c in columns], *others)
    flags = [v.alias("nan_" + c) for c, v in flagged.items()]
    both = rows.groupBy(*by).agg(*others, *flags).join(exact_medians(rows, by, columns, large, total, largest), by, "left")
    out = both.withColumns({c: F.when(F.col("nan_" + c), F.lit(float("nan"))).otherwise(F.col(c)) for c in flagged})
    names = [c for c in both.columns if c not in by and c not in columns and not c.startswith("nan_")]
    return out.select(*by, *columns, *names)


def largest_group(rows: DataFrame, by: list[str]) -> int:
    """The size of the largest group, by a count that shuffles a row per group and task."""
    return rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
