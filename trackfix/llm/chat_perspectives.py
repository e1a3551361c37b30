"""Chat formatting by perspective rotation; DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns as the assistant's, everyone
else's as turns of named users, system turns as they are. The mask holds the spans to train on, which are
the assistant's contents with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackfix.session import join_sized, materialize

#: Fixed values of the format.
SYSTEM, ASSISTANT, USER, END = "<|system|>", "<|assistant|>", "<|user|>", "<|end|>"
SYSTEM_ROLE, UNKNOWN_ROLE = "system", "unknown"


def _plain(c: Column) -> Column:
    """Text in which the format's marks cannot occur."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(role: Column) -> Column:
    """What precedes the text of a turn that isn't the perspective's own."""
    name = F.translate(_plain(role), "\n", " ")
    return F.when(role == SYSTEM_ROLE, f"{SYSTEM}\n").otherwise(F.concat(F.lit(USER), name, F.lit("\n")))


def _dealt(known: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """``known`` with ``part`` and ``times``, and the keys by which no group holds many more than ``most`` turns.

    Where no piece needs parts, ``part`` is no key, so that one shuffle of the texts serves grouping and join.

    A piece of more rows, whose turns share numbers or have none, is parted by number, and a number of more
    rows by a hash of role and text. Equal rows are counted first and dealt out ``most`` at a time.
    """
    plain = known.withColumns({"part": F.lit(0).cast("long"), "times": F.lit(1).cast("long")})
    full = materialize(known.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select("conv_id", "piece"))
    if full.isEmpty():
        return plain, ["conv_id", "piece"]
    heavy = join_sized(known, full, ["conv_id", "piece"], "left_semi").groupBy("conv_id", "piece", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))))
    heavy = heavy.withColumn("times", F.least(F.lit(most).cast("long"), F.col("n") - F.col("chunk") * most)).drop("n")
    numbers = materialize(heavy.groupBy("conv_id", "piece", "turn").agg(F.ceil(F.sum("times") / most).cast("long").alias("parts")))
    own = F.pmod(F.xxhash64("role", "text", "chunk"), F.col("parts"))
    heavy = join_sized(heavy, numbers, ["conv_id", "piece", "turn"]).withColumn("part", F.pmod("turn", F.lit(most)) * F.lit(1 << 32) + own)
    return join_sized(plain, full, ["conv_id", "piece"], "left_anti").unionByName(heavy.select(plain.columns)), ["conv_id", "piece", "part"]


def _starts(dealt: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` (``keys``, perspective) with the place of each in its dialogue's whole text."""
    own = F.length(_plain(F.col("text"))) + len(END) + 1
    size = dealt.groupBy(*keys, F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role")).agg(F.sum(F.col("times") * own).alias("body"), F.sum("times").alias("n"))
    size = materialize(size.withColumn("head", F.length(_head(F.col("role")))))
    others = size.groupBy(*keys).agg(F.sum(F.col("body") + F.col("n") * F.col("head")).alias("length"))
    mine = size.select(*keys, F.col("role").alias("perspective"), (F.col("n") * (len(ASSISTANT) + 1 - F.col("head"))).alias("more"))
    length = F.col("length") + F.coalesce("more", F.lit(0))
    before = Window.partitionBy("conv_id", "perspective").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    sized = pieces.join(others, keys).join(mine, [*keys, "perspective"], "left").withColumn("length", length)
    return sized.select(*keys, "perspective", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("start"))


def rotate_perspectives(turns: DataFrame, turns_per_piece: int = 512, offsets: bool = True) -> DataFrame:
    """One row per dialogue, participant and piece: conv_id, perspective, piece, part, start, n_turns, text, mask, n_trained.

    ``turns`` has conv_id, turn, role, text. Participants are the roles of a dialogue other than ``system``
    and null; a null role speaks as the named user ``unknown``. Turns go by number, then role and text; a
    piece holds the turns whose number divided by ``turns_per_piece`` is ``piece``, so that a dialogue of any
    length is dealt out in bounded parts whose texts join to the whole, in order of ``piece`` and ``part``;
    turns without a number come last. A piece of more than ``turns_per_piece`` rows, whose numbers repeat or
    are missing, comes in several parts: by number, and turns of one number by a hash. ``mask`` is
    ``start:end`` spans of the row's text in code points, ends exclusive, comma-joined; ``n_trained`` their
    length; ``start`` is where the row's text begins in the dialogue's (left out without ``offsets``, which
    takes a window over one small row per piece). Null text is empty; ``<|`` in texts and names is rendered
    ``< |``; repeated rows are each rendered. A row without conv_id belongs to no dialogue; a dialogue without
    participants has no perspective. An empty table gives an empty result, and other columns are ignored.

    The text is shuffled once, by dialogue and piece; who takes part is worked out from ids and roles alone.
    """
    known = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / turns_per_piece), F.lit(1 << 52)).cast("long").alias("piece"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        "role",
        "text",
    )
    dealt, keys = _dealt(known, turns_per_piece)
    speakers = known.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM_ROLE)).select("conv_id", F.col("role").alias("perspective")).distinct()
    pieces = dealt.select(*keys).distinct().join(speakers, "conv_id")
    if offsets:
        pieces = _starts(dealt, materialize(pieces), keys)
    entry = F.struct("turn", F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role"), _plain(F.col("text")).alias("text"), F.col("times").cast("int").alias("times"))
    gathered = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    joined = gathered.join(pieces, keys).withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(t, t["times"]))))

    def rendered(t: Column) -> Column:
        mine = t["role"] == F.col("perspective")
        head = F.when(mine, f"{ASSISTANT}\n").otherwise(_head(t["role"]))
        return F.struct(head.alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), mine.alias("mine"))

    segments = joined.withColumn("s", F.transform("turns", rendered))
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        begin = a["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(s["mine"], a["n"] + end - begin).otherwise(a["n"]).alias("n"), F.when(s["mine"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    masked = segments.withColumn("m", F.aggregate("s", nothing, step))
    text = F.array_join(F.transform("s", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), "")
    start = ["start"] if offsets else []
    part = F.col("part") if "part" in keys else F.lit(0).cast("long")
    return masked.select("conv_id", "perspective", "piece", part.alias("part"), *start, F.size("s").cast("long").alias("n_turns"), text.alias("text"), F.array_join("m.spans", ",").alias("mask"), F.col("m.n").cast("long").alias("n_trained"))
