"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Sources are ranked by name (code points, null last) and weighed. All weights together share
``share`` times the words of the corpus; a source whose part would repeat it more than
``most_epochs`` times is clamped there, and what it leaves over is dealt to the others by
weight until no source is above. The whole state of that loop is one number, the words per
unit of weight, so a round is one aggregate over the sources.

A target is met by whole repetitions of a source and a fractional one. For the latter every
row draws a number from its id and text. Rows are taken in the order of their draws as long
as they fit. At the first row too long for the room left, a new phase goes on behind it with
the rows that are no longer than that room; the last phase is the one after which the room is
at most ``NEAR`` of the target, or no row is left. Nothing is sorted for this: the words of a
source are summed by slices of the draws, and only the slice in which the room runs out is
divided further. A hot source adds rows to sums that are formed before the shuffle.

Defined results. A null or blank text has size 0 and is taken 0 words. Rows of one source with
the same id and text draw the same number: they are taken together or not at all. A null id
draws by its text. The null source is a source of its own; so is the empty name. Very long
texts are rows like others: one that is longer than its source's room is not taken. A source
without words has target 0. Further columns are untouched by ``repeated`` and unread elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import dropped, stored, text_of, words
from feedspark.operators.ranking import spread_positions

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
NEAR = 0.001
SEED = "mix"
DIGITS = 15
END = 16**DIGITS
"""Draws are below this: so many hexadecimal digits of a digest."""
SLICES = 4096
PLAN_ROWS = 50_000
PLAN_BYTES = 16 << 20
"""A plan is broadcast only when rows and bytes are counted to be within both."""


def cycled(weights: tuple[float, ...] = WEIGHTS) -> Column:
    """Weights that repeat along the ranked sources."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return F.get(listed, F.pmod("rank", F.lit(len(weights))).cast("int"))


def _size() -> Column:
    return F.size(words(text_of("text"))).cast("long")


def _draw(seed: str) -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), name, F.md5(text_of("text"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def drawn(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, draw`` of every row: all that the plan reads."""
    return docs.select("doc_id", "source", _size().alias("size"), _draw(seed).alias("draw"))


def level(sources: DataFrame, share: float, most_epochs: float) -> float | None:
    """Words per unit of weight once no source is above its cap; None if all are at it."""
    size, weight = F.col("source_size"), F.col("weight")
    total = sources.agg(F.sum(size)).first()[0] or 0
    found = None
    while True:
        over = F.lit(False) if found is None else size * most_epochs < weight * F.lit(found)
        clamped, open_weight = sources.agg(F.sum(F.when(over, size)), F.sum(F.when(~over, weight))).first()
        if not open_weight:
            return None
        now = (total * share - (clamped or 0) * most_epochs) / open_weight
        if now == found:
            return found
        found = now


def targets(rows: DataFrame, weight: Column, share: float, most_epochs: float) -> DataFrame:
    """``source, source_size, weight, target, whole``, stored; ``rows`` are those of ``drawn``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = spread_positions(sizes, [], [F.asc_nulls_last("source")], "rank")
    sources = stored(ranked.withColumn("weight", weight.cast("double")))
    found = level(sources, share, most_epochs)
    cap, size = F.col("source_size") * most_epochs, F.col("source_size")
    part = cap if found is None else F.least(cap, F.col("weight") * F.lit(found))
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    return sources.withColumn("target", part).withColumn("whole", whole)


def _beside(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the plan to rows by source; large plans stay shuffle joins, whose skew is split."""
    width = F.coalesce(F.octet_length("source"), F.lit(0)) + 64 + 24 * F.size("ranges")
    count, size = plan.agg(F.count("*"), F.sum(width)).first()
    if count <= PLAN_ROWS and (size or 0) <= PLAN_BYTES:
        plan = F.broadcast(plan)
    plan = plan.withColumnRenamed("source", "_source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _narrowed(rows: DataFrame, plan: DataFrame, near: float) -> DataFrame:
    """One step for every source whose room is still to be filled.

    A state is the room, the interval of draws looked at (``lo`` to ``hi``) and the longest
    row of the phase (``most``).
    """
    slice_ = F.floor((F.col("draw") - F.col("lo")) / F.col("step")).cast("long")
    inside = (F.col("draw") >= F.col("lo")) & (F.col("draw") < F.col("hi")) & (F.col("size") <= F.col("most"))
    state = plan.filter("open").select("source", "lo", "hi", "most", "room", "step", "ranges")
    sums = (
        _beside(rows.filter("size > 0"), state)
        .filter(inside)
        .groupBy("source", "room", slice_.alias("slice"))
        .agg(F.sum("size").alias("words"), F.min("draw").alias("first"), F.max("draw").alias("last"))
    )
    # A source has at most SLICES + 1 sums; the sums before the one that overflows are taken.
    placed = sums.groupBy("source", "room").agg(F.array_sort(F.collect_list(F.struct("slice", "words", "first", "last"))).alias("s"))
    start = F.struct(
        F.lit(0).cast("long").alias("taken"),
        F.lit(None).cast("struct<slice:bigint,words:bigint,first:bigint,last:bigint>").alias("over"),
    )
    walked = F.aggregate(
        "s",
        start,
        lambda a, x: F.when(a["over"].isNotNull(), a)
        .when(a["taken"] + x["words"] > F.col("room"), F.struct(a["taken"].alias("taken"), x.alias("over")))
        .otherwise(F.struct((a["taken"] + x["words"]).alias("taken"), a["over"].alias("over"))),
    )
    steps = placed.select(F.col("source").alias("_source"), walked.alias("w"))
    joined = plan.join(steps, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    over, open_ = F.col("w.over"), F.col("open")
    left = F.col("room") - F.coalesce(F.col("w.taken"), F.lit(0))
    bound = F.when(over.isNull(), F.col("hi")).otherwise(F.col("lo") + over["slice"] * F.col("step"))
    single = over["first"] == over["last"]
    taken = F.struct(F.col("lo"), bound.alias("hi"), F.col("most"))
    after = joined.select(
        *[c for c in plan.columns if c not in ("room", "lo", "hi", "most", "step", "ranges", "open")],
        F.when(open_, left).otherwise(F.col("room")).alias("room"),
        F.when(over.isNull(), F.col("lo")).when(single, over["first"] + 1).otherwise(bound).alias("lo"),
        F.when(over.isNull() | single, F.lit(END)).otherwise(F.least(F.col("hi"), bound + F.col("step"))).alias("hi"),
        F.when(over.isNotNull() & single, left).otherwise(F.col("most")).alias("most"),
        F.when(open_ & F.col("w").isNotNull(), F.array_append("ranges", taken)).otherwise(F.col("ranges")).alias("ranges"),
        (open_ & over.isNotNull() & (~single | (left > F.col("target") * near))).alias("open"),
    )
    return after.withColumn("step", _step())


def _step() -> Column:
    return F.ceil((F.col("hi") - F.col("lo")) / SLICES).cast("long")


def planned(
    rows: DataFrame,
    weight: Column | None = None,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    near: float = NEAR,
) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, ranges``.

    A row is taken ``whole`` times, and once more if a range holds its draw and admits its
    size. ``rows`` are those of ``drawn``, stored.
    """
    aims = targets(rows, cycled() if weight is None else weight, share, most_epochs)
    plan = (
        aims.withColumn("room", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
        .withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(END).cast("long"), "most": F.col("room")})
        .withColumn("step", _step())
        .withColumn("ranges", F.array().cast("array<struct<lo:bigint,hi:bigint,most:bigint>>"))
        .withColumn("open", F.col("room") > F.col("target") * near)
    )
    plan = stored(plan)
    while plan.filter("open").limit(1).count():
        after = stored(_narrowed(rows, plan, near))
        dropped(plan)
        plan = after
    return plan.select("source", "source_size", "target", "whole", "ranges")


def _copies() -> Column:
    more = F.exists("ranges", lambda r: (F.col("draw") >= r["lo"]) & (F.col("draw") < r["hi"]) & (F.col("size") <= r["most"]))
    return F.col("whole") + more.cast("long")


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row of ``drawn``."""
    out = _beside(rows, plan).withColumn("copies", _copies())
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", "size", "source_size", "target", "copies", taken)


def repeated(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the plan takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, "source", _size().alias("size"), _draw(seed).alias("draw"))
    out = _beside(rows, plan).withColumn("copies", _copies())
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")
