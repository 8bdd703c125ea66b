"""Positions inside groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.session import materialize, small_side

GROUP_ROWS = 1_000_000
"""Largest group a single window task is trusted with."""


def spread_positions(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Zero-based position inside each group, with every group spread over many tasks.

    Rows are range-partitioned on (keys, order), so a hot group spans as many partitions
    as it needs. Only one count per (group, partition) is then accumulated to an offset.
    The sorted rows are checkpointed: counts and positions must see the same partitions.
    """
    by = [F.col(k) for k in keys] + order
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_block", F.shiftright("_row", 33))
    spans = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        if keys
        else Window.partitionBy(F.lit(0))
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = spans.select(*keys, "_block", (before - F.col("_first")).alias("_offset"))
    return (
        rows.join(small_side(offsets), [*keys, "_block"])
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_row", "_block", "_offset")
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    peak: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add sums over the rows before each row of its group; keys must not be null.

    A window does it while every group is small enough for one task (``peak`` is a known
    bound on the rows of a group). Larger groups are range-partitioned on (keys, order), and
    only one total per group and partition is accumulated.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    if (peak_size(df, keys) if peak is None else peak) <= group_rows:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({name: zero(F.sum(weight).over(before)) for name, weight in sums.items()})
    by = [F.col(k) for k in keys] + order
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = materialize(ordered.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_block", F.shiftright("_row", 33))
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(w).alias(f"_{n}") for n, w in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", *[zero(F.sum(f"_{n}").over(earlier)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: zero(F.sum(w).over(inside)) for n, w in sums.items()})
    out = local.join(small_side(offsets), [*keys, "_block"])
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_row", "_block", *[f"_{n}" for n in sums])


def top_rows(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group.

    Up to the planner's threshold every task cuts its rows to the limit before the
    shuffle. A larger limit could leave a hot group whole, so positions are used there.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if limit > threshold:
        return positions(df, keys, order, "_rank").filter(F.col("_rank") < limit).drop("_rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def peak_size(df: DataFrame, keys: list[str], weight: Column | None = None) -> int:
    """Largest group size (or summed weight); partially aggregated, keys and weight only."""
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = df.groupBy(*keys).agg(size.alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def positions(
    df: DataFrame,
    keys: list[str],
    order: list,
    name: str,
    peak: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Zero-based position inside each group.

    A window does it while every group is small enough for one task. ``peak`` is a known
    bound on the group size; without one the sizes are counted. Larger groups take the
    spread form.
    """
    if (peak_size(df, keys) if peak is None else peak) > group_rows:
        return spread_positions(df, keys, order, name)
    window = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("long") - 1)
