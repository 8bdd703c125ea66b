"""What pages and lists show: ranks, palette slots, slugs, mesh summaries, tag counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.functions.dates import day_label, epoch, merge_time
from feedspark.functions.text import slug
from feedspark.model import ORDINALS
from feedspark.operators.merge import newest_first
from feedspark.operators.ranking import positions

PALETTE_SIZE = 6
PREVIEW = 3


def ranked_list(entries: DataFrame, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Display rank, counted from one."""
    return positions(entries, keys or [], order, "rank").withColumn("rank", F.col("rank") + 1)


def source_palette(entries: DataFrame, label: Column) -> DataFrame:
    """Palette slot of each source in order of first appearance.

    Entries are reduced to one row per source before anything is ranked.
    """
    first = entries.groupBy(label.alias("source_name")).agg(
        F.min(F.struct(*ORDINALS)).alias("first_seen")
    )
    ranked = positions(first, [], [F.col("first_seen")], "slot")
    return ranked.select("source_name", (F.col("slot") % PALETTE_SIZE).alias("slot"))


def mesh_slugs(meshes: DataFrame, group: str) -> DataFrame:
    """File stems of the meshes of a construct; the k-th repeat of a stem gets ``-k``."""
    stemmed = meshes.withColumn("stem", slug(F.col("mesh_name"), F.col("mesh_ord")))
    ranked = positions(stemmed, [group, "stem"], [F.col("mesh_ord")], "repeat")
    suffix = F.when(
        F.col("repeat") > 0, F.concat(F.lit("-"), (F.col("repeat") + 1).cast("string"))
    ).otherwise(F.lit(""))
    return ranked.withColumn("slug", F.concat("stem", suffix)).drop("stem", "repeat")


def mesh_overview(grouped: DataFrame, meshes: DataFrame) -> DataFrame:
    """Per mesh: slug, day of the newest entry, counts and the first three titles.

    ``meshes`` holds construct, mesh_ord, mesh_name and source_count. Counts and titles
    come from one aggregation over a three-row window and one over all rows.
    """
    keys = ["construct", "mesh_ord"]
    time = merge_time(F.col("published"), F.col("updated"))
    totals = grouped.groupBy(*keys).agg(
        F.count("*").alias("entry_count"), F.max(F.when(time > epoch(), time)).alias("updated")
    )
    window = Window.partitionBy(*keys).orderBy(*newest_first())
    top = (
        grouped.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= PREVIEW)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "title"))).alias("_top"))
        .select(*keys, F.transform("_top", lambda t: t["title"]).alias("preview"))
    )
    return (
        mesh_slugs(meshes, "construct")
        .join(totals, keys, "left")
        .join(top, keys, "left")
        .select(
            *keys,
            "mesh_name",
            "slug",
            day_label(F.col("updated")).alias("updated_day"),
            F.coalesce("entry_count", F.lit(0)).alias("entry_count"),
            "source_count",
            F.coalesce("preview", F.array().cast("array<string>")).alias("preview"),
        )
    )


def construct_totals(overview: DataFrame) -> DataFrame:
    """Meshes, entries and newest day of each construct."""
    return overview.groupBy("construct").agg(
        F.count("*").alias("mesh_count"),
        F.sum("entry_count").alias("entry_count"),
        F.max("updated_day").alias("updated_day"),
    )


def tag_counts(entries: DataFrame) -> DataFrame:
    """Entries per tag."""
    return entries.select(F.explode("tags").alias("tag")).groupBy("tag").count()
