"""Merging many feeds into one: tagging, first-wins dedup, newest-first order, header."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import epoch, merge_time
from feedspark.functions.ids import merge_key, merged_feed_id
from feedspark.functions.urls import resolve_url
from feedspark.model import ENTRY_COLUMNS, GENERATOR, ORDINALS, nonempty, present
from feedspark.operators.ranking import top_rows

ID_NAMESPACE = "urn:feed:mesh:"
"""Default prefix of merged-feed ids; pass another to keep ids of an earlier deployment."""


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Concatenate feeds; ``part_ord`` records their order."""
    numbered = [p.withColumn("part_ord", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def source_label(name: Column, url: Column, feed_title: Column, feed_home: Column) -> Column:
    """Label of a part: its own, else the feed's title and home; blanks are left out."""
    return F.struct(
        nonempty(F.coalesce(name, feed_title)).alias("name"),
        nonempty(F.coalesce(url, feed_home)).alias("url"),
    )


def newest_first(*first: str) -> list[Column]:
    """Merge order: newest first, ties in input order; undated entries count as the epoch."""
    time = merge_time(F.col("published"), F.col("updated"))
    return [F.col(c) for c in first] + [time.desc()] + [F.col(c) for c in ORDINALS]


def dedup_first(entries: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Keep the first row per key in the given order.

    The rank-one window is cut down to one row per key and partition before the shuffle,
    so a key shared by a third of all rows sends one row per task.
    """
    return top_rows(entries, keys, order, 1)


def merge_entries(entries: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """First-wins dedup by link, else id, inside each group."""
    keyed = entries.withColumn("_key", merge_key(F.col("link"), F.col("id")))
    return dedup_first(keyed, [*(groups or []), "_key"], ORDINALS).drop("_key")


def newest(entries: DataFrame, limit: int | None, groups: list[str] | None = None) -> DataFrame:
    """The newest ``limit`` entries, per group if groups are given; 0 means no limit."""
    if not limit:
        return entries
    if not groups:
        return entries.orderBy(*newest_first()).limit(limit)
    return top_rows(entries, groups, newest_first(), limit)


def merge_feeds(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """All parts as one feed, newest first."""
    merged = newest(merge_entries(entries), limit)
    return merged.orderBy(*newest_first())


def merged_header(
    entries: DataFrame,
    title: Column,
    now: datetime,
    groups: list[str],
    namespace: str = ID_NAMESPACE,
    generator: tuple[str, str] = ("feedspark", "0.1.0"),
) -> DataFrame:
    """One header per merged feed; ``updated`` is the newest time after the epoch, else now."""
    time = merge_time(F.col("published"), F.col("updated"))
    return (
        entries.groupBy(*groups)
        .agg(
            F.max(F.when(time > epoch(), time)).alias("_newest"),
            F.count("*").alias("entry_count"),
        )
        .select(
            *groups,
            merged_feed_id(title, namespace).alias("feed_id"),
            title.alias("title"),
            F.coalesce("_newest", F.lit(now)).alias("updated"),
            F.struct(*[F.lit(v).alias(f) for v, f in zip(generator, GENERATOR.fieldNames())]).alias(
                "generator"
            ),
            "entry_count",
        )
    )


def grouped_construct(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """One merged feed per mesh: the merge with the mesh in every key."""
    groups = ["construct", "mesh_ord"]
    return newest(merge_entries(entries, groups), limit, groups)


def flatten_construct(grouped: DataFrame, limit: int | None = None) -> DataFrame:
    """Merge the merged meshes of each construct, labelled by mesh.

    First wins by mesh, then by position in that mesh's newest-first list; the order
    itself is compared, so no position has to be numbered.
    """
    keyed = (
        grouped.withColumn("_key", merge_key(F.col("link"), F.col("id")))
        .withColumn("source", F.struct(F.col("mesh_name").alias("name"), F.lit(None).cast("string").alias("url")))
        .withColumn("_time", merge_time(F.col("published"), F.col("updated")))
    )
    order = [F.col("mesh_ord"), F.col("_time").desc(), *[F.col(c) for c in ORDINALS]]
    flat = dedup_first(keyed, ["construct", "_key"], order).drop("_key", "_time")
    if limit:
        time = merge_time(F.col("published"), F.col("updated"))
        newest_of_all = [time.desc(), *[F.col(c) for c in ("mesh_ord", *ORDINALS)]]
        flat = top_rows(flat, ["construct"], newest_of_all, limit)
    return flat


def newest_entry(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Newest ``updated``-else-``published`` per feed."""
    return entries.groupBy(*keys).agg(F.max(F.coalesce("updated", "published")).alias("newest"))


def finalize_feeds(feeds: DataFrame, entries: DataFrame, now: datetime) -> DataFrame:
    """Fill feed defaults; ``source_url`` is the document the feed came from.

    Entry dates are reduced to one row per feed before the join.
    """
    dated = newest_entry(entries, ["source_url"])
    joined = feeds.join(dated, "source_url", "left")
    return joined.select(
        "source_url",
        F.coalesce(present(F.col("feed_id")), F.col("source_url")).alias("feed_id"),
        F.coalesce(present(F.col("title")), F.lit("Untitled")).alias("title"),
        F.when(nonempty(F.col("home")).isNotNull(), resolve_url(F.col("home"), F.col("source_url"))).alias("home"),
        nonempty(F.col("self")).alias("self"),
        F.coalesce("updated", "newest", F.lit(now)).alias("updated"),
        F.when(F.size("authors") > 0, F.col("authors")).alias("authors"),
        F.struct(F.lit("feedspark").alias("name"), F.lit("0.1.0").alias("version")).alias("generator"),
    )


def explode_entries(feeds: DataFrame, keys: list[str]) -> DataFrame:
    """Nested feeds to entry rows, with positions kept."""
    rows = feeds.select(*keys, F.posexplode("entries").alias("entry_ord", "_entry"))
    return rows.select(
        *keys,
        F.col("entry_ord").cast("long").alias("entry_ord"),
        *[F.col(f"_entry.{c}").alias(c) for c in ENTRY_COLUMNS],
    )
