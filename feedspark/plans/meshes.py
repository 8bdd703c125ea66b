"""The whole way: mesh definitions and fetched documents to refined, merged feeds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.operators import definitions as defs
from feedspark.operators import merge
from feedspark.operators.filters import FilterSpec
from feedspark.operators.refine import Select, refine
from feedspark.session import materialize
from feedspark.sinks.formats import serialize
from feedspark.sources.cascade import extract, final_urls

GROUPS = ["construct", "mesh_ord", "mesh_name"]


@dataclass
class Fetched:
    """Entries of all meshes, tagged and merged, with what went wrong on the way."""

    entries: DataFrame
    health: DataFrame
    rejects: DataFrame


def fetch_meshes(
    sources: DataFrame,
    documents: DataFrame,
    templates: DataFrame | None,
    limit: int | None = None,
) -> Fetched:
    """Every source of every mesh extracted, tagged with its source, merged per mesh.

    ``sources`` has one row per source: construct, mesh_ord, mesh_name, source_ord,
    source_name, source_url. A document used by several meshes is extracted once.
    """
    # Documents that are no source themselves may still be the declared feed of one.
    fetched = documents.filter(F.col("error").isNull())
    entries, failed = extract(fetched, templates)
    entries = entries.withColumnRenamed("entry_ord", "_pos").withColumnRenamed("source_url", "final_url")

    listed = sources.select(*GROUPS, "source_ord", "source_name", "source_url")
    # Sources name requested URLs, entries the URLs where their documents were found.
    arrived = final_urls(fetched).withColumnRenamed("requested_url", "source_url")
    tagged = listed.join(arrived, "source_url").join(entries.drop("source"), "final_url").select(
        *GROUPS,
        F.col("source_ord").alias("part_ord"),
        F.col("_pos").alias("entry_ord"),
        *[c for c in merge.ENTRY_COLUMNS if c != "source"],
        merge.source_label(
            F.col("source_name"), F.col("source_url"), F.lit(None).cast("string"), F.lit(None).cast("string")
        ).alias("source"),
    )
    merged = merge.newest(merge.merge_entries(tagged, ["construct", "mesh_ord"]), limit, ["construct", "mesh_ord"])

    problems = failed.select(F.col("key").alias("final_url"), F.col("reason").alias("problem"))
    fanned = defs.fan_out(listed, documents.select("requested_url", "final_url", "error"))
    checked = fanned.join(problems, "final_url", "left").withColumn(
        "error", F.coalesce("error", "problem")
    )
    checked = materialize(checked)
    return Fetched(merged, defs.source_health(checked, GROUPS), defs.split_failures(checked)[1])


def mesh_documents(
    fetched: Fetched,
    fmt: str,
    now: datetime,
    spec: FilterSpec = FilterSpec(),
    select: Select = Select(),
) -> DataFrame:
    """One document per mesh after rules and time window, written in a format.

    Sort and limit of a selection apply to single feeds and are not used here; the
    per-mesh limit belongs to ``fetch_meshes``.
    """
    kept = refine(fetched.entries, spec, Select(window=select.window))
    feed_id = F.concat_ws("/", "construct", "mesh_name")
    head = merge.merged_header(kept, F.col("mesh_name"), now, ["construct", "mesh_name"])
    feeds = head.select(
        feed_id.alias("feed_id"),
        F.col("mesh_name").alias("title"),
        F.lit(None).cast("string").alias("home"),
        F.lit(None).cast("string").alias("self"),
        "updated",
        F.lit(None).cast("array<struct<name:string,url:string,email:string>>").alias("authors"),
        "generator",
    )
    return serialize(feeds, kept.withColumn("feed_id", feed_id), fmt)
