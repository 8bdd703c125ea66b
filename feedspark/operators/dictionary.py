"""Per-feed dictionaries of authors, tags and sources, and the shared link prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import cell_encode
from feedspark.model import ORDINALS
from feedspark.operators.ranking import peak_size, positions

# Sub-field separator and line kinds of the compact format.
UNIT = "\x1f"
AUTHOR, TAG, SOURCE = "A", "T", "S"


def _cell(*fields: Column) -> Column:
    """Encoded sub-fields; blank ones at the end are left off."""
    encoded = [cell_encode(F.coalesce(f, F.lit(""))) for f in fields]
    return F.regexp_replace(F.concat_ws(UNIT, *encoded), UNIT + "+$", "")


def author_cell(p: Column) -> Column:
    return _cell(p["name"], p["url"], p["email"])


def source_cell(s: Column) -> Column:
    return _cell(s["name"], s["url"])


def _numbered(kind: str, cells: Column) -> Column:
    return F.coalesce(
        F.transform(
            cells,
            lambda cell, i: F.struct(
                F.lit(kind).alias("kind"), i.cast("int").alias("idx"), cell.alias("cell")
            ),
        ),
        F.array().cast("array<struct<kind:string,idx:int,cell:string>>"),
    )


def mentions(entries: DataFrame) -> DataFrame:
    """One row per author, tag and source of each entry."""
    source = source_cell(F.col("source"))
    found = F.concat(
        _numbered(AUTHOR, F.transform("authors", author_cell)),
        _numbered(TAG, F.transform("tags", cell_encode)),
        _numbered(SOURCE, F.when(source != "", F.array(source))),
    )
    return entries.select("feed_id", *ORDINALS, F.explode(found).alias("_m")).select(
        "feed_id", *ORDINALS, "_m.*"
    )


def feed_mentions(feeds: DataFrame) -> DataFrame:
    """Feed authors come before all entries."""
    found = _numbered(AUTHOR, F.transform("authors", author_cell))
    return feeds.select(
        "feed_id",
        F.lit(-1).alias("part_ord"),
        F.lit(-1).cast("long").alias("entry_ord"),
        F.explode(found).alias("_m"),
    ).select("feed_id", *ORDINALS, "_m.*")


def peak_mentions(entries: DataFrame) -> int:
    """Bound on entries plus mentions of one feed, from list sizes alone."""
    weight = F.lit(2) + F.greatest(F.size("authors"), F.lit(0)) + F.greatest(F.size("tags"), F.lit(0))
    return peak_size(entries, ["feed_id"], weight)


def intern(found: DataFrame, peak: int | None = None) -> DataFrame:
    """Distinct values numbered by first appearance: feed_id, kind, cell, ref.

    Mentions are reduced to one row per value on the map side before numbering.
    """
    first = found.groupBy("feed_id", "kind", "cell").agg(
        F.min(F.struct(*ORDINALS, "idx")).alias("first_seen")
    )
    ranked = positions(first, ["feed_id", "kind"], [F.col("first_seen")], "ref", peak)
    return ranked.drop("first_seen")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two texts."""
    shared = F.least(F.length(a), F.length(b))
    differs = F.filter(
        F.sequence(F.lit(1), shared),
        lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)),
    )
    length = F.coalesce(F.array_min(differs) - 1, shared)
    return F.when(shared > 0, F.substring(a, F.lit(1), length)).otherwise(F.lit(""))


def link_base(entries: DataFrame) -> DataFrame:
    """Shared link prefix per feed, cut at a slash behind the host; blank if there is none.

    The least and the greatest link share what all links share, so two partial
    aggregates do.
    """
    ends = entries.groupBy("feed_id").agg(
        F.min("link").alias("_low"), F.max("link").alias("_high"), F.count("*").alias("_n")
    )
    prefix = ends.withColumn("_prefix", common_prefix(F.col("_low"), F.col("_high")))
    folder = F.regexp_extract("_prefix", r"(?s)^(.*/)", 1)
    kept = (F.col("_n") >= 2) & (F.length(folder) > 9)
    return prefix.select("feed_id", F.when(kept, folder).otherwise(F.lit("")).alias("base"))
