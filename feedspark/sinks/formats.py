"""The registry of document formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.sinks.assemble import PART_BYTES
from feedspark.sinks.feedfiles import NAME, FeedFiles

# Format keys with media types and file extensions.
MEDIA_TYPES = {
    "atom": "application/atom+xml; charset=utf-8",
    "rss": "application/rss+xml; charset=utf-8",
    "json": "application/feed+json; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "nwf": "text/plain; charset=utf-8",
}
EXTENSIONS = {"atom": "xml", "rss": "xml", "json": "json", "md": "md", "nwf": "nwf"}
FORMATS = tuple(MEDIA_TYPES)


def is_format(name: str) -> bool:
    return name in MEDIA_TYPES


def serialize(feeds: DataFrame, entries: DataFrame, fmt: str) -> DataFrame:
    """Documents of one format: feed_id, part_no, media_type, extension, body."""
    from feedspark.sinks import compact, jsonfeed, markdown, xmlfeeds

    writers = {
        "atom": xmlfeeds.write_atom,
        "rss": xmlfeeds.write_rss,
        "json": jsonfeed.write_jsonfeed,
        "md": markdown.write_markdown,
        "nwf": compact.write_compact,
    }
    if fmt not in writers:
        raise ValueError(f'unknown format "{fmt}". Use one of: {", ".join(FORMATS)}')
    return writers[fmt](feeds, entries).select(
        "feed_id",
        "part_no",
        F.lit(MEDIA_TYPES[fmt]).alias("media_type"),
        F.lit(EXTENSIONS[fmt]).alias("extension"),
        "body",
    )


def serialize_by(feeds: DataFrame, entries: DataFrame, by: str = "format") -> tuple[DataFrame, DataFrame]:
    """Documents of feeds that each name their format in column ``by``, and rejects of unknown formats.

    Each format reads the feeds and entries that ask for it; a feed is written once.
    """
    documents = []
    for fmt in FORMATS:
        own = feeds.filter(F.col(by) == fmt).drop(by)
        asked = entries.join(own.select("feed_id"), "feed_id", "left_semi")
        documents.append(serialize(own, asked, fmt).withColumn(by, F.lit(fmt)))
    rejects = feeds.filter(F.col(by).isNull() | ~F.col(by).isin(*FORMATS)).select(
        F.lit("format").alias("stage"),
        F.col("feed_id").alias("key"),
        F.concat(F.lit('unknown format "'), F.coalesce(by, F.lit("")), F.lit('"')).alias("reason"),
    )
    return reduce(DataFrame.unionByName, documents), rejects


def save(documents: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write documents as files, one per feed, whatever their size.

    A feed is streamed by one task, part by part.
    """
    documents.sparkSession.dataSource.register(FeedFiles)
    parts = documents.select("feed_id", "extension", "part_no", "body")
    dealt = parts.repartition("feed_id", "extension").sortWithinPartitions("feed_id", "extension", "part_no")
    dealt.write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def load(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The files of a folder as documents in numbered parts: ``feed_id``, ``part_no``, ``body``."""
    spark.dataSource.register(FeedFiles)
    return spark.read.format(NAME).option("part_bytes", part_bytes).load(path)
