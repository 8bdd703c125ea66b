"""Chat and webhook payloads of new entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.functions.text import json_string
from feedspark.model import ORDINALS
from feedspark.sinks.jsonfeed import write_jsonfeed

SHOWN = 10
# The content limit of one chat service.
CONTENT_LIMIT = 2000


def sink_kind(url: Column) -> Column:
    return (
        F.when(F.contains(url, F.lit("slack.com")), "slack")
        .when(
            F.contains(url, F.lit("discord.com")) | F.contains(url, F.lit("discordapp.com")),
            "discord",
        )
        .otherwise("webhook")
    )


def message_text(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Header, at most ten bullets and an overflow line per feed that has entries.

    Counting is an aggregate of its own; the rank window keeps ten rows per feed and task.
    """
    window = Window.partitionBy("feed_id").orderBy(*ORDINALS)
    counts = entries.groupBy("feed_id").agg(F.count("*").alias("_n"))
    bullet = F.concat(F.lit("• "), "title", F.lit(" - "), "link")
    top = (
        entries.select("feed_id", *ORDINALS, "title", "link")
        .withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= SHOWN)
        .groupBy("feed_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", bullet.alias("line")))).alias("_top"))
    )
    more = F.when(
        F.col("_n") > SHOWN,
        F.concat(F.lit("…and "), (F.col("_n") - SHOWN).cast("string"), F.lit(" more")),
    )
    text = F.concat_ws(
        "\n",
        F.concat("title", F.lit(": "), F.col("_n").cast("string"), F.lit(" new")),
        F.transform("_top", lambda t: t["line"]),
        more,
    )
    joined = feeds.select("feed_id", "title").join(counts, "feed_id").join(top, "feed_id")
    return joined.select("feed_id", "_n", text.alias("text"))


def chat_payloads(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Bodies for both chat services, one row per feed and kind."""
    messages = message_text(feeds, entries)
    slack = F.concat(F.lit('{"text":'), json_string(F.col("text")), F.lit("}"))
    content = F.substring("text", 1, CONTENT_LIMIT)
    discord = F.concat(F.lit('{"content":'), json_string(content), F.lit("}"))
    kinds = F.array(
        F.struct(F.lit("slack").alias("kind"), slack.alias("body")),
        F.struct(F.lit("discord").alias("kind"), discord.alias("body")),
    )
    return messages.select("feed_id", F.explode(kinds).alias("_p")).select(
        "feed_id", "_p.kind", F.lit("application/json").alias("content_type"), "_p.body"
    )


def webhook_payloads(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """The new entries of a feed as one JSON Feed document; feeds without entries send nothing.

    A body comes in numbered parts, like every written document.
    """
    active = feeds.join(entries.select("feed_id").distinct(), "feed_id")
    return write_jsonfeed(active, entries).select(
        "feed_id",
        "part_no",
        F.lit("webhook").alias("kind"),
        F.lit("application/feed+json").alias("content_type"),
        "body",
    )
