"""What all feed readers share: one raw form of feeds and items, finished in one place.

A format only says where its fields are. Dates, links, markup and ids are worked out
once, on exploded rows, whatever the format was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import norm_date
from feedspark.functions.ids import with_stable_id
from feedspark.functions.text import strip_html
from feedspark.functions.urls import resolve_url
from feedspark.model import PERSON, as_entries, nonempty, nonempty_list, present

PEOPLE = f"array<{PERSON.simpleString()}>"
ITEM_FIELDS = {
    "id": "string",
    "title": "string",
    "href": "string",
    "published": "string",
    "updated": "string",
    "summary": "string",
    "markup": "string",
    "plain": "string",
    "authors": PEOPLE,
    "tags": "array<string>",
}
FEED_FIELDS = {
    "feed_id": "string",
    "title": "string",
    "home": "string",
    "self": "string",
    "updated": "string",
    "authors": PEOPLE,
}
ENTRY_KEYS = ["source_url", "entry_ord"]


def _struct(fields: dict[str, str], given: dict[str, Column]) -> Column:
    return F.struct(
        *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()]
    )


def raw_item(**given: Column) -> Column:
    """Raw fields of an item. ``summary`` stays as it is, ``markup`` is stripped, ``plain`` comes last."""
    return _struct(ITEM_FIELDS, given)


def raw_feed(**given: Column) -> Column:
    return _struct(FEED_FIELDS, given)


def person(name: Column, url: Column | None = None, email: Column | None = None) -> Column:
    absent = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        (absent if url is None else url).alias("url"),
        (absent if email is None else email).alias("email"),
    )


def one_person(name: Column) -> Column:
    """A list of one named person, absent when the name is."""
    return F.when(name.isNotNull(), F.array(person(name)))


def one_text(values: Column) -> Column:
    """Text of an element that occurs once; a repeated element reads as absent."""
    return F.when(F.size(values) == 1, present(values.getItem(0)))


def some(values: Column) -> Column:
    """A list without absent members, itself absent when nothing is left."""
    return nonempty_list(F.filter(values, lambda x: x.isNotNull()))


def explode_list(df: DataFrame, keys: list[str], values: Column, ordinal: str, name: str) -> DataFrame:
    """One row per list member with its position.

    The outer form keeps the optimizer from testing the list for emptiness beforehand,
    which would evaluate the whole parse a second time.
    """
    rows = df.select(*keys, F.posexplode_outer(values).alias(ordinal, name))
    return rows.filter(F.col(ordinal).isNotNull()).withColumn(ordinal, F.col(ordinal).cast("long"))


def finish_entries(items: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Entries of raw items: source_url, entry_ord and the item fields as columns."""
    linked = items.select(
        *ENTRY_KEYS,
        *extra,
        F.coalesce("id", F.lit("")).alias("id"),
        "title",
        resolve_url(F.coalesce("href", F.lit("")), F.col("source_url")).alias("link"),
        norm_date(F.col("published")).alias("published"),
        norm_date(F.col("updated")).alias("updated"),
        nonempty(F.coalesce(F.col("summary"), strip_html(F.col("markup")), F.col("plain"))).alias("summary"),
        nonempty_list(F.col("authors")).alias("authors"),
        nonempty_list(F.col("tags")).alias("tags"),
    )
    filled = linked.withColumn("id", with_stable_id(F.col("id"), F.col("link"), F.col("title")))
    return as_entries(filled, [*ENTRY_KEYS, *extra])


def finish_feeds(feeds: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Feed drafts of raw feeds; defaults are filled by ``finalize_feeds``."""
    return feeds.select(
        "source_url",
        *extra,
        "feed_id",
        "title",
        "home",
        F.coalesce("self", "source_url").alias("self"),
        norm_date(F.col("updated")).alias("updated"),
        nonempty_list(F.col("authors")).alias("authors"),
    )
