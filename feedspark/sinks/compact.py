"""The compact line format: dictionaries, a link base, and time deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import cell_encode
from feedspark.model import ORDINALS
from feedspark.operators.dictionary import (
    AUTHOR,
    SOURCE,
    TAG,
    feed_mentions,
    intern,
    link_base,
    mentions,
    peak_mentions,
)
from feedspark.session import materialize, small_side
from feedspark.sinks.assemble import HEAD, ITEMS, TAIL, assemble, fragment

# The header line and the line kinds.
HEADER = "NWF1"
KEYS = ["feed_id"]
DICTIONARY_SECTION = {AUTHOR: 1, TAG: 2, SOURCE: 3}
BASE_SECTION = 4


def _refs(kind: str):
    chosen = F.filter(F.array_sort("_refs"), lambda r: r["kind"] == kind)
    refs = F.array_join(F.transform(chosen, lambda r: r["ref"].cast("string")), ",")
    return F.coalesce(refs, F.lit(""))


def write_compact(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines start with their line feed, so dictionary values can be fragments of their own.

    References are found by joining the mentions of an entry to the dictionary, which
    also holds for feeds whose dictionary is too large for one row. What a feed has once
    (time and base) is broadcast where feeds are few, so entries are not shuffled for it.
    """
    c = F.col
    found = mentions(entries).unionByName(feed_mentions(feeds))
    authors = F.max(F.greatest(F.size("authors"), F.lit(0)))
    peak = peak_mentions(entries) + (feeds.agg(authors).first()[0] or 0) + 3
    dictionary = intern(found, peak)
    refs = (
        found.join(dictionary, ["feed_id", "kind", "cell"])
        .groupBy("feed_id", *ORDINALS)
        .agg(F.collect_list(F.struct("kind", "idx", "ref")).alias("_refs"))
    )
    base = materialize(link_base(entries))
    epoch = F.coalesce(F.unix_seconds("updated"), F.lit(0))

    feed_refs = refs.filter(c("part_ord") == -1).select("feed_id", "_refs")
    cells = [F.lit("F"), *[cell_encode(F.coalesce(c(n), F.lit(""))) for n in ("feed_id", "title", "home", "self")]]
    head = F.concat(
        F.lit(HEADER + "\n"), F.concat_ws("\t", *cells, epoch.cast("string"), _refs(AUTHOR))
    )
    heads = feeds.join(feed_refs, "feed_id", "left").select(*fragment(KEYS, HEAD, head))
    tails = feeds.select(*fragment(KEYS, TAIL, F.lit("\n")))

    word = F.concat(
        F.when(c("ref") == 0, F.concat(F.lit("\n"), c("kind"))).otherwise(F.lit("")),
        F.lit("\t"),
        c("cell"),
    )
    words = dictionary.select(*fragment(KEYS, HEAD, word, None, c("ref")), "kind")
    section = F.element_at(
        F.create_map(*[F.lit(x) for pair in DICTIONARY_SECTION.items() for x in pair]), c("kind")
    )
    words = words.withColumn("section", section).drop("kind")
    bases = base.filter("base <> ''").select(
        *fragment(KEYS, BASE_SECTION, F.concat(F.lit("\nB\t"), cell_encode(c("base"))))
    )

    once = materialize(feeds.select("feed_id", epoch.alias("_epoch")).join(base, "feed_id"))
    joined = entries.join(small_side(once), "feed_id").join(refs, ["feed_id", *ORDINALS], "left")
    delta = c("_epoch") - F.unix_seconds(F.coalesce("updated", "published"))
    near = (c("base") != "") & c("link").startswith(c("base"))
    link = F.when(
        near, F.concat(F.lit("~"), F.substring(c("link"), F.length("base") + 1, F.length("link")))
    ).otherwise(c("link"))
    line = F.concat_ws(
        "\t",
        F.lit("\nE"),
        cell_encode(c("id")),
        F.coalesce(delta.cast("string"), F.lit("-")),
        cell_encode(link),
        _refs(AUTHOR),
        _refs(TAG),
        cell_encode(c("title")),
        cell_encode(F.coalesce("summary", F.lit(""))),
        _refs(SOURCE),
    )
    items = joined.select(*fragment(KEYS, ITEMS, line, c("part_ord"), c("entry_ord")))
    parts = heads.unionByName(words).unionByName(bases).unionByName(items).unionByName(tails)
    return assemble(parts, KEYS, peak=peak)
