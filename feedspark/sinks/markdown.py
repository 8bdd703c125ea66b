"""Markdown digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.binding import let
from feedspark.model import nonempty, nonempty_list
from feedspark.sinks.assemble import HEAD, ITEMS, TAIL, assemble, fragment
from feedspark.sinks.xmlfeeds import peak

KEYS = ["feed_id"]
DOT = " · "


def _block(text: Column) -> Column:
    """A paragraph set off by a blank line; absent text adds nothing."""
    return F.coalesce(F.concat(F.lit("\n\n"), text), F.lit(""))


def _meta(*parts: Column) -> Column:
    return let(F.concat_ws(DOT, *parts), lambda m: _block(nonempty(m)))


def write_markdown(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    c = F.col
    day = lambda ts: F.date_format(ts, "yyyy-MM-dd")
    head = F.concat(
        F.lit("# "),
        c("title"),
        _meta(
            F.concat(F.lit("Updated "), day(c("updated"))),
            F.concat(F.lit("[Home]("), nonempty(c("home")), F.lit(")")),
            F.concat(F.lit("[Feed]("), nonempty(c("self")), F.lit(")")),
        ),
    )
    authors = F.array_join(F.transform(nonempty_list(c("authors")), lambda a: a["name"]), ", ")
    tags = F.array_join(
        F.transform(nonempty_list(c("tags")), lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " "
    )
    entry = F.concat(
        F.lit("\n\n### ["),
        c("title"),
        F.lit("]("),
        c("link"),
        F.lit(")"),
        _meta(day(F.coalesce("updated", "published")), authors, tags),
        _block(nonempty(c("summary"))),
    )
    heads = feeds.select(*fragment(KEYS, HEAD, head))
    tails = feeds.select(*fragment(KEYS, TAIL, F.lit("\n")))
    items = entries.select(*fragment(KEYS, ITEMS, entry, c("part_ord"), c("entry_ord")))
    return assemble(heads.unionByName(items).unionByName(tails), KEYS, peak=peak(entries))
