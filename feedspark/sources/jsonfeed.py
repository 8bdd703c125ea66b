"""Where JSON Feed documents keep their fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedspark.model import nonempty
from feedspark.sources.shape import person, raw_feed, raw_item, some

_AUTHOR = "struct<name:string,url:string>"
_ITEM = (
    "struct<id:string,url:string,external_url:string,title:string,summary:string,"
    "content_text:string,content_html:string,date_published:string,date_modified:string,"
    f"authors:array<{_AUTHOR}>,author:{_AUTHOR},tags:array<string>>"
)
SCHEMA = (
    "struct<title:string,home_page_url:string,feed_url:string,"
    f"authors:array<{_AUTHOR}>,author:{_AUTHOR},items:array<{_ITEM}>>"
)


def _persons(authors: Column, author: Column) -> Column:
    """Named authors; the single author counts only when there is no list."""
    listed = F.coalesce(authors, F.when(author.isNotNull(), F.array(author)))
    named = F.filter(listed, lambda a: F.coalesce(a["name"], F.lit("")) != "")
    return some(F.transform(named, lambda a: person(a["name"], nonempty(a["url"]))))


def _item(i: Column) -> Column:
    return raw_item(
        id=i["id"],
        title=F.coalesce(i["title"], F.lit("Untitled")),
        href=F.coalesce(i["url"], i["external_url"]),
        published=i["date_published"],
        updated=i["date_modified"],
        summary=i["summary"],
        markup=i["content_html"],
        plain=i["content_text"],
        authors=_persons(i["authors"], i["author"]),
        tags=i["tags"],
    )


def jsonfeed(d: Column) -> tuple[Column, Column]:
    """Feed and items; the feed's own time always comes from its entries."""
    feed = raw_feed(
        feed_id=d["feed_url"],
        title=d["title"],
        home=d["home_page_url"],
        self=d["feed_url"],
        authors=_persons(d["authors"], d["author"]),
    )
    return feed, F.transform(d["items"], _item)
