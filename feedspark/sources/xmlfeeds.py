"""Where RSS 2.0, Atom and RDF documents keep their fields.

Elements that may repeat are declared as lists, because a repeated single-valued
element must read as absent, and because a lone element must still read as a list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.functions.text import decode_entities
from feedspark.model import present, trimmed
from feedspark.sources.shape import one_person, one_text, person, raw_feed, raw_item, some

TEXTS = T.ArrayType(T.StringType())


def _record(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _texts(*names: str) -> list[tuple[str, T.DataType]]:
    return [(n, TEXTS) for n in names]


CATEGORY = T.ArrayType(_record(("_term", T.StringType()), ("_VALUE", T.StringType())))
ITEM = _record(
    *_texts("title", "link", "guid", "pubDate", "dc:date", "description"),
    *_texts("content:encoded", "dc:creator", "author"),
    ("category", CATEGORY),
)
CHANNEL = _texts(
    "title", "link", "lastBuildDate", "pubDate", "dc:date", "dc:creator", "managingEditor"
)
LINK = T.ArrayType(
    _record(("_rel", T.StringType()), ("_href", T.StringType()), ("_VALUE", T.StringType()))
)
AUTHOR = T.ArrayType(_record(*_texts("name", "uri", "email"), ("_VALUE", T.StringType())))
ENTRY = _record(
    *_texts("id", "title", "published", "updated", "summary"),
    ("link", LINK),
    ("author", AUTHOR),
    ("category", CATEGORY),
)
RSS = _record(("channel", _record(*CHANNEL, ("item", T.ArrayType(ITEM)))))
RDF = _record(("channel", _record(*CHANNEL)), ("item", T.ArrayType(ITEM)))
ATOM = _record(
    *_texts("id", "title", "updated"),
    ("link", LINK),
    ("author", AUTHOR),
    ("entry", T.ArrayType(ENTRY)),
)
CORRUPT = "_corrupt_record"


def xml_body(body: Column) -> Column:
    """A body the XML parser accepts: no leading blanks, named entities decoded."""
    return decode_entities(trimmed(body))


def parse(body: Column, schema: T.StructType) -> Column:
    """The document; one that is not well-formed has its ``_corrupt_record`` set."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_xml(body, full, options)


def categories(nodes: Column) -> Column:
    return some(
        F.transform(nodes, lambda c: F.coalesce(present(c["_term"]), present(c["_VALUE"])))
    )


def _rss_item(i: Column) -> Column:
    guid = one_text(i["guid"])
    return raw_item(
        id=guid,
        title=F.coalesce(one_text(i["title"]), F.lit("Untitled")),
        href=F.coalesce(one_text(i["link"]), guid),
        published=F.coalesce(one_text(i["pubDate"]), one_text(i["dc:date"])),
        markup=F.coalesce(one_text(i["description"]), one_text(i["content:encoded"])),
        authors=one_person(F.coalesce(one_text(i["dc:creator"]), one_text(i["author"]))),
        tags=categories(i["category"]),
    )


def _channel(c: Column, updated: Column, author: Column | None) -> Column:
    given = {} if author is None else {"authors": one_person(author)}
    link = one_text(c["link"])
    return raw_feed(feed_id=link, title=one_text(c["title"]), home=link, updated=updated, **given)


def rss(d: Column) -> tuple[Column, Column]:
    """Feed and items of an RSS 2.0 document."""
    c = d["channel"]
    updated = F.coalesce(one_text(c["lastBuildDate"]), one_text(c["pubDate"]))
    author = F.coalesce(one_text(c["dc:creator"]), one_text(c["managingEditor"]))
    return _channel(c, updated, author), F.transform(c["item"], _rss_item)


def rdf(d: Column) -> tuple[Column, Column]:
    """Feed and items of an RSS 1.0 document, whose items stand beside the channel."""
    c = d["channel"]
    return _channel(c, one_text(c["dc:date"]), None), F.transform(d["item"], _rss_item)


def _href(links: Column, rel: str) -> Column:
    """Address of the first link with a relation; a missing relation means alternate."""
    wanted = F.filter(links, lambda k: F.coalesce(present(k["_rel"]), F.lit("alternate")) == rel)
    return present(F.get(wanted, F.lit(0))["_href"])


def _persons(nodes: Column) -> Column:
    return some(
        F.transform(
            nodes,
            lambda a: person(
                F.coalesce(one_text(a["name"]), present(a["_VALUE"]), F.lit("Unknown")),
                one_text(a["uri"]),
                one_text(a["email"]),
            ),
        )
    )


def _atom_entry(e: Column) -> Column:
    first = present(F.get(e["link"], F.lit(0))["_href"])
    return raw_item(
        id=one_text(e["id"]),
        title=F.coalesce(one_text(e["title"]), F.lit("Untitled")),
        href=F.coalesce(_href(e["link"], "alternate"), first, one_text(e["id"])),
        published=one_text(e["published"]),
        updated=one_text(e["updated"]),
        markup=one_text(e["summary"]),
        authors=_persons(e["author"]),
        tags=categories(e["category"]),
    )


def atom(d: Column) -> tuple[Column, Column]:
    """Feed and items of an Atom document."""
    feed = raw_feed(
        feed_id=one_text(d["id"]),
        title=one_text(d["title"]),
        home=_href(d["link"], "alternate"),
        self=_href(d["link"], "self"),
        updated=one_text(d["updated"]),
        authors=_persons(d["author"]),
    )
    return feed, F.transform(d["entry"], _atom_entry)
