"""JSON Feed 1.1 documents, indented by two blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import rfc3339
from feedspark.functions.text import json_string
from feedspark.model import nonempty, nonempty_list
from feedspark.sinks.assemble import HEAD, ITEMS, TAIL, assemble, fragment
from feedspark.sinks.xmlfeeds import peak

KEYS = ["feed_id"]
SEPARATOR = ",\n"


def _pair(indent: str, name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{indent}"{name}": '), json_string(value))


def _members(indent: str, fields: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*fields), lambda f: f.isNotNull()), SEPARATOR)


def _list(indent: str, name: str, values: Column, render) -> Column:
    rows = F.array_join(F.transform(nonempty_list(values), render), SEPARATOR)
    return F.concat(F.lit(f'{indent}"{name}": [\n'), rows, F.lit(f"\n{indent}]"))


def _author(indent: str):
    def render(a: Column) -> Column:
        inner = indent + "  "
        url = F.when(nonempty(a["url"]).isNotNull(), _pair(inner, "url", a["url"]))
        fields = _members(inner, [_pair(inner, "name", a["name"]), url])
        return F.concat(F.lit(f"{indent}{{\n"), fields, F.lit(f"\n{indent}}}"))

    return render


def item(indent: str = "    ") -> Column:
    """One entry; emails, sources and blank fields are left out."""
    c, inner = F.col, indent + "  "
    given = lambda name, value: F.when(value.isNotNull(), _pair(inner, name, value))
    fields = [
        _pair(inner, "id", c("id")),
        _pair(inner, "url", c("link")),
        _pair(inner, "title", c("title")),
        given("summary", nonempty(c("summary"))),
        given("date_published", rfc3339(c("published"))),
        given("date_modified", rfc3339(c("updated"))),
        _list(inner, "authors", c("authors"), _author(inner + "  ")),
        _list(inner, "tags", c("tags"), lambda t: F.concat(F.lit(inner + "  "), json_string(t))),
    ]
    return F.concat(F.lit(f"{indent}{{\n"), _members(inner, fields), F.lit(f"\n{indent}}}"))


def write_jsonfeed(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    c = F.col
    given = lambda name, value: F.when(value.isNotNull(), _pair("  ", name, value))
    fields = [
        F.lit('  "version": "https://jsonfeed.org/version/1.1"'),
        _pair("  ", "title", c("title")),
        given("home_page_url", nonempty(c("home"))),
        given("feed_url", nonempty(c("self"))),
        _list("  ", "authors", c("authors"), _author("    ")),
    ]
    counted = feeds.join(
        entries.groupBy(*KEYS).agg(F.count("*").alias("_n")), KEYS, "left"
    )
    filled = c("_n").isNotNull()
    head = F.concat(
        F.lit("{\n"),
        _members("  ", fields),
        F.lit(',\n  "items": ['),
        F.when(filled, "\n").otherwise(""),
    )
    tail = F.when(filled, "\n  ]\n}\n").otherwise("]\n}\n")
    heads = counted.select(*fragment(KEYS, HEAD, head))
    tails = counted.select(*fragment(KEYS, TAIL, tail))
    items = entries.select(*fragment(KEYS, ITEMS, item(), c("part_ord"), c("entry_ord")))
    rows = heads.unionByName(items).unionByName(tails)
    return assemble(rows, KEYS, separator=SEPARATOR, peak=peak(entries))
