"""Atom and RSS documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import epoch, merge_time, refine_time, rfc822, rfc3339
from feedspark.functions.text import escape_attr, escape_text
from feedspark.model import nonempty
from feedspark.operators.ranking import peak_size
from feedspark.sinks.assemble import HEAD, ITEMS, TAIL, assemble, fragment

KEYS = ["feed_id"]


def peak(entries: DataFrame) -> int:
    """Most fragments of one document: its entries, a head and a tail."""
    return peak_size(entries, KEYS) + 2


DECLARATION = '<?xml version="1.0" encoding="utf-8"?>\n'


def element(name: str, text: Column, indent: str, attributes: str = "") -> Column:
    """One line with a text element; absent when the text is."""
    return F.concat(
        F.lit(f"{indent}<{name}{attributes}>"), escape_text(text), F.lit(f"</{name}>\n")
    )


def optional(line: Column) -> Column:
    return F.coalesce(line, F.lit(""))


def _lines(values: Column, render) -> Column:
    return optional(F.array_join(F.transform(values, render), ""))


def _person(indent: str):
    def render(p: Column) -> Column:
        return F.concat(
            F.lit(f"{indent}<author>\n"),
            element("name", p["name"], indent + "  "),
            optional(element("uri", nonempty(p["url"]), indent + "  ")),
            optional(element("email", nonempty(p["email"]), indent + "  ")),
            F.lit(f"{indent}</author>\n"),
        )

    return render


def _link(rel: str, href: Column, indent: str) -> Column:
    return F.concat(F.lit(f'{indent}<link rel="{rel}" href="'), escape_attr(href), F.lit('"/>\n'))


def write_atom(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Atom 1.0; an undated entry takes the feed's time, sources are not written."""
    c = F.col
    stamp = rfc3339(c("updated"), epoch())
    version = F.concat(F.lit(' version="'), escape_attr(nonempty(c("generator.version"))), F.lit('"'))
    head = F.concat(
        F.lit(DECLARATION + '<feed xmlns="http://www.w3.org/2005/Atom">\n'),
        element("id", c("feed_id"), "  "),
        element("title", c("title"), "  "),
        element("updated", stamp, "  "),
        optional(_link("alternate", nonempty(c("home")), "  ")),
        optional(_link("self", nonempty(c("self")), "  ")),
        _lines(c("authors"), _person("  ")),
        optional(
            F.concat(
                F.lit("  <generator"),
                optional(version),
                F.lit(">"),
                escape_text(c("generator.name")),
                F.lit("</generator>\n"),
            )
        ),
    )
    heads = feeds.select(*fragment(KEYS, HEAD, head))
    tails = feeds.select(*fragment(KEYS, TAIL, F.lit("</feed>\n")))
    dated = entries.join(feeds.select("feed_id", c("updated").alias("feed_updated")), "feed_id")
    item = F.concat(
        F.lit("  <entry>\n"),
        element("id", c("id"), "    "),
        element("title", c("title"), "    "),
        _link("alternate", c("link"), "    "),
        element(
            "updated", rfc3339(F.coalesce("updated", "published", "feed_updated"), epoch()), "    "
        ),
        optional(element("published", rfc3339(c("published")), "    ")),
        _lines(c("authors"), _person("    ")),
        _lines(
            c("tags"),
            lambda t: F.concat(F.lit('    <category term="'), escape_attr(t), F.lit('"/>\n')),
        ),
        optional(element("summary", nonempty(c("summary")), "    ", ' type="text"')),
        F.lit("  </entry>\n"),
    )
    items = dated.select(*fragment(KEYS, ITEMS, item, c("part_ord"), c("entry_ord")))
    return assemble(heads.unionByName(items).unionByName(tails), KEYS, peak=peak(entries))


def write_rss(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """RSS 2.0; namespaces are declared only when used."""
    c = F.col
    uses_authors = entries.groupBy("feed_id").agg(
        F.max(F.coalesce(F.size("authors") > 0, F.lit(False))).alias("uses_authors")
    )
    flagged = feeds.join(uses_authors, "feed_id", "left")
    self = nonempty(c("self"))
    generator = F.concat(
        c("generator.name"), optional(F.concat(F.lit(" "), nonempty(c("generator.version"))))
    )
    head = F.concat(
        F.lit(DECLARATION + '<rss version="2.0"'),
        F.when(self.isNotNull(), ' xmlns:atom="http://www.w3.org/2005/Atom"').otherwise(""),
        F.when(c("uses_authors"), ' xmlns:dc="http://purl.org/dc/elements/1.1/"').otherwise(""),
        F.lit(">\n  <channel>\n"),
        element("title", c("title"), "    "),
        element("link", F.coalesce("home", "self", "feed_id"), "    "),
        element("description", c("title"), "    "),
        optional(
            F.concat(
                F.lit('    <atom:link href="'),
                escape_attr(self),
                F.lit('" rel="self" type="application/rss+xml"/>\n'),
            )
        ),
        optional(element("lastBuildDate", rfc822(c("updated")), "    ")),
        optional(element("generator", generator, "    ")),
    )
    heads = flagged.select(*fragment(KEYS, HEAD, head))
    tails = feeds.select(*fragment(KEYS, TAIL, F.lit("  </channel>\n</rss>\n")))
    source_url = nonempty(c("source.url"))
    item = F.concat(
        F.lit("    <item>\n"),
        element("title", c("title"), "      "),
        element("link", c("link"), "      "),
        F.lit('      <guid isPermaLink="'),
        F.when(c("id") == c("link"), "true").otherwise("false"),
        F.lit('">'),
        escape_text(c("id")),
        F.lit("</guid>\n"),
        optional(element("pubDate", rfc822(refine_time(c("published"), c("updated"))), "      ")),
        _lines(c("authors"), lambda a: element("dc:creator", a["name"], "      ")),
        _lines(c("tags"), lambda t: element("category", t, "      ")),
        optional(element("description", nonempty(c("summary")), "      ")),
        optional(
            F.concat(
                F.lit('      <source url="'),
                escape_attr(source_url),
                F.lit('">'),
                escape_text(F.coalesce("source.name", "source.url")),
                F.lit("</source>\n"),
            )
        ),
        F.lit("    </item>\n"),
    )
    items = entries.select(*fragment(KEYS, ITEMS, item, c("part_ord"), c("entry_ord")))
    return assemble(heads.unionByName(items).unionByName(tails), KEYS, peak=peak(entries))
