"""Feed documents of any format, read by what their body is, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.session import materialize, spread
from feedspark.sources import xmlfeeds
from feedspark.sources.jsonfeed import SCHEMA, jsonfeed
from feedspark.sources.shape import explode_list, finish_entries, finish_feeds

_PROLOG = r"(?s)^(?:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->|<![A-Za-z][^>]*>)*"
XML = {
    "rss": (xmlfeeds.RSS, xmlfeeds.rss),
    "atom": (xmlfeeds.ATOM, xmlfeeds.atom),
    "rdf": (xmlfeeds.RDF, xmlfeeds.rdf),
}
FORMATS = ("json", *XML)


def body_format(body: Column) -> Column:
    """A JSON object, or the root element of an XML document; absent for anything else."""
    root = F.regexp_extract(body, _PROLOG + r"<([A-Za-z_][\w.:\-]*)", 1)
    return (
        F.when(body.rlike(r"^\s*\{"), "json")
        .when(root == "feed", "atom")
        .when(root == "rss", "rss")
        .when(root == "rdf:RDF", "rdf")
    )


def parse_feeds(docs: DataFrame, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """source_url, format, problem, raw feed and raw items of each document.

    Every parser sees the documents of its format and nulls otherwise, so the documents
    are scanned once. Persist the result when both feeds and entries are needed.
    """
    kind, body = F.col("format"), F.col("body")
    marked = spread(docs).select(
        F.col("final_url").alias("source_url"), "body", body_format(body).alias("format")
    )
    texts = marked.withColumn("xml", xmlfeeds.xml_body(F.when(kind.isin(*XML), body)))
    parsed = [
        xmlfeeds.parse(F.when(kind == fmt, F.col("xml")), XML[fmt][0]).alias(f"d_{fmt}")
        for fmt in formats
        if fmt in XML
    ]
    if "json" in formats:
        parsed.append(F.from_json(F.when(kind == "json", body), SCHEMA).alias("d_json"))
        valid = F.when(kind == "json", F.try_parse_json(body).isNotNull())
    else:
        valid = F.lit(None).cast("boolean")
    rows = texts.select("source_url", "format", valid.alias("json_ok"), *parsed)
    broken = F.lit(False)
    feeds, items = [], []
    for fmt in formats:
        d = F.col(f"d_{fmt}")
        feed, listed = (XML[fmt][1] if fmt in XML else jsonfeed)(d)
        feeds.append(F.when(kind == fmt, feed))
        items.append(F.when(kind == fmt, listed))
        if fmt in XML:
            broken = broken | ((kind == fmt) & d[xmlfeeds.CORRUPT].isNotNull())
    problem = (
        F.when(kind.isNull() | ~kind.isin(*formats), "unrecognized feed format")
        .when(~F.col("json_ok"), "not a JSON document")
        .when(F.coalesce(broken, F.lit(False)), "not well-formed")
    )
    return rows.select(
        "source_url",
        "format",
        problem.alias("problem"),
        F.coalesce(*feeds).alias("feed"),
        F.coalesce(*items).alias("items"),
    )


def feeds_of(parsed: DataFrame) -> DataFrame:
    good = parsed.filter(F.col("problem").isNull())
    return finish_feeds(good.select("source_url", "format", "feed.*"), ("format",))


def entries_of(parsed: DataFrame) -> DataFrame:
    good = parsed.filter(F.col("problem").isNull())
    rows = explode_list(good, ["source_url", "format"], F.col("items"), "entry_ord", "i")
    return finish_entries(rows.select("source_url", "entry_ord", "format", "i.*"), ("format",))


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("problem").isNotNull()).select(
        F.lit("feed").alias("stage"),
        F.col("source_url").alias("key"),
        F.col("problem").alias("reason"),
    )


def read_feeds(
    docs: DataFrame, formats: tuple[str, ...] = FORMATS, keep: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feeds, entries and rejects; ``keep`` parses once for callers that need more than one of them."""
    parsed = parse_feeds(docs, formats)
    parsed = materialize(parsed) if keep else parsed
    return feeds_of(parsed), entries_of(parsed), rejects_of(parsed)
