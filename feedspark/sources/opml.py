"""OPML subscription lists."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.functions.urls import host_or_url
from feedspark.model import present
from feedspark.sources.xmlfeeds import xml_body

_OUTLINES = T.StructType(
    [
        T.StructField("source_ord", T.IntegerType()),
        T.StructField("head_title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class Outlines:
    """Outline attributes of one document in reading order; a broken one yields an error row.

    A list without sources still yields one row, so that its mesh is known.
    """

    def eval(self, body: str):
        try:
            root = ElementTree.fromstring(body)
        except ElementTree.ParseError as error:
            yield 0, None, None, None, None, str(error)
            return
        if root.tag != "opml":
            yield 0, None, None, None, None, "missing <opml> root"
            return
        title = root.findtext("head/title")
        found = [n.attrib for n in root.iterfind("body//outline") if n.get("xmlUrl", "").strip()]
        if not found:
            yield -1, title, None, None, None, None
        for i, node in enumerate(found):
            yield i, title, node.get("text"), node.get("title"), node["xmlUrl"].strip(), None


def read_opml(docs: DataFrame, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mesh sources of each document (nested categories flattened), and rejects."""
    spark = SparkSession.active()
    spark.udtf.register("feed_outlines", F.udtf(Outlines, returnType=_OUTLINES))
    prepared = docs.select(F.col("final_url").alias("source_doc"), xml_body(F.col("body")).alias("body"))
    rows = spark.sql(
        "SELECT d.source_doc, o.* FROM {docs} d, LATERAL feed_outlines(d.body) o", docs=prepared
    )
    named = present(F.lit(name)) if name else F.lit(None).cast("string")
    sources = rows.filter("error IS NULL").select(
        "source_doc",
        F.coalesce(named, present(F.col("head_title")), F.lit("imported")).alias("mesh_name"),
        "source_ord",
        F.coalesce(present(F.col("text")), present(F.col("title")), host_or_url(F.col("url"))).alias("source_name"),
        F.col("url").alias("source_url"),
    )
    rejects = rows.filter("error IS NOT NULL").select(
        F.lit("opml").alias("stage"), F.col("source_doc").alias("key"), F.col("error").alias("reason")
    )
    return sources, rejects
