"""OPML subscription lists of meshes and constructs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import escape_attr, escape_text
from feedspark.sinks.assemble import HEAD, ITEMS, TAIL, assemble, fragment

_END = "  </body>\n</opml>\n"
_LAST = 2**62


def _head(title: Column) -> Column:
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<opml version="2.0">\n  <head>\n    <title>'),
        escape_text(title),
        F.lit("</title>\n  </head>\n  <body>\n"),
    )


def _source(indent: str) -> Column:
    name, url = escape_attr(F.col("source_name")), escape_attr(F.col("source_url"))
    return F.concat(
        F.lit(f'{indent}<outline type="rss" text="'),
        name,
        F.lit('" title="'),
        name,
        F.lit('" xmlUrl="'),
        url,
        F.lit('" htmlUrl="'),
        url,
        F.lit('"/>\n'),
    )


def mesh_opml(meshes: DataFrame, sources: DataFrame) -> DataFrame:
    """One document per mesh: ``meshes`` lists mesh_name, ``sources`` the outlines in order."""
    keys = ["mesh_name"]
    heads = meshes.select(*fragment(keys, HEAD, _head(F.col("mesh_name"))))
    tails = meshes.select(*fragment(keys, TAIL, F.lit(_END)))
    items = sources.select(*fragment(keys, ITEMS, _source("    "), F.col("source_ord")))
    return assemble(heads.unionByName(items).unionByName(tails), keys)


def construct_opml(constructs: DataFrame, members: DataFrame, sources: DataFrame) -> DataFrame:
    """One document per construct with a category per member.

    ``members`` holds construct, mesh_ord and mesh_name (the name of a reference);
    ``sources`` holds their source rows. A member without sources is an empty category.
    """
    keys = ["construct"]
    filled = sources.groupBy("construct", "mesh_ord").agg(F.count("*").alias("_n"))
    counted = members.join(filled, ["construct", "mesh_ord"], "left")
    name = escape_attr(F.col("mesh_name"))
    opening = F.concat(
        F.lit('    <outline text="'),
        name,
        F.lit('" title="'),
        name,
        F.when(F.col("_n").isNull(), '"/>\n').otherwise('">\n'),
    )
    order = F.col("mesh_ord")
    heads = constructs.select(*fragment(keys, HEAD, _head(F.col("construct"))))
    tails = constructs.select(*fragment(keys, TAIL, F.lit(_END)))
    opened = counted.select(*fragment(keys, ITEMS, opening, order, F.lit(-1)))
    closed = counted.filter("_n IS NOT NULL").select(
        *fragment(keys, ITEMS, F.lit("    </outline>\n"), order, F.lit(_LAST))
    )
    items = sources.select(*fragment(keys, ITEMS, _source("      "), order, F.col("source_ord")))
    parts = heads.unionByName(opened).unionByName(items).unionByName(closed).unionByName(tails)
    return assemble(parts, keys)
