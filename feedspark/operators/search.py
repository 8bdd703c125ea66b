"""Substring search of many queries over many haystacks, by hashes or a saved table of trigrams.

Queries are found by ``occurrences`` in one scan of the haystacks. With a saved posting table
the haystacks are not scanned: one that holds a query holds all its trigrams. Of each query the
``RAREST`` trigrams with the fewest postings are looked up; haystacks that are posted under all
of them are read and searched. Queries shorter than a trigram are searched in every haystack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedspark.operators import occurrences
from feedspark.operators.rule_index import GRAM, SPREAD, pieces
from feedspark.session import small_side, spread

RAREST = 4


def postings(haystacks: DataFrame) -> DataFrame:
    """``gram, row`` of lower-cased ``haystacks`` (``row``: any key, ``text``)."""
    return haystacks.select(F.explode(pieces(F.col("text"), GRAM)).alias("gram"), "row")


def save_postings(haystacks: DataFrame, path: str) -> None:
    """Write the posting table sorted by trigram, so that a lookup reads few row groups."""
    postings(haystacks).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def _posted_under(posted: DataFrame, known: DataFrame) -> DataFrame:
    """``query, row`` of haystacks posted under all chosen trigrams of a query."""
    asked = known.filter(F.length("needle") >= GRAM).select("query", F.explode(pieces(F.col("needle"), GRAM)).alias("gram"))
    grams = small_side(asked.select("gram").distinct())
    counts = posted.join(grams, "gram").groupBy("gram").agg(F.count("*").alias("n"))
    ranked = asked.join(small_side(counts), "gram", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    )
    chosen = ranked.filter(F.col("rank") <= RAREST).select("query", "gram")
    needed = chosen.groupBy("query").agg(F.count("*").alias("needed"))
    met = posted.join(small_side(chosen), "gram").groupBy("query", "row").agg(F.count("*").alias("found"))
    return met.join(small_side(needed), "query").filter("found = needed").select("query", "row")


def search(haystacks: DataFrame, queries: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """``query, row`` of every haystack that holds a query (texts of column ``query``).

    A query is trimmed and lower-cased before it is looked for; a blank one is in all.
    ``posted`` is a saved posting table of the same haystacks.
    """
    haystacks = spread(haystacks)
    known = queries.select("query").distinct().withColumn("needle", F.lower(F.trim("query")))
    if posted is None:
        found = occurrences.held(haystacks.select("row", "text"), ["row"], known.filter("needle <> ''")).select("query", "row")
        least = 1
    else:
        found, least = _posted_under(posted, known), GRAM
    share = F.pmod(F.xxhash64("row"), F.lit(SPREAD)).alias("share")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("share")
    short = known.filter(F.length("needle") < least).select("query", every)
    met = found.unionByName(haystacks.select("row", share).join(small_side(short), "share").select("query", "row"))
    tested = met.join(haystacks, "row").join(small_side(known), "query")
    return tested.filter(F.contains("text", "needle")).select("query", "row")
