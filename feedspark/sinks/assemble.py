"""Documents put together from ordered text fragments.

Every writer emits one fragment per entry (plus heads and tails) with an explicit order. A
document is a run of numbered parts: a fragment belongs to the part in whose range of
``PART_BYTES`` bytes it starts. So a part holds at most that many bytes and one fragment
more, and a document of any size has one shape. The parts in order are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.operators.ranking import running_sums

PART_BYTES = 64 << 10
HEAD, ITEMS, TAIL = 0, 10, 20
ORDER = ["section", "a", "b"]


def fragment(keys: list[str], section: int, text: Column, a=None, b=None) -> list:
    """Columns of one fragment row."""
    zero = F.lit(0)
    return [
        *[F.col(k) for k in keys],
        F.lit(section).alias("section"),
        (zero if a is None else a).cast("long").alias("a"),
        (zero if b is None else b).cast("long").alias("b"),
        text.alias("text"),
    ]


def assemble(
    fragments: DataFrame,
    keys: list[str],
    separator: str = "",
    peak: int | None = None,
    part_bytes: int | None = None,
) -> DataFrame:
    """``keys``, ``part_no`` and ``body``; ``separator`` goes between items only.

    ``peak`` is a known bound on the fragments of a document.
    """
    text, start = F.col("text"), F.col("_start")
    sums = {"_start": F.octet_length("text")}
    if separator:
        item = F.col("section") == ITEMS
        sums["_items"] = item.cast("long")
        text = F.when(item & (F.col("_items") > 0), F.concat(F.lit(separator), "text")).otherwise(text)
        start = start + F.greatest(F.col("_items") - 1, F.lit(0)) * len(separator.encode())
    placed = running_sums(fragments, keys, [F.col(c) for c in ORDER], sums, peak)
    part = F.floor(start / (part_bytes or PART_BYTES)).cast("long").alias("part_no")
    parts = placed.select(*keys, part, F.struct(*ORDER, text.alias("text")).alias("_f"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_f")), lambda f: f["text"]), "")
    return parts.groupBy(*keys, "part_no").agg(body.alias("body"))


def whole(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Put the parts of documents together again: ``keys`` and ``body``.

    A reader that needs a document in one row is bound to what a row can hold; readers by
    lines take the parts as they are.
    """
    keys = keys or ["feed_id"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "body"))), lambda p: p["body"]), "")
    return parts.groupBy(*keys).agg(body.alias("body"))


def pieces(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, part_no, piece, first, line``: lines in the order of (part_no, piece), of documents of any size.

    A line belongs to the part in which it starts; ``first`` marks the first line of a document.
    Lines inside a part are not shuffled. Only the first and the last piece of a part can belong to a
    line that others share; those alone meet the counts of breaks and are grouped.
    """
    cut = F.split("body", "\n")
    each = parts.select(*keys, "part_no", (F.size(cut) - 1).alias("_last"), F.posexplode(cut).alias("piece", "line"))
    ends = (F.col("piece") == 0) | (F.col("piece") == F.col("_last"))
    own = each.filter(~ends).select(*keys, "part_no", "piece", F.lit(False).alias("first"), "line")
    counted = parts.select(*keys, "part_no", (F.size(cut) - 1).cast("long").alias("_breaks"))
    before = running_sums(counted, keys, [F.col("part_no")], {"_before": F.col("_breaks")})
    at = F.struct("part_no", "piece")
    shared = (
        each.filter(ends)
        .join(before.select(*keys, "part_no", "_before"), [*keys, "part_no"])
        .groupBy(*keys, (F.col("_before") + F.col("piece")).alias("_line_no"))
        .agg(F.min(at).alias("_at"), F.array_sort(F.collect_list(F.struct("part_no", "line"))).alias("_ends"))
    )
    line = F.array_join(F.transform("_ends", lambda p: p["line"]), "").alias("line")
    return own.unionByName(shared.select(*keys, "_at.*", (F.col("_line_no") == 0).alias("first"), line))
