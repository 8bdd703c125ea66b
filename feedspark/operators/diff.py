"""Set difference against what was seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.functions.ids import entry_key


def with_key(entries: DataFrame) -> DataFrame:
    return entries.withColumn("key", entry_key(F.col("id"), F.col("link")))


def new_entries(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries whose key is not in ``seen``; duplicates inside the batch all stay."""
    return with_key(entries).join(seen.select("key"), "key", "left_anti")
