"""Record types shared by every source, operator and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)
SOURCE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("url", T.StringType())]
)
GENERATOR = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]
)
ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("published", T.TimestampType()),
        T.StructField("updated", T.TimestampType()),
        T.StructField("summary", T.StringType()),
        T.StructField("authors", T.ArrayType(PERSON)),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("source", SOURCE),
    ]
)
ENTRY_COLUMNS = ENTRY.fieldNames()
ORDINALS = ["part_ord", "entry_ord"]
FEED_COLUMNS = ["feed_id", "title", "home", "self", "updated", "authors", "generator"]

RAW_DOCUMENT = T.StructType(
    [
        T.StructField("requested_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("etag", T.StringType()),
        T.StructField("last_modified", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("snapshot_ts", T.TimestampType()),
    ]
)
MESH_SOURCE = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("url", T.StringType())]
)
MESH = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("sources", T.ArrayType(MESH_SOURCE)),
    ]
)
TEMPLATE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "host",
            "feedTitle",
            "item",
            "title",
            "link",
            "date",
            "summary",
            "author",
            "tags",
        )
    ]
)

# The prefix of content-derived ids is part of every exported document.
STABLE_ID_PREFIX = "urn:nwf:"


# Whitespace at the ends of a value.
WHITESPACE = " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def present(value: Column) -> Column:
    """Trimmed text, with blank text read as absent."""
    return F.nullif(trimmed(value), F.lit(""))


def nonempty(value: Column) -> Column:
    """Empty text read as absent, without trimming."""
    return F.nullif(value, F.lit(""))


def nonempty_list(values: Column) -> Column:
    """An empty list read as absent."""
    return F.when(F.size(values) > 0, values)


def no_people() -> Column:
    return F.lit(None).cast(T.ArrayType(PERSON))


def as_entries(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fill entry columns a source does not carry with typed nulls, in the standard order."""
    fields = {f.name: f.dataType for f in ENTRY.fields}
    cols = [F.col(k) for k in keys]
    for name in ENTRY_COLUMNS:
        if name in df.columns:
            cols.append(F.col(name).cast(fields[name]).alias(name))
        else:
            cols.append(F.lit(None).cast(fields[name]).alias(name))
    return df.select(*cols)
