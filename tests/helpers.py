"""Small entry tables for the operator tests."""

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.model import ENTRY, FEED_COLUMNS, GENERATOR, PERSON

ROWS = T.StructType(
    [
        T.StructField("feed_id", T.StringType()),
        T.StructField("part_ord", T.IntegerType()),
        T.StructField("entry_ord", T.LongType()),
        *ENTRY.fields,
    ]
)
FEEDS = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in FEED_COLUMNS[:4]],
        T.StructField("updated", T.TimestampType()),
        T.StructField("authors", T.ArrayType(PERSON)),
        T.StructField("generator", GENERATOR),
    ]
)


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def entries(spark, *rows):
    """Rows of keyword fields; order of mention is the order in the feed."""
    full = []
    for i, row in enumerate(rows):
        base = {"feed_id": "f", "part_ord": 0, "entry_ord": i, "id": f"id{i}", "title": f"t{i}", "link": f"https://h.example/{i}"}
        base.update(row)
        full.append(tuple(base.get(n) for n in ROWS.fieldNames()))
    return spark.createDataFrame(full, ROWS)


def feed(spark, **given):
    base = {"feed_id": "f", "title": "Feed", "updated": at("2024-01-02T03:04:05")}
    base.update(given)
    return spark.createDataFrame([tuple(base.get(n) for n in FEEDS.fieldNames())], FEEDS)


def docs(spark, *bodies, url="https://h.example/feed"):
    rows = [(f"{url}{i}" if i else url, b, "") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "final_url string, body string, content_type string")


def column(df, name, order="entry_ord"):
    return [r[0] for r in (df.orderBy(order) if order else df).select(name).collect()]


def evaluate(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lit(x):
    return F.lit(x)
