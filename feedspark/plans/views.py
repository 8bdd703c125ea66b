"""Feed-shaped views over the shared tables, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.dates import millis
from feedspark.model import PERSON
from feedspark.session import utc
from feedspark.sinks.assemble import PART_BYTES

NOW = datetime(2024, 2, 1, 12, 0, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-02-01 12:00:00'"
PAGE_IDS = 500
"""A fetched document is one row, so it covers one source and this many consecutive ids.

Written documents cover whole sources: they come in numbered parts.
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined to events as feed entries; one feed per source."""
    # The link is made before the join, so that what needs links alone does not shuffle texts.
    docs = table(spark, sf_dir, "documents").withColumn(
        "_link", F.concat(F.lit("https://copy.example/"), F.md5("text"))
    )
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    doc = F.col("doc_id")
    ts = millis(F.col("ts").cast("timestamp"))
    person = lambda name: F.struct(
        name.alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("email")
    )
    users = F.array(person(F.concat(F.lit("user "), F.col("user_id").cast("string"))))
    editors = F.array(person(F.concat(F.lit("editor "), F.col("lang"))))
    first_line = F.trim(F.substring_index("text", "\n", 1))
    return docs.join(events, docs.doc_id == events.event_id).select(
        F.col("source").alias("feed_id"),
        F.substring("source", 4, 20).cast("int").alias("part_ord"),
        doc.alias("entry_ord"),
        F.when(doc % 4 == 0, "").otherwise(F.concat(F.lit("urn:doc:"), doc.cast("string"))).alias("id"),
        F.coalesce(F.nullif(first_line, F.lit("")), F.lit("Untitled")).alias("title"),
        F.col("_link").alias("link"),
        F.when(doc % 11 != 0, ts).alias("published"),
        F.when(
            doc % 3 == 0, F.timestamp_add("SECOND", F.floor("value").cast("int"), ts)
        ).alias("updated"),
        F.when(F.col("n_chars") >= 60, F.col("text")).alias("summary"),
        F.when(doc % 5 == 0, F.concat(users, editors)).otherwise(users).cast(
            f"array<{PERSON.simpleString()}>"
        ).alias("authors"),
        F.when(doc % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("lang", "event_type"))
        .alias("tags"),
        F.struct(
            F.col("source").alias("name"),
            F.concat(F.lit("https://"), "source", F.lit(".example/")).alias("url"),
        ).alias("source"),
    )


ENTRIES = f"""
entries AS (
  SELECT source AS feed_id, CAST(substr(source, 4) AS BIGINT) AS part_ord, doc_id AS entry_ord,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'urn:doc:' || doc_id END AS id,
    coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'Untitled') AS title,
    'https://copy.example/' || md5(text) AS link,
    CASE WHEN doc_id % 11 <> 0 THEN date_trunc('millisecond', ts) END AS published,
    CASE WHEN doc_id % 3 = 0
      THEN date_trunc('millisecond', ts) + to_seconds(CAST(floor(value) AS BIGINT)) END AS updated,
    CASE WHEN n_chars >= 60 THEN text END AS summary,
    CASE WHEN doc_id % 5 = 0 THEN ['user ' || user_id, 'editor ' || lang]
      ELSE ['user ' || user_id] END AS authors,
    CASE WHEN doc_id % 7 = 0 THEN [] ELSE [lang, event_type] END AS tags,
    source AS source_name, 'https://' || source || '.example/' AS source_url
  FROM documents JOIN events ON doc_id = event_id)
"""


def paged(df: DataFrame) -> DataFrame:
    """Split each source's feed into feeds of bounded size."""
    page = F.floor(F.col("entry_ord") / PAGE_IDS).cast("string")
    return df.withColumn("feed_id", F.concat("feed_id", F.lit("/"), page))


PAGED = f"""
paged AS (SELECT * REPLACE (feed_id || '/' || (entry_ord // {PAGE_IDS}) AS feed_id) FROM entries)
"""


def headers(pages: DataFrame) -> DataFrame:
    """One header per feed."""
    return (
        pages.groupBy("feed_id")
        .agg(F.max(F.coalesce("updated", "published")).alias("updated"))
        .select(
            "feed_id",
            F.concat(F.lit("Feed "), "feed_id").alias("title"),
            F.concat(F.lit("https://feeds.example/"), "feed_id").alias("home"),
            F.concat(F.lit("https://feeds.example/"), "feed_id", F.lit("/self")).alias("self"),
            F.coalesce("updated", F.lit(NOW)).alias("updated"),
            F.array(
                F.struct(
                    F.lit("Desk & Co").alias("name"),
                    F.lit("https://desk.example/").alias("url"),
                    F.lit("desk@example.org").alias("email"),
                )
            ).alias("authors"),
            F.struct(F.lit("feedspark").alias("name"), F.lit("0.1.0").alias("version")).alias("generator"),
        )
    )


def headers_sql(entries: str) -> str:
    return f"""
feeds AS (
  SELECT feed_id, 'Feed ' || feed_id AS title, 'https://feeds.example/' || feed_id AS home,
    'https://feeds.example/' || feed_id || '/self' AS self,
    coalesce(max(coalesce(updated, published)), {NOW_SQL}) AS updated
  FROM {entries} GROUP BY feed_id)
"""


def parts_sql(keys: str = "feed_id") -> str:
    """Documents in numbered parts from ``frag``: the keys, section, a, b and text."""
    return f"""SELECT {keys}, part_no, string_agg(text, '' ORDER BY section, a, b) AS body FROM (
      SELECT *, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY {keys} ORDER BY section, a, b
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {PART_BYTES} AS part_no FROM frag)
      GROUP BY {keys}, part_no"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under customers (sources), nations (meshes) and regions (constructs)."""
    region, nation, customer, orders = (
        table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")
    )
    meshes = nation.join(region, nation.n_regionkey == region.r_regionkey)
    sources = customer.join(meshes, customer.c_nationkey == meshes.n_nationkey)
    key = F.col("o_orderkey")
    return orders.join(sources, orders.o_custkey == sources.c_custkey).select(
        F.col("r_name").alias("construct"),
        F.col("n_nationkey").alias("mesh_ord"),
        F.col("n_name").alias("mesh_name"),
        F.col("c_custkey").alias("part_ord"),
        F.col("c_name").alias("source_name"),
        key.alias("entry_ord"),
        F.concat(F.lit("urn:order:"), key.cast("string")).alias("id"),
        F.concat(F.lit("https://shop.example/p/"), F.floor(key / 3).cast("string")).alias("link"),
        F.concat("o_orderpriority", F.lit(" "), key.cast("string")).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published"),
        F.lit(None).cast("timestamp").alias("updated"),
        F.array("o_orderstatus").alias("tags"),
    )


HIERARCHY = """
hier AS (
  SELECT r_name AS construct, n_nationkey AS mesh_ord, n_name AS mesh_name,
    c_custkey AS part_ord, c_name AS source_name, o_orderkey AS entry_ord,
    'urn:order:' || o_orderkey AS id, 'https://shop.example/p/' || (o_orderkey // 3) AS link,
    o_orderpriority || ' ' || o_orderkey AS title, o_orderdate AS published, o_orderstatus AS tag
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)
"""


def meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mesh definitions with their sources, one row per source."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("r_name").alias("construct"),
            F.col("n_nationkey").alias("mesh_ord"),
            F.col("n_name").alias("mesh_name"),
            F.col("c_custkey").alias("source_ord"),
            F.col("c_name").alias("source_name"),
            F.concat(F.lit("https://shop.example/c/"), F.col("c_custkey").cast("string")).alias("source_url"),
        )
    )


MESHES = """
mesh AS (
  SELECT r_name AS construct, n_nationkey AS mesh_ord, n_name AS mesh_name,
    c_custkey AS source_ord, c_name AS source_name,
    'https://shop.example/c/' || c_custkey AS source_url
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.col("url").alias("requested_url"),
        F.col("url").alias("final_url"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"),
        F.md5("html").alias("etag"),
        F.lit(200).alias("http_status"),
    )


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + body


def fnv_sql(text: str) -> str:
    """64-bit FNV-1a of a SQL text expression (code points up to U+FFFF)."""
    return f"""lower(printf('%016x', CAST(list_reduce(
      list_prepend(CAST(14695981039346656037 AS UHUGEINT),
        list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS UHUGEINT))),
      lambda h, u: (xor(h, u) * CAST(1099511628211 AS UHUGEINT))
        % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT)))"""


def ms(ts) -> "F.Column":
    """A time as epoch milliseconds, -1 when absent, for results compared across engines."""
    return F.coalesce(F.unix_millis(ts), F.lit(-1))


def ms_sql(ts: str) -> str:
    return f"coalesce(epoch_ms({ts}), -1)"
