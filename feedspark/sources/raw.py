"""Raw documents: scans, kinds, carry-forward of unchanged snapshots, page titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.binding import let
from feedspark.functions.text import decode_text
from feedspark.model import RAW_DOCUMENT, present
from feedspark.operators.ranking import running_sums
from feedspark.session import materialize

SNIFFED = 2000
"""Characters of a body that are looked at where the content type does not tell its kind."""
# Document kinds.
KINDS = ("atom", "rss", "rdf", "jsonfeed", "html")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of fetched documents."""
    return spark.read.schema(RAW_DOCUMENT).parquet(path)


def scan_files(spark: SparkSession, path: str, content_type: str = "") -> DataFrame:
    """A folder of documents, one per file; the file path is the URL."""
    files = spark.read.text(path, wholetext=True)
    url = F.col("_metadata.file_path")
    return files.select(
        url.alias("requested_url"),
        url.alias("final_url"),
        F.lit(content_type).alias("content_type"),
        F.col("value").alias("body"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("error"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
    )


def detect_kind(content_type: Column, body: Column, sniffed: int = SNIFFED) -> Column:
    """Kind by content type, else by the first ``sniffed`` characters."""
    declared = F.lower(F.coalesce(content_type, F.lit("")))

    def sniff(head: Column) -> Column:
        has = lambda text: F.contains(head, F.lit(text))
        json = F.contains(declared, F.lit("json")) | body.rlike(r"^\s*\{")
        return (
            F.when(F.contains(declared, F.lit("atom")), "atom")
            .when(F.contains(declared, F.lit("rss")), "rss")
            .when(F.contains(declared, F.lit("feed+json")), "jsonfeed")
            .when(json & (has("jsonfeed.org") | has('"items"')), "jsonfeed")
            .when(has("<feed"), "atom")
            .when(has("<rss"), "rss")
            .when(has("rdf:rdf"), "rdf")
            .when(has("jsonfeed.org"), "jsonfeed")
            .otherwise("html")
        )

    return let(F.lower(F.substring(body, 1, sniffed)), sniff)


CARRIED = ["final_url", "content_type", "body", "etag", "last_modified"]


def carry_forward(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Fill documents that were not modified from the latest snapshot before their own time.

    Status 304 takes body, content type and final URL of the document of the same requested
    URL that was stored last, not after it; both tables may hold many snapshots of a URL.
    Other rows stay as fetched, also those without a URL. Of several documents of one time
    the one with the greatest entity tag, then body, counts.

    Questions and stored documents are sorted together by URL and time, with one narrow row
    for each, and numbered by the documents so far; a question has the number of its answer.
    So no pairs of snapshots are formed, and a URL with too many rows for one task spans many.
    """
    rows = materialize(current.withColumn("_row", F.monotonically_increasing_id()))
    asks = (F.col("http_status") == 304) & F.col("requested_url").isNotNull()
    wanted = rows.filter(asks).select("requested_url", "snapshot_ts", "_row")
    stored = previous.filter("body IS NOT NULL AND snapshot_ts IS NOT NULL").join(
        wanted.select("requested_url").distinct(), "requested_url", "left_semi"
    )
    last = F.max_by(F.struct(*CARRIED), F.struct("etag", "body")).alias("_previous")
    documents = materialize(stored.groupBy("requested_url", "snapshot_ts").agg(last))
    line = documents.select("requested_url", "snapshot_ts", F.lit(1).cast("long").alias("_stored"), F.lit(-1).cast("long").alias("_row"))
    line = line.unionByName(wanted.select("requested_url", "snapshot_ts", F.lit(0).cast("long").alias("_stored"), "_row"))
    order = [F.col("snapshot_ts"), F.col("_stored").desc(), F.col("_row")]
    numbered = materialize(running_sums(line, ["requested_url"], order, {"_before": F.col("_stored")}))
    answers = numbered.filter("_stored = 0").select("requested_url", F.col("_before").alias("_number"), "_row")
    numbers = numbered.filter("_stored = 1").select("requested_url", "snapshot_ts", (F.col("_before") + 1).alias("_number"))
    found = documents.join(numbers, ["requested_url", "snapshot_ts"]).select("requested_url", "_number", "_previous")
    joined = rows.join(answers.join(found, ["requested_url", "_number"]).select("_row", "_previous"), "_row", "left")
    carried = F.col("_previous").isNotNull()
    filled = [F.when(carried, F.col(f"_previous.{c}")).otherwise(F.col(c)).alias(c) for c in CARRIED]
    rest = [F.col(c) for c in current.columns if c not in CARRIED]
    return joined.select(*rest, *filled, carried.alias("carried"))


def _first_tag_text(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)


def plain_text(markup: Column) -> Column:
    """Text of inline markup: tags dropped, entities decoded, ends trimmed."""
    return present(decode_text(F.regexp_replace(markup, r"<[^>]*>", "")))


def page_title(html: Column, url: Column) -> Column:
    """Site name of the page, else its title, else its URL."""
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']?og:site_name\b[^>]*>", 0)
    quoted = r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    site = F.concat(F.regexp_extract(meta, quoted, 1), F.regexp_extract(meta, quoted, 2))
    return F.coalesce(
        plain_text(site), plain_text(_first_tag_text(html, "title")), url
    )


def listing_title(html: Column) -> Column:
    """Title of a listing page: its title, else its first top heading."""
    return F.coalesce(
        plain_text(_first_tag_text(html, "title")), plain_text(_first_tag_text(html, "h1"))
    )

