"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.functions import dates, ids, text, urls
from feedspark.plans import views as v
from feedspark.plans.registry import Registry

R = Registry()
E1 = "WITH " + v.ENTRIES


@R.query(
    "norm_date",
    E1
    + """, t AS (SELECT entry_ord, coalesce(published, updated, TIMESTAMP '2001-02-03 04:05:06') AS t FROM entries)
    SELECT entry_ord, CASE entry_ord % 9
      WHEN 0 THEN epoch_ms(date_trunc('second', t))
      WHEN 1 THEN epoch_ms(date_trunc('second', t)) - 7200000
      WHEN 2 THEN epoch_ms(t)
      WHEN 3 THEN epoch_ms(t) + 12600000
      WHEN 4 THEN epoch_ms(date_trunc('day', t))
      WHEN 5 THEN epoch_ms(date_trunc('day', t))
      WHEN 6 THEN epoch_ms(date_trunc('month', t))
      WHEN 7 THEN epoch_ms(date_trunc('second', t)) + 18000000
      ELSE -1 END AS date_ms FROM t""",
)
def _(spark, d):
    from datetime import datetime, timezone

    fixed = F.lit(datetime(2001, 2, 3, 4, 5, 6, tzinfo=timezone.utc))
    t = F.coalesce(F.col("published"), F.col("updated"), fixed)
    kind = F.col("entry_ord") % 9
    written = (
        F.when(kind == 0, dates.rfc822(t))
        .when(kind == 1, F.concat(F.date_format(t, "d MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(kind == 2, dates.rfc3339(t))
        .when(kind == 3, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-03:30")))
        .when(kind == 4, F.date_format(t, "MMMM d, yyyy"))
        .when(kind == 5, F.date_format(t, "yyyy-MM-dd"))
        .when(kind == 6, F.date_format(t, "MMM yyyy"))
        .when(kind == 7, F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .otherwise(F.col("title"))
    )
    return v.entries(spark, d).select("entry_ord", v.ms(dates.norm_date(written)).alias("date_ms"))


HREFS = """hrefs AS (SELECT page_id, url,
      regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
      regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) AS folder,
      regexp_replace(url, '#.*$', '') AS bare,
      generate_subscripts(h, 1) AS n, unnest(h) AS href
    FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
"""


def enc_sql(x):
    return f"replace(replace(url_encode({x}), '%2C', ','), '%2F', '/')"


@R.query(
    "resolve_url",
    "WITH "
    + HREFS
    + f"""SELECT page_id, n, CASE n % 5
      WHEN 0 THEN origin || '/' || {enc_sql("href[2:]")}
      WHEN 1 THEN folder || {enc_sql("href[2:]")}
      WHEN 2 THEN regexp_replace(folder, '[^/]+/$', '') || 'up/' || {enc_sql("href[2:]")}
      WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example' || {enc_sql("href")}
      ELSE bare || '#' || {enc_sql("href[2:]")} END AS link FROM hrefs""",
)
def _(spark, d):
    pages = v.table(spark, d, "pages")
    rows = pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("n", "href")
    ).withColumn("n", F.col("n").cast("long") + 1)
    word = F.substring(F.col("href"), F.lit(2), F.length("href"))
    given = (
        F.when(F.col("n") % 5 == 0, F.col("href"))
        .when(F.col("n") % 5 == 1, word)
        .when(F.col("n") % 5 == 2, F.concat(F.lit("./x/../../up/"), word))
        .when(F.col("n") % 5 == 3, F.concat(F.lit("//CDN.example"), F.col("href")))
        .otherwise(F.concat(F.lit("#"), word))
    )
    return rows.select("page_id", "n", urls.resolve_url(given, F.col("url")).alias("link"))


@R.query(
    "strip_html",
    """SELECT page_id, length(t) AS n, md5(t) AS plain_md5 FROM (SELECT page_id,
      trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)""",
)
def _(spark, d):
    plain = text.strip_html(F.col("html"))
    df = v.table(spark, d, "pages").select("page_id", plain.alias("t"))
    return df.select(
        "page_id",
        F.length("t").cast("long").alias("n"),
        F.md5("t").alias("plain_md5"),
    )


@R.query(
    "entity_decode",
    """SELECT page_id, md5(replace(replace(html, '&middot;', chr(183)), '&copy;', chr(169))) AS body_md5 FROM pages""",
)
def _(spark, d):
    body = text.decode_entities(F.col("html"))
    return v.table(spark, d, "pages").select("page_id", F.md5(body).alias("body_md5"))


@R.query("fnv1a64", E1 + f"SELECT entry_ord, {v.fnv_sql('title')} AS hash FROM entries")
def _(spark, d):
    return v.entries(spark, d).select("entry_ord", ids.fnv1a64(F.col("title")).alias("hash"))


@R.query(
    "stable_id",
    E1
    + f"""SELECT entry_ord, CASE WHEN trim(id) = '' THEN 'urn:nwf:' || {v.fnv_sql("link || chr(10) || title")}
      ELSE id END AS id FROM entries""",
)
def _(spark, d):
    filled = ids.with_stable_id(F.col("id"), F.col("link"), F.col("title"))
    return v.entries(spark, d).select("entry_ord", filled.alias("id"))


@R.query(
    "duration_parse",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id * 60000 WHEN 1 THEN user_id * 3600000
      WHEN 2 THEN user_id * 86400000 ELSE -1 END AS span_ms FROM events""",
)
def _(spark, d):
    n = F.col("user_id").cast("string")
    kind = F.col("event_id") % 5
    written = (
        F.when(kind == 0, F.concat(n, F.lit("m")))
        .when(kind == 1, F.concat(F.lit(" "), n, F.lit(" h ")))
        .when(kind == 2, F.concat(n, F.lit("d")))
        .when(kind == 3, F.concat(n, F.lit("w")))
        .otherwise(F.col("event_type"))
    )
    df = v.table(spark, d, "events")
    return df.select("event_id", F.coalesce(dates.duration_ms(written), F.lit(-1)).alias("span_ms"))


@R.query(
    "calendar_floor",
    """SELECT event_id, epoch_ms(date_trunc('day', ts)) AS day_ms, epoch_ms(date_trunc('week', ts)) AS week_ms,
      strftime(ts, '%Y-%m-%d') AS day FROM events""",
)
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    return v.table(spark, d, "events").select(
        "event_id",
        F.unix_millis(dates.day_start(ts)).alias("day_ms"),
        F.unix_millis(dates.week_start(ts)).alias("week_ms"),
        dates.day_label(ts).alias("day"),
    )


@R.query(
    "rfc822",
    E1
    + """SELECT entry_ord, strftime(coalesce(published, updated), '%a, %d %b %Y %H:%M:%S') || ' GMT' AS stamp FROM entries""",
)
def _(spark, d):
    t = dates.refine_time(F.col("published"), F.col("updated"))
    return v.entries(spark, d).select("entry_ord", dates.rfc822(t).alias("stamp"))


@R.query(
    "rfc3339",
    E1
    + f"""SELECT entry_ord, strftime(coalesce(updated, published, {v.NOW_SQL}), '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM entries""",
)
def _(spark, d):
    t = F.coalesce("updated", "published")
    return v.entries(spark, d).select("entry_ord", dates.rfc3339(t, F.lit(v.NOW)).alias("stamp"))


@R.query(
    "xml_escape",
    """SELECT page_id, md5(e) AS text_md5, md5(replace(e, '"', '&quot;')) AS attr_md5 FROM (SELECT page_id,
      replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pages)""",
)
def _(spark, d):
    html = F.col("html")
    return v.table(spark, d, "pages").select(
        "page_id",
        F.md5(text.escape_text(html)).alias("text_md5"),
        F.md5(text.escape_attr(html)).alias("attr_md5"),
    )


@R.query(
    "url_host",
    """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
      'no url ' || page_id AS fallback FROM pages""",
)
def _(spark, d):
    plain = F.concat(F.lit("no url "), F.col("page_id").cast("string"))
    return v.table(spark, d, "pages").select(
        "page_id",
        urls.url_host(F.col("url")).alias("host"),
        urls.host_or_url(plain).alias("fallback"),
    )


@R.query(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '...' ELSE t END AS short
      FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""",
)
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 60).alias("short"))


@R.query(
    "keywords_split",
    """SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(
      string_split(replace(text, '.', ','), ','), lambda w: trim(regexp_replace(w, '^\\s+|\\s+$', '', 'g'))), lambda w: w <> ''), '|'), '') AS words
      FROM documents""",
)
def _(spark, d):
    words = text.keywords(F.replace(F.col("text"), F.lit("."), F.lit(",")))
    df = v.table(spark, d, "documents")
    return df.select("doc_id", F.coalesce(F.array_join(words, "|"), F.lit("")).alias("words"))
