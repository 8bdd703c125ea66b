"""HTML extraction over the page table and over pages made from document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.functions.text import escape_text
from feedspark.plans import meshes
from feedspark.plans import views as v
from feedspark.plans.registry import Registry
from feedspark.session import materialize
from feedspark.sources import cascade, html, propose

R = Registry()


def _template(df, host, **given):
    fields = ("feedTitle", "item", "title", "link", "date", "summary", "author", "tags")
    return df.select(
        host.alias("host"),
        *[F.lit(given.get(n)).cast("string").alias(n) for n in fields],
        F.lit(0).alias("load_ord"),
    ).distinct()


NAV = """nav AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
      generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(t) AS title
    FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h,
      regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages))
"""
ENC = "replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"


def _nav_templates(spark, d):
    from feedspark.functions.urls import url_host

    pages = v.table(spark, d, "pages")
    return _template(pages, url_host(F.col("url")), item="nav li", title="a", link="a")


@R.query(
    "template_extract",
    "WITH "
    + NAV
    + f"""SELECT url AS source_url, pos AS entry_ord, title, origin || {ENC} AS link,
      'urn:nwf:' || {v.fnv_sql(f"origin || {ENC} || chr(10) || title")} AS id FROM nav""",
)
def _(spark, d):
    scanned = html.scan_pages(v.raw_documents(spark, d), _nav_templates(spark, d))
    return html.template_entries(scanned).select("source_url", "entry_ord", "title", "link", "id")


@R.query(
    "template_feeds",
    """SELECT url AS source_url, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g')) AS title FROM pages""",
)
def _(spark, d):
    return html.template_feeds(html.scan_pages(v.raw_documents(spark, d), _nav_templates(spark, d)))


@R.query(
    "dedup_in_doc",
    "WITH "
    + NAV
    + f"""SELECT url AS source_url, min(pos) AS entry_ord, origin || lower({ENC}) AS link FROM nav GROUP BY url, origin, lower({ENC})""",
)
def _(spark, d):
    scanned = html.scan_pages(v.raw_documents(spark, d), _nav_templates(spark, d))
    lowered = html.template_entries(scanned).withColumn("link", F.lower("link"))
    return html.dedup_in_document(lowered).select("source_url", "entry_ord", "link")


# ---- pages made from documents: every line of the text is an article ----

LINES = """lines AS (SELECT doc_id, 'https://s' || (doc_id % 50) || '.example/list/' || doc_id AS url,
      generate_subscripts(l, 1) - 1 AS pos, trim(unnest(l)) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  posts AS (SELECT doc_id, url, pos, line AS title, 'https://s' || (doc_id % 50) || '.example/p/' || doc_id || '/' || (pos // 2) AS link,
      '2024-01-0' || (1 + pos % 9) AS day FROM lines WHERE line <> ''),
  firsts AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY doc_id, link ORDER BY pos) = 1)
"""


def _url(d):
    key = d.cast("string")
    return F.concat(F.lit("https://s"), (d % 50).cast("string"), F.lit(".example/list/"), key)


def _lines():
    return F.split("text", "\n")


def _address(i):
    return F.concat(F.lit("/p/"), F.col("doc_id").cast("string"), F.lit("/"), F.floor(i / 2).cast("string"))


def _day(i):
    return F.concat(F.lit("2024-01-0"), (i % 9 + 1).cast("string"))


def _articles():
    """Article markup, one per line."""
    return F.array_join(
        F.transform(
            _lines(),
            lambda line, i: F.concat(
                F.lit('<article class="post"><h2><a href="'),
                _address(i),
                F.lit('">'),
                escape_text(line),
                F.lit('</a></h2><time datetime="'),
                _day(i),
                F.lit('">then</time><p>Posted &middot; '),
                _day(i),
                F.lit("</p></article>\n"),
            ),
        ),
        "",
    )


def _ld():
    """JSON-LD of the lines: a graph of articles, a blog, or an item list."""
    post = lambda line, i: F.struct(
        F.when(i % 2 == 0, "BlogPosting").otherwise("NewsArticle").alias("@type"),
        line.alias("headline"),
        _address(i).alias("url"),
        _day(i).alias("datePublished"),
        F.array(F.struct(F.lit("Ann").alias("name")), F.struct(F.lit(" Bo ").alias("name"))).alias("author"),
        F.lit("k1, k2,,").alias("keywords"),
    )
    posts = F.filter(
        F.transform(_lines(), lambda line, i: F.struct(line.alias("line"), post(line, i).alias("post"))),
        lambda p: F.trim(p["line"]) != "",
    )
    plain = F.transform(posts, lambda p: p["post"])
    listed = F.transform(posts, lambda p: F.struct(F.lit("ListItem").alias("@type"), p["post"].alias("item")))
    kind = F.col("doc_id") % 3
    data = (
        F.when(kind == 0, F.to_json(F.struct(plain.alias("@graph"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("Blog").alias("@type"), plain.alias("blogPost"))))
        .otherwise(F.to_json(F.array(F.struct(F.array(F.lit("ItemList")).alias("@type"), listed.alias("itemListElement")))))
    )
    return F.concat(
        F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'),
        data,
        F.lit("</script>"),
    )


def _pages(spark, d, body):
    docs = v.table(spark, d, "documents")
    return docs.select(
        _url(F.col("doc_id")).alias("final_url"),
        F.concat(F.lit("<!doctype html><html><head><title>Page</title></head><body>"), body, F.lit("</body></html>")).alias("body"),
        F.lit("text/html").alias("content_type"),
    )


@R.query(
    "semantic_extract",
    "WITH "
    + LINES
    + """SELECT url AS source_url, pos AS entry_ord, title, link, epoch_ms(CAST(day AS TIMESTAMP)) AS published_ms,
      'Posted ' || chr(183) || ' ' || day AS summary FROM firsts QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2""",
)
def _(spark, d):
    rows = html.article_entries(html.scan_pages(_pages(spark, d, _articles())))
    return rows.select("source_url", "entry_ord", "title", "link", v.ms(F.col("published")).alias("published_ms"), "summary")


@R.query(
    "jsonld_extract",
    "WITH "
    + LINES
    + """SELECT url AS source_url, title, link, epoch_ms(CAST(day AS TIMESTAMP)) AS published_ms,
      'Ann|Bo' AS authors, 'k1|k2' AS tags FROM firsts""",
)
def _(spark, d):
    rows = html.jsonld_entries(html.scan_pages(_pages(spark, d, _ld())))
    return rows.select(
        "source_url",
        "title",
        "link",
        v.ms(F.col("published")).alias("published_ms"),
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"),
        F.array_join("tags", "|").alias("tags"),
    )


def _link_tag(kind, href):
    return F.concat(F.lit(f'<link rel="alternate" type="{kind}" href="'), href, F.lit('">'))


@R.query(
    "feed_links",
    """SELECT 'https://s' || (doc_id % 50) || '.example/list/' || doc_id AS source_url,
      CASE doc_id % 4 WHEN 0 THEN 'https://s' || (doc_id % 50) || '.example/a/' || doc_id
        WHEN 1 THEN 'https://s' || (doc_id % 50) || '.example/list/r' || doc_id
        WHEN 2 THEN 'https://s' || (doc_id % 50) || '.example/j1/' || doc_id END AS feed_url FROM documents""",
)
def _(spark, d):
    key = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    path = lambda p: F.concat(F.lit(p), key)
    body = (
        F.when(kind == 0, F.concat(_link_tag("application/rss+xml", path("/r/")), _link_tag("Application/Atom+xml", path("/a/"))))
        .when(kind == 1, F.concat(_link_tag("application/json", path("/j/")), _link_tag("application/rss+xml", path("r"))))
        .when(kind == 2, F.concat(_link_tag("application/feed+json", path("/j1/")), _link_tag("application/feed+json", path("/j2/"))))
        .otherwise(_link_tag("text/css", path("/c/")))
    )
    return html.feed_links(html.scan_pages(_pages(spark, d, body)))


@R.query(
    "link_follow",
    """WITH s AS (SELECT 'u' || doc_id AS url,
        CASE WHEN doc_id % 7 = 0 THEN 'u' || doc_id WHEN doc_id % 7 = 1 THEN 'gone' || doc_id WHEN doc_id % 7 = 6 THEN NULL ELSE 'u' || (doc_id + 1) END AS feed_url,
        CASE WHEN doc_id % 5 < 2 THEN NULL ELSE 'o' || (doc_id % 5) END AS outcome FROM documents),
      c AS (SELECT a.url AS origin, b.url AS u1, e.url AS u2, g.url AS u3, a.outcome AS o0, b.outcome AS o1, e.outcome AS o2, g.outcome AS o3
        FROM s a LEFT JOIN s b ON a.feed_url = b.url AND a.feed_url <> a.url
          LEFT JOIN s e ON b.feed_url = e.url AND b.feed_url <> b.url
          LEFT JOIN s g ON e.feed_url = g.url AND e.feed_url <> e.url)
    SELECT origin, coalesce(CASE WHEN o3 IS NOT NULL THEN u3 WHEN o2 IS NOT NULL THEN u2 WHEN o1 IS NOT NULL THEN u1 WHEN o0 IS NOT NULL THEN origin END, '-') AS source_url,
      coalesce(o3, o2, o1, o0, '-') AS strategy FROM c""",
)
def _(spark, d):
    key = F.col("doc_id")
    url = lambda k: F.concat(F.lit("u"), k.cast("string"))
    state = v.table(spark, d, "documents").select(
        url(key).alias("source_url"),
        F.when(key % 7 == 0, url(key))
        .when(key % 7 == 1, F.concat(F.lit("gone"), key.cast("string")))
        .when(key % 7 != 6, url(key + 1))
        .alias("feed_url"),
        F.when(key % 5 >= 2, F.concat(F.lit("o"), (key % 5).cast("string"))).alias("outcome"),
    )
    out = cascade.follow_links(state)
    return out.select("origin", F.coalesce("source_url", F.lit("-")).alias("source_url"), F.coalesce("strategy", F.lit("-")).alias("strategy"))


CHAIN = 23


@R.query(
    "link_chains",
    f"""WITH RECURSIVE s AS (SELECT doc_id, 'u' || doc_id AS url,
        CASE WHEN doc_id % {CHAIN} < {CHAIN - 1} THEN 'u' || (doc_id + 1) WHEN doc_id // {CHAIN} % 3 = 0 THEN 'u' || (doc_id - 15)
          WHEN doc_id // {CHAIN} % 3 = 1 THEN NULL ELSE 'u' || (doc_id - {CHAIN - 1}) END AS feed_url,
        CASE WHEN n_chars % 4 = 0 THEN 'o' || (doc_id % 5) END AS outcome FROM documents),
      walk AS (SELECT url AS origin, url AS at, [url] AS met, outcome, url AS found, feed_url FROM s
        UNION ALL
        SELECT w.origin, s.url, list_append(met, s.url), coalesce(s.outcome, w.outcome),
          CASE WHEN s.outcome IS NOT NULL THEN s.url ELSE found END, s.feed_url
        FROM walk w JOIN s ON s.url = w.feed_url WHERE NOT list_contains(met, s.url))
    SELECT origin, len(met) - 1 AS hops, coalesce(CASE WHEN outcome IS NOT NULL THEN found END, '-') AS source_url, coalesce(outcome, '-') AS strategy
    FROM walk QUALIFY row_number() OVER (PARTITION BY origin ORDER BY len(met) DESC) = 1""",
)
def _(spark, d):
    key, turn = F.col("doc_id"), F.floor(F.col("doc_id") / CHAIN) % 3
    url = lambda k: F.concat(F.lit("u"), k.cast("string"))
    state = v.table(spark, d, "documents").select(
        url(key).alias("source_url"),
        F.when(key % CHAIN < CHAIN - 1, url(key + 1)).when(turn == 0, url(key - 15)).when(turn == 2, url(key - (CHAIN - 1))).alias("feed_url"),
        F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("o"), (key % 5).cast("string"))).alias("outcome"),
    )
    out = cascade.follow_links(state, None)
    return out.select("origin", "hops", F.coalesce("source_url", F.lit("-")).alias("source_url"), F.coalesce("strategy", F.lit("-")).alias("strategy"))


def _rss():
    items = F.transform(
        F.filter(F.transform(_lines(), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.trim(s["x"]) != ""),
        lambda s: F.concat(F.lit("<item><title>"), escape_text(s["x"]), F.lit("</title><link>"), _address(s["i"]), F.lit("</link></item>")),
    )
    return F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>F</title>'), F.array_join(items, ""), F.lit("</channel></rss>"))


@R.query(
    "extract_cascade",
    "WITH "
    + LINES
    + """, n AS (SELECT doc_id, any_value(url) AS url, count(*) AS lines, count(DISTINCT link) AS links FROM posts GROUP BY doc_id),
    page AS (SELECT url AS source_url, CASE doc_id % 5 WHEN 0 THEN 'feed' WHEN 1 THEN 'template' WHEN 2 THEN 'jsonld' ELSE 'articles' END AS strategy,
      CASE WHEN doc_id % 5 < 2 THEN lines ELSE links END AS n FROM n WHERE doc_id % 5 <> 4 AND (doc_id % 5 <> 3 OR links >= 2))
    SELECT source_url, strategy, n FROM page
    UNION ALL SELECT replace(url, '/list/', '/feed/'), 'feed', lines FROM n WHERE doc_id % 5 = 0""",
)
def _(spark, d):
    kind = F.col("doc_id") % 5
    key = F.col("doc_id").cast("string")
    tag = _link_tag("application/rss+xml", F.concat(F.lit("/feed/"), key))
    body = (
        F.when(kind == 0, F.concat(tag, _articles()))
        .when(kind == 1, F.replace(_articles(), F.lit("article"), F.lit("section")))
        .when(kind == 2, F.concat(_ld(), _articles()))
        .when(kind == 3, _articles())
        .otherwise(F.concat(F.lit("<div>"), escape_text(F.col("text")), F.lit("</div>")))
    )
    pages = _pages(spark, d, body)
    feeds = (
        v.table(spark, d, "documents")
        .filter(kind == 0)
        .select(
            F.replace(_url(F.col("doc_id")), F.lit("/list/"), F.lit("/feed/")).alias("final_url"),
            _rss().alias("body"),
            F.lit("application/rss+xml").alias("content_type"),
        )
    )
    hosts = v.table(spark, d, "documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string"), F.lit(".example")).alias("host"))
    templates = _template(hosts, F.col("host"), item="section.post", title="h2", link="h2 a", date="time")
    documents = materialize(pages.unionByName(feeds))
    entries, _ = cascade.extract(documents, templates)
    return entries.groupBy("source_url", "strategy").agg(F.count("*").alias("n"))


@R.query(
    "template_propose",
    "WITH "
    + LINES
    + """, h AS (SELECT 's' || (doc_id % 50) || '.example' AS host, doc_id, url, pos, line FROM lines),
    top AS (SELECT host, string_agg(line, ' | ' ORDER BY pos) AS sample_titles FROM (
      SELECT *, row_number() OVER (PARTITION BY host ORDER BY url, pos) AS k FROM (
        SELECT * FROM h WHERE line <> '' QUALIFY url = min(url) OVER (PARTITION BY host))) WHERE k <= 5 GROUP BY host)
    SELECT host, 'Page' AS feedTitle, 'article.post' AS item, 'h2' AS title, 'h2 a' AS link, 'time' AS date,
      count(*) FILTER (line <> '') AS matched, count(DISTINCT doc_id) AS pages, any_value(sample_titles) AS sample_titles
    FROM h JOIN top USING (host) GROUP BY host""",
)
def _(spark, d):
    pages = _pages(spark, d, _articles()).unionByName(
        v.raw_documents(spark, d).select("final_url", "body", "content_type")
    )
    out = propose.propose_templates(pages)
    return out.withColumn("sample_titles", F.array_join("sample_titles", " | "))


@R.query(
    "fetch_meshes",
    "WITH "
    + NAV
    + f""", e AS (SELECT page_id % 10 AS mesh_ord, page_id // 10 AS part_ord, pos, title, origin || {ENC} AS link FROM nav WHERE page_id % 9 <> 0),
    m AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY mesh_ord, link ORDER BY part_ord, pos) = 1)
    SELECT mesh_ord, title, link, 'source ' || part_ord AS source_name FROM m
    QUALIFY row_number() OVER (PARTITION BY mesh_ord ORDER BY part_ord, pos) <= 40""",
)
def _(spark, d):
    docs = v.raw_documents(spark, d)
    key = F.col("page_id")
    documents = docs.withColumn("error", F.when(key % 9 == 0, F.lit("timeout")))
    sources = docs.select(
        F.lit("all").alias("construct"),
        (key % 10).alias("mesh_ord"),
        F.concat(F.lit("mesh "), (key % 10).cast("string")).alias("mesh_name"),
        F.floor(key / 10).alias("source_ord"),
        F.concat(F.lit("source "), F.floor(key / 10).cast("string")).alias("source_name"),
        F.col("requested_url").alias("source_url"),
    )
    fetched = meshes.fetch_meshes(sources, documents, _nav_templates(spark, d), limit=40)
    return fetched.entries.select("mesh_ord", "title", "link", F.col("source.name").alias("source_name"))
