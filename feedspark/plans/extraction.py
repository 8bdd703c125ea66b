"""Readers over documents written from the entry view; the twin is what a format carries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedspark.functions.dates import rfc3339
from feedspark.functions.text import escape_attr, escape_text
from feedspark.model import RAW_DOCUMENT
from feedspark.plans import views as v
from feedspark.plans.registry import Registry
from feedspark.session import shared_dir
from feedspark.sinks import compact as compact_sink
from feedspark.sinks import jsonfeed as jsonfeed_sink
from feedspark.sinks import opml as opml_sink
from feedspark.sinks import xmlfeeds as xml_sink
from feedspark.sinks.assemble import whole
from feedspark.sources import compact, dispatch, opml, raw

R = Registry()
P = "WITH " + ",".join([v.ENTRIES, v.PAGED, v.headers_sql("paged")])
W = "WITH " + ",".join([v.ENTRIES, v.headers_sql("entries")])
STRIP = "trim(regexp_replace(summary, '\\s+', ' ', 'g'))"
FILLED = f"CASE WHEN id = '' THEN 'urn:nwf:' || {v.fnv_sql('link || chr(10) || title')} ELSE id END"
POS = "row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) - 1"
TAGS = "array_to_string(tags, '|')"
PEOPLE = "array_to_string(authors, '|')"


def _paged(spark, d):
    pages = v.paged(v.entries(spark, d))
    return v.headers(pages), pages


def _sources(spark, d):
    entries = v.entries(spark, d)
    return v.headers(entries), entries


def _docs(written):
    return whole(written).select(F.col("feed_id").alias("final_url"), "body", F.lit("").alias("content_type"))


def _read(fmt, docs):
    return dispatch.read_feeds(docs, (fmt,))


def _names(col="authors"):
    return F.array_join(F.transform(F.coalesce(F.col(col), F.array()), lambda a: a["name"]), "|")


def _flat(entries, *extra):
    return entries.select(
        F.col("source_url").alias("feed_id"),
        F.col("entry_ord").alias("pos"),
        "id",
        "title",
        "link",
        v.ms(F.col("published")).alias("published_ms"),
        v.ms(F.col("updated")).alias("updated_ms"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        _names().alias("authors"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"),
        *extra,
    )


def _flat_sql(published, updated, summary, authors, extra="", ids=FILLED):
    return f"""SELECT feed_id, {POS} AS pos, {ids} AS id, title, link,
      coalesce(epoch_ms({published}), -1) AS published_ms, coalesce(epoch_ms({updated}), -1) AS updated_ms,
      coalesce({summary}, '') AS summary, {authors} AS authors, {TAGS} AS tags{extra}"""


@R.query(
    "rss_extract",
    P
    + _flat_sql(
        "date_trunc('second', coalesce(published, updated))",
        "NULL::TIMESTAMP",
        STRIP,
        "CASE WHEN len(authors) = 1 THEN authors[1] ELSE '' END",
    )
    + " FROM paged",
)
def _(spark, d):
    _, entries, _ = _read("rss", _docs(xml_sink.write_rss(*_paged(spark, d))))
    return _flat(entries)


@R.query(
    "atom_extract",
    P
    + """, p AS (SELECT paged.* REPLACE (coalesce(paged.updated, published, feeds.updated) AS updated) FROM paged JOIN feeds USING (feed_id)) """
    + _flat_sql("published", "updated", STRIP, PEOPLE)
    + " FROM p",
)
def _(spark, d):
    _, entries, _ = _read("atom", _docs(xml_sink.write_atom(*_paged(spark, d))))
    return _flat(entries)


@R.query(
    "atom_feeds",
    P
    + """SELECT feed_id AS source_url, feed_id, title, home, self, epoch_ms(updated) AS updated_ms,
      'Desk & Co,https://desk.example/,desk@example.org' AS author FROM feeds""",
)
def _(spark, d):
    feeds, _, _ = _read("atom", _docs(xml_sink.write_atom(*_paged(spark, d))))
    a = F.col("authors").getItem(0)
    author = F.concat_ws(",", a["name"], a["url"], a["email"])
    return feeds.select("source_url", "feed_id", "title", "home", "self", v.ms(F.col("updated")).alias("updated_ms"), author.alias("author"))


def _rdf(pages):
    """RDF documents of paged feeds from a small template."""
    e = escape_text
    item = F.concat(
        F.lit('<item rdf:about="'),
        escape_attr(F.col("link")),
        F.lit('"><title>'),
        e(F.col("title")),
        F.lit("</title><link>"),
        e(F.col("link")),
        F.lit("</link><dc:date>"),
        rfc3339(F.coalesce("published", "updated", F.lit(v.NOW))),
        F.lit("</dc:date><dc:creator>"),
        F.col("authors").getItem(0)["name"],
        F.lit("</dc:creator><description><![CDATA[<p>"),
        e(F.coalesce("summary", F.lit(""))),
        F.lit("</p>]]></description></item>"),
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("entry_ord", item.alias("x")))), lambda s: s["x"])
    return pages.groupBy("feed_id").agg(items.alias("items")).select(
        F.col("feed_id").alias("final_url"),
        F.concat(
            F.lit('<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>RDF &middot; '),
            "feed_id",
            F.lit("</title><link>https://rdf.example/</link><dc:date>2024-01-05T00:00:00Z</dc:date></channel>"),
            F.array_join("items", ""),
            F.lit("</rdf:RDF>"),
        ).alias("body"),
        F.lit("text/xml").alias("content_type"),
    )


RDF_SUMMARY = "replace(replace(replace(" + STRIP + ", '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@R.query(
    "rdf_extract",
    P
    + _flat_sql(
        f"coalesce(published, updated, {v.NOW_SQL})",
        "NULL::TIMESTAMP",
        RDF_SUMMARY,
        "authors[1]",
        ids=f"'urn:nwf:' || {v.fnv_sql('link || chr(10) || title')}",
    ).replace(f"{TAGS} AS tags", "'' AS tags")
    + " FROM paged",
)
def _(spark, d):
    _, entries, _ = _read("rdf", _rdf(_paged(spark, d)[1]))
    return _flat(entries)


@R.query(
    "jsonfeed_extract",
    P + _flat_sql("published", "updated", "summary", PEOPLE) + " FROM paged",
)
def _(spark, d):
    _, entries, _ = _read("json", _docs(jsonfeed_sink.write_jsonfeed(*_paged(spark, d))))
    return _flat(entries)


DISPATCH = """part_ord % 5"""


def _mixed(spark, d):
    """Each source in one of five formats; the last is plain text."""
    feeds, pages = _paged(spark, d)
    number = F.regexp_extract("feed_id", r"^src(\d+)", 1).cast("int") % 5
    pick = lambda df, i: df.filter(number == i)
    written = [
        _docs(xml_sink.write_rss(pick(feeds, 0), pick(pages, 0))),
        _docs(xml_sink.write_atom(pick(feeds, 1), pick(pages, 1))),
        _docs(jsonfeed_sink.write_jsonfeed(pick(feeds, 2), pick(pages, 2))),
        _rdf(pick(pages, 3)),
        _docs(pick(feeds, 4).withColumn("body", F.concat(F.lit("plain text of "), "title")).withColumn("part_no", F.lit(0))),
    ]
    out = written[0]
    for df in written[1:]:
        out = out.unionByName(df)
    return out


@R.query(
    "feed_dispatch",
    P
    + f"""SELECT feed_id, CASE {DISPATCH} WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'json' WHEN 3 THEN 'rdf' ELSE 'reject' END AS format,
      CASE WHEN {DISPATCH} = 4 THEN 0 ELSE count(*) END AS n FROM paged GROUP BY feed_id, part_ord""",
)
def _(spark, d):
    _, entries, rejects = dispatch.read_feeds(_mixed(spark, d), keep=True)
    counted = entries.groupBy(F.col("source_url").alias("feed_id"), "format").agg(F.count("*").alias("n"))
    bad = rejects.select(F.col("key").alias("feed_id"), F.lit("reject").alias("format"), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(bad)


@R.query(
    "detect_kind",
    P
    + f""", k AS (SELECT DISTINCT feed_id, CASE {DISPATCH} WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'jsonfeed' WHEN 3 THEN 'rdf' ELSE 'html' END AS kind FROM paged)
    SELECT feed_id AS url, kind FROM k UNION ALL
    SELECT url, CASE page_id % 3 WHEN 0 THEN 'atom' WHEN 1 THEN 'jsonfeed' ELSE 'html' END FROM pages""",
)
def _(spark, d):
    docs = _mixed(spark, d)
    key = F.col("page_id") % 3
    declared = (
        F.when(key == 0, F.lit("application/Atom+xml; charset=utf-8"))
        .when(key == 1, F.lit("application/feed+json"))
        .otherwise(F.lit("text/html"))
    )
    pages = v.raw_documents(spark, d).select("final_url", "body", declared.alias("content_type"))
    kind = raw.detect_kind(F.col("content_type"), F.col("body"))
    return docs.unionByName(pages).select(F.col("final_url").alias("url"), kind.alias("kind"))


@R.query(
    "nwf_roundtrip",
    W
    + _flat_sql(
        "NULL::TIMESTAMP",
        "date_trunc('second', coalesce(updated, published))",
        "summary",
        PEOPLE,
        ", source_name, source_url",
        ids="id",
    )
    + " FROM entries",
)
def _(spark, d):
    _, entries, _ = compact.read_compact_parts(compact_sink.write_compact(*_sources(spark, d)))
    return entries.select(
        F.col("source_url").alias("feed_id"),
        F.col("entry_ord").alias("pos"),
        "id",
        "title",
        "link",
        v.ms(F.col("published")).alias("published_ms"),
        v.ms(F.col("updated")).alias("updated_ms"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        _names().alias("authors"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"),
        F.col("source.name").alias("source_name"),
        F.col("source.url").alias("source_url"),
    )


@R.query(
    "nwf_feeds",
    W
    + """SELECT feed_id, title, home, self, epoch_ms(date_trunc('second', updated)) AS updated_ms,
      'Desk & Co,https://desk.example/,desk@example.org' AS author FROM feeds""",
)
def _(spark, d):
    feeds, _, _ = compact.read_compact_parts(compact_sink.write_compact(*_sources(spark, d)))
    a = F.col("authors").getItem(0)
    author = F.concat_ws(",", a["name"], a["url"], a["email"])
    return feeds.select("feed_id", "title", "home", "self", v.ms(F.col("updated")).alias("updated_ms"), author.alias("author"))


# One small document per row of the documents table, broken in a way its id decides.
BROKEN = [
    (["NWF2"], [(1, "error", "header", 'first line is not the format\'s mark: "NWF2"')]),
    (["NWF1", "F\tid\ttitle"], [
        (2, "error", "feed_cells", "feed line too short: 3 of 6 cells"),
        (2, "error", "feed_epoch", 'feed time is no whole number: ""'),
        (1, "warning", "no_entries", "no entry line"),
    ]),
    (["NWF1", "F\tid\tt\t\t\t12x\t0,z", "A\tann", "E\t{id}\t5\tl\t0,3\tq\ttitle\t\t0"], [
        (2, "error", "feed_epoch", 'feed time is no whole number: "12x"'),
        (2, "error", "feed_refs", 'feed author reference is not a number: "z"'),
        (4, "error", "entry_refs", "author reference 3 points past the 1 listed values"),
        (4, "error", "entry_refs", 'tag reference is not a number: "q"'),
        (4, "error", "entry_source", "source reference 0 points past the 0 listed values"),
    ]),
    (["NWF1", "F\tid\tt\t\t\t1\t", "B\t", "E\t\t1x\t\t\t\ttitle", "X\t1", "E\tshort"], [
        (3, "warning", "base", "base line without an address"),
        (4, "error", "entry_id", "entry id is blank"),
        (4, "error", "entry_delta", 'entry time is neither a dash nor a whole number: "1x"'),
        (4, "warning", "entry_link", "entry link is blank"),
        (5, "error", "kind", 'line of no known kind: "X"'),
        (6, "error", "entry_cells", "entry line too short: 2 of 7 cells"),
    ]),
    (["NWF1", "E\t{id}\t-\tl\t\t\ttitle\t\tone"], [
        (1, "error", "feed_missing", "no feed line"),
        (2, "error", "entry_source", 'source reference is not a number: "one"'),
    ]),
    (["NWF1", "F\tid\tt\t\t\t1\t", "F\tid\tt\t\t\t1\t", "T\tx\ty", "S\ts", "E\t{id}\t-7\tl\t\t1,0\ttitle\ts\t0"], [
        (1, "error", "feed_repeated", "feed line given 2 times"),
    ]),
    (["NWF1", "F\tid\tt\t\t\t1\t", "E\t{id}\t-7\tl\t\t\ttitle\t{line}"], []),
]
FIRST_LINE = "coalesce(split_part(text, chr(10), 1), '')"
_quote = lambda s: "'" + s.replace("'", "''") + "'"


@R.query(
    "nwf_validate",
    "WITH issue(k, line, severity, rule, message) AS (VALUES "
    + ", ".join(
        f"({k}, {line}, '{sev}', '{rule}', {_quote(msg)})"
        for k, (_, issues) in enumerate(BROKEN)
        for line, sev, rule, msg in issues
    )
    + ") SELECT CAST(doc_id AS VARCHAR) AS doc_key, line, severity, rule, message FROM documents JOIN issue ON doc_id % "
    + str(len(BROKEN))
    + " = k",
)
def _(spark, d):
    docs = v.table(spark, d, "documents")
    id_, line = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.substring_index("text", "\n", 1)
    body = F.lit(None).cast("string")
    for k, (lines, _) in enumerate(BROKEN):
        text = F.replace(F.replace(F.lit("\n".join(lines) + "\n"), F.lit("{id}"), id_), F.lit("{line}"), line)
        body = F.when(F.col("doc_id") % len(BROKEN) == k, text).otherwise(body)
    out = compact.validate_compact(docs.select(F.col("doc_id").cast("string").alias("final_url"), body.alias("body")))
    return out.withColumn("line", F.col("line").cast("long"))


@R.query(
    "opml_import",
    "WITH "
    + v.MESHES
    + """SELECT construct AS mesh_name, row_number() OVER (PARTITION BY construct ORDER BY mesh_ord, source_ord) - 1 AS source_ord,
      source_name, source_url FROM mesh""",
)
def _(spark, d):
    rows = v.meshes(spark, d)
    members = rows.select("construct", "mesh_ord", "mesh_name").distinct()
    written = opml_sink.construct_opml(rows.select("construct").distinct(), members, rows)
    docs = whole(written, ["construct"]).withColumnRenamed("construct", "final_url")
    sources, _ = opml.read_opml(docs)
    return sources.select("mesh_name", F.col("source_ord").cast("long").alias("source_ord"), "source_name", "source_url")


# ---- raw documents ----


@R.query(
    "raw_scan",
    "SELECT url AS requested_url, md5(html) AS etag, length(html) AS n_chars, md5(html) AS body_md5 FROM pages",
)
def _(spark, d):
    absent = lambda t: F.lit(None).cast(t)
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    stored = v.raw_documents(spark, d).select(
        *[c for c in RAW_DOCUMENT.fieldNames() if c not in ("last_modified", "error", "snapshot_ts")],
        absent("string").alias("last_modified"),
        absent("string").alias("error"),
        absent("timestamp").alias("snapshot_ts"),
    )
    stored.write.parquet(path)
    docs = raw.scan_table(spark, path)
    return docs.select(
        "requested_url",
        "etag",
        F.length("body").cast("long").alias("n_chars"),
        F.md5("body").alias("body_md5"),
    )


@R.query(
    "carry_forward",
    """SELECT url AS requested_url, CASE page_id % 3 WHEN 0 THEN 304 ELSE 200 END AS http_status,
      CASE WHEN page_id % 3 = 0 THEN md5(html || 'v2') ELSE md5(html || 'v3') END AS body_md5,
      CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS carried FROM pages WHERE page_id % 7 <> 0""",
)
def _(spark, d):
    docs = v.raw_documents(spark, d)
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    version = lambda n: docs.withColumn("body", F.concat("body", F.lit(f"v{n}"))).withColumn("snapshot_ts", at(n))
    full = lambda df: df.withColumn("last_modified", F.lit(None).cast("string"))
    previous = full(version(1)).unionByName(full(version(2)))
    unchanged = F.col("page_id") % 3 == 0
    current = full(version(3).filter(F.col("page_id") % 7 != 0))
    current = current.withColumn("http_status", F.when(unchanged, 304).otherwise(200)).withColumn(
        "body", F.when(~unchanged, F.col("body"))
    )
    out = raw.carry_forward(current, previous)
    return out.select(
        "requested_url",
        F.col("http_status").cast("long").alias("http_status"),
        F.md5("body").alias("body_md5"),
        F.col("carried").cast("long").alias("carried"),
    )


HISTORY = """
history AS (SELECT 'u' || (event_id % 97) AS url, ts, event_id, event_id % 4 = 0 AS asks FROM events)
"""


@R.query(
    "carry_history",
    "WITH "
    + HISTORY
    + """SELECT q.event_id, coalesce('v' || a.event_id, '-') AS body, CAST(a.event_id IS NOT NULL AS BIGINT) AS carried
      FROM (SELECT * FROM history WHERE asks) q
        ASOF LEFT JOIN (SELECT url, ts, max(event_id) AS event_id FROM history WHERE NOT asks GROUP BY url, ts) a ON q.url = a.url AND q.ts >= a.ts""",
)
def _(spark, d):
    """One snapshot per event: a fourth of them were not modified since the one before."""
    key = F.col("event_id")
    absent = F.lit(None).cast("string")
    version = F.concat(F.lit("v"), key.cast("string"))
    rows = v.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("u"), (key % 97).cast("string")).alias("requested_url"),
        F.col("ts").cast("timestamp").alias("snapshot_ts"),
        F.when(key % 4 == 0, 304).otherwise(200).alias("http_status"),
        F.when(key % 4 != 0, version).alias("body"),
        F.lpad(key.cast("string"), 20, "0").alias("etag"),
        absent.alias("final_url"),
        absent.alias("content_type"),
        absent.alias("last_modified"),
    )
    out = raw.carry_forward(rows.filter("http_status = 304"), rows.filter("http_status = 200"))
    return out.select("event_id", F.coalesce("body", F.lit("-")).alias("body"), F.col("carried").cast("long").alias("carried"))


@R.query(
    "page_title",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 5 = 1 THEN 'Site ' || page_id
      ELSE trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g')) END AS title FROM pages""",
)
def _(spark, d):
    key = F.col("page_id")
    meta = F.concat(F.lit('<meta content=" Site '), key.cast("string"), F.lit('" property="og:site_name"/>'))
    body = (
        F.when(key % 5 == 0, F.regexp_replace("html", "<title>[^<]*</title>", "<title> </title>"))
        .when(key % 5 == 1, F.concat(meta, "html"))
        .otherwise(F.col("html"))
    )
    docs = v.table(spark, d, "pages").withColumn("html", body)
    return docs.select("page_id", raw.page_title(F.col("html"), F.col("url")).alias("title"))
