"""Writers over the feeds of whole sources; documents are compared part by part."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedspark.operators import dictionary
from feedspark.plans import views as v
from feedspark.plans.registry import Registry
from feedspark.sinks import compact, formats, jsonfeed, markdown, opml, payloads, xmlfeeds

R = Registry()
P = "WITH " + ",".join([v.ENTRIES, v.headers_sql("entries")])
PAGED = "WITH " + ",".join([v.ENTRIES, v.PAGED, v.headers_sql("paged")])
ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ATTR = lambda x: f"replace({ESC(x)}, '\"', '&quot;')"
STAMP = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"
MAIL = lambda x: f"strftime({x}, '%a, %d %b %Y %H:%M:%S') || ' GMT'"


def _sources(spark, d):
    entries = v.entries(spark, d)
    return v.headers(entries), entries


def _paged(spark, d):
    pages = v.paged(v.entries(spark, d))
    return v.headers(pages), pages


def _doc(df):
    return df.select("feed_id", "part_no", "body")


@R.query(
    "write_atom",
    P
    + f""", items AS (SELECT p.feed_id, entry_ord, '  <entry>
    <id>' || {ESC("p.id")} || '</id>
    <title>' || {ESC("p.title")} || '</title>
    <link rel="alternate" href="' || link || '"/>
    <updated>' || {STAMP("coalesce(p.updated, published, f.updated)")} || '</updated>
' || coalesce('    <published>' || {STAMP("published")} || '</published>
', '') || array_to_string(list_transform(authors, lambda a: '    <author>
      <name>' || a || '</name>
    </author>
'), '') || array_to_string(list_transform(tags, lambda t: '    <category term="' || t || '"/>
'), '') || coalesce('    <summary type="text">' || {ESC("summary")} || '</summary>
', '') || '  </entry>
' AS item FROM entries p JOIN feeds f USING (feed_id)),
    frag AS (SELECT feed_id, 10 AS section, 0 AS a, entry_ord AS b, item AS text FROM items
    UNION ALL SELECT feed_id, 20, 0, 0, '</feed>
' FROM feeds
    UNION ALL SELECT feed_id, 0, 0, 0, '<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom">
  <id>' || feed_id || '</id>
  <title>' || title || '</title>
  <updated>' || {STAMP("updated")} || '</updated>
  <link rel="alternate" href="' || home || '"/>
  <link rel="self" href="' || self || '"/>
  <author>
    <name>Desk &amp; Co</name>
    <uri>https://desk.example/</uri>
    <email>desk@example.org</email>
  </author>
  <generator version="0.1.0">feedspark</generator>
' FROM feeds) {v.parts_sql()}""",
)
def _(spark, d):
    return _doc(xmlfeeds.write_atom(*_sources(spark, d)))


@R.query(
    "write_rss",
    P
    + f""", items AS (SELECT feed_id, entry_ord, '    <item>
      <title>' || {ESC("title")} || '</title>
      <link>' || link || '</link>
      <guid isPermaLink="false">' || id || '</guid>
' || coalesce('      <pubDate>' || {MAIL("coalesce(published, updated)")} || '</pubDate>
', '') || array_to_string(list_transform(authors, lambda a: '      <dc:creator>' || a || '</dc:creator>
'), '') || array_to_string(list_transform(tags, lambda t: '      <category>' || t || '</category>
'), '') || coalesce('      <description>' || {ESC("summary")} || '</description>
', '') || '      <source url="' || source_url || '">' || source_name || '</source>
    </item>
' AS item FROM entries),
    frag AS (SELECT feed_id, 10 AS section, 0 AS a, entry_ord AS b, item AS text FROM items
    UNION ALL SELECT feed_id, 20, 0, 0, '  </channel>
</rss>
' FROM feeds
    UNION ALL SELECT feed_id, 0, 0, 0, '<?xml version="1.0" encoding="utf-8"?>
<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/">
  <channel>
    <title>' || title || '</title>
    <link>' || home || '</link>
    <description>' || title || '</description>
    <atom:link href="' || self || '" rel="self" type="application/rss+xml"/>
    <lastBuildDate>' || {MAIL("updated")} || '</lastBuildDate>
    <generator>feedspark 0.1.0</generator>
' FROM feeds) {v.parts_sql()}""",
)
def _(spark, d):
    return _doc(xmlfeeds.write_rss(*_sources(spark, d)))


JSON_ITEM = f"""'    {{
      "id": ' || to_json(id) || ',
      "url": ' || to_json(link) || ',
      "title": ' || to_json(title) || coalesce(',
      "summary": ' || to_json(summary), '') || coalesce(',
      "date_published": "' || {STAMP("published")} || '"', '') || coalesce(',
      "date_modified": "' || {STAMP("updated")} || '"', '') || ',
      "authors": [
' || array_to_string(list_transform(authors, lambda a: '        {{
          "name": ' || to_json(a) || '
        }}'), ',
') || '
      ]' || CASE WHEN len(tags) > 0 THEN ',
      "tags": [
' || array_to_string(list_transform(tags, lambda t: '        ' || to_json(t)), ',
') || '
      ]' ELSE '' END || '
    }}'"""


@R.query(
    "write_jsonfeed",
    P
    + f""", items AS (SELECT feed_id, entry_ord, {JSON_ITEM} AS item FROM entries),
    frag AS (SELECT feed_id, 10 AS section, 0 AS a, entry_ord AS b,
      CASE WHEN row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) > 1 THEN ',
' ELSE '' END || item AS text FROM items
    UNION ALL SELECT feed_id, 20, 0, 0, '
  ]
}}
' FROM feeds
    UNION ALL SELECT feed_id, 0, 0, 0, '{{
  "version": "https://jsonfeed.org/version/1.1",
  "title": ' || to_json(title) || ',
  "home_page_url": ' || to_json(home) || ',
  "feed_url": ' || to_json(self) || ',
  "authors": [
    {{
      "name": "Desk & Co",
      "url": "https://desk.example/"
    }}
  ],
  "items": [
' FROM feeds) {v.parts_sql()}""",
)
def _(spark, d):
    return _doc(jsonfeed.write_jsonfeed(*_sources(spark, d)))


@R.query(
    "write_markdown",
    P
    + """, items AS (SELECT feed_id, entry_ord, '

### [' || title || '](' || link || ')

' || concat_ws(' · ', strftime(coalesce(updated, published), '%Y-%m-%d'), array_to_string(authors, ', '),
      CASE WHEN len(tags) > 0 THEN array_to_string(list_transform(tags, lambda t: '`' || t || '`'), ' ') END)
    || coalesce('

' || summary, '') AS item FROM entries),
    frag AS (SELECT feed_id, 10 AS section, 0 AS a, entry_ord AS b, item AS text FROM items
    UNION ALL SELECT feed_id, 20, 0, 0, '
' FROM feeds
    UNION ALL SELECT feed_id, 0, 0, 0, '# ' || title || '

Updated ' || strftime(updated, '%Y-%m-%d') || ' · [Home](' || home || ') · [Feed](' || self || ')' FROM feeds) """
    + v.parts_sql(),
)
def _(spark, d):
    return _doc(markdown.write_markdown(*_sources(spark, d)))


# ---- compact format ----

DICT = """
mention AS (
  SELECT feed_id, 'A' AS kind, -1 AS entry_ord, 0 AS idx,
    'Desk & Co' || chr(31) || 'https://desk.example/' || chr(31) || 'desk@example.org' AS cell FROM feeds
  UNION ALL SELECT feed_id, 'A', entry_ord, generate_subscripts(authors, 1), unnest(authors) FROM entries
  UNION ALL SELECT feed_id, 'T', entry_ord, generate_subscripts(tags, 1), unnest(tags) FROM entries
  UNION ALL SELECT feed_id, 'S', entry_ord, 0, source_name || chr(31) || source_url FROM entries),
dict AS (
  SELECT feed_id, kind, cell, row_number() OVER (PARTITION BY feed_id, kind ORDER BY entry_ord, idx) - 1 AS ref
  FROM (SELECT * FROM mention QUALIFY row_number() OVER (PARTITION BY feed_id, kind, cell ORDER BY entry_ord, idx) = 1))
"""


@R.query("nwf_dict", P + "," + DICT + "SELECT feed_id, kind, cell, ref FROM dict")
def _(spark, d):
    feeds, pages = _sources(spark, d)
    found = dictionary.mentions(pages).unionByName(dictionary.feed_mentions(feeds))
    return dictionary.intern(found).select("feed_id", "kind", "cell", "ref")


@R.query(
    "link_base",
    P
    + """, l AS (SELECT feed_id, CASE WHEN part_ord % 2 = 0 THEN link ELSE replace(link, 'example/', 'example/' || part_ord || '/x') END AS link, part_ord FROM entries)
    SELECT feed_id, CASE WHEN count(*) < 2 THEN '' WHEN min(link) = max(link) THEN regexp_replace(min(link), '[^/]*$', '')
      WHEN any_value(part_ord) % 2 = 0 THEN 'https://copy.example/'
      ELSE 'https://copy.example/' || any_value(part_ord) || '/' END AS base FROM l GROUP BY feed_id""",
)
def _(spark, d):
    _, pages = _sources(spark, d)
    part = F.col("part_ord")
    moved = F.replace(
        F.col("link"), F.lit("example/"), F.concat(F.lit("example/"), part.cast("string"), F.lit("/x"))
    )
    return dictionary.link_base(pages.withColumn("link", F.when(part % 2 == 0, F.col("link")).otherwise(moved)))


@R.query(
    "write_compact",
    P
    + ","
    + DICT
    + """, refs AS (SELECT m.feed_id, m.entry_ord, m.kind, string_agg(d.ref, ',' ORDER BY m.idx) AS refs
      FROM mention m JOIN dict d ON m.feed_id = d.feed_id AND m.kind = d.kind AND m.cell = d.cell GROUP BY ALL),
    frag AS (
      SELECT feed_id, 0 AS section, 0 AS a, 0 AS b, 'NWF1' || chr(10) || concat_ws(chr(9), 'F', feed_id, title, home, self,
        epoch_ms(date_trunc('second', updated)) // 1000, '0') AS text FROM feeds
      UNION ALL SELECT feed_id, CASE kind WHEN 'A' THEN 1 WHEN 'T' THEN 2 ELSE 3 END, 0, ref,
        CASE WHEN ref = 0 THEN chr(10) || kind ELSE '' END || chr(9) || cell FROM dict
      UNION ALL SELECT feed_id, 4, 0, 0, chr(10) || 'B' || chr(9) || 'https://copy.example/' FROM entries GROUP BY feed_id HAVING count(*) > 1
      UNION ALL SELECT feed_id, 20, 0, 0, chr(10) FROM feeds
      UNION ALL SELECT p.feed_id, 10, 0, p.entry_ord, chr(10) || concat_ws(chr(9), 'E', id,
        coalesce(CAST(epoch_ms(date_trunc('second', f.updated)) // 1000
          - epoch_ms(date_trunc('second', coalesce(p.updated, published))) // 1000 AS VARCHAR), '-'),
        CASE WHEN n > 1 THEN '~' || replace(link, 'https://copy.example/', '') ELSE link END, a.refs, coalesce(t.refs, ''),
        p.title, coalesce(replace(summary, chr(10), '\\n'), ''), '0')
      FROM entries p JOIN feeds f ON p.feed_id = f.feed_id
        JOIN (SELECT feed_id, count(*) AS n FROM entries GROUP BY feed_id) c ON c.feed_id = p.feed_id
        JOIN refs a ON a.feed_id = p.feed_id AND a.entry_ord = p.entry_ord AND a.kind = 'A'
        LEFT JOIN refs t ON t.feed_id = p.feed_id AND t.entry_ord = p.entry_ord AND t.kind = 'T') """
    + v.parts_sql(),
)
def _(spark, d):
    return _doc(compact.write_compact(*_sources(spark, d)))


# ---- subscription lists and payloads ----


OUTLINE = """'<outline type="rss" text="' || source_name || '" title="' || source_name || '" xmlUrl="' || source_url || '" htmlUrl="' || source_url || '"/>
'"""
OPML_HEAD = """'<?xml version="1.0" encoding="utf-8"?>
<opml version="2.0">
  <head>
    <title>' || {} || '</title>
  </head>
  <body>
'"""
OPML_END = """'  </body>
</opml>
'"""


@R.query(
    "opml_export",
    "WITH "
    + v.MESHES
    + f""", frag AS (SELECT DISTINCT mesh_name, 0 AS section, 0 AS a, 0 AS b, {OPML_HEAD.format("mesh_name")} AS text FROM mesh
      UNION ALL SELECT DISTINCT mesh_name, 20, 0, 0, {OPML_END} FROM mesh
      UNION ALL SELECT mesh_name, 10, source_ord, 0, '    ' || {OUTLINE} FROM mesh) {v.parts_sql("mesh_name")}""",
)
def _(spark, d):
    sources = v.meshes(spark, d)
    return opml.mesh_opml(sources.select("mesh_name").distinct(), sources)


@R.query(
    "opml_construct",
    "WITH "
    + v.MESHES
    + f""", cat AS (SELECT DISTINCT construct, mesh_ord, mesh_name FROM mesh),
    frag AS (SELECT DISTINCT construct, 0 AS section, 0 AS a, 0 AS b, {OPML_HEAD.format("construct")} AS text FROM mesh
      UNION ALL SELECT DISTINCT construct, 20, 0, 0, {OPML_END} FROM mesh
      UNION ALL SELECT construct, 10, mesh_ord, -1, '    <outline text="' || mesh_name || '" title="' || mesh_name
        || CASE WHEN mesh_ord % 5 = 2 THEN '"/>
' ELSE '">
' END FROM cat
      UNION ALL SELECT construct, 10, mesh_ord, source_ord, '      ' || {OUTLINE} FROM mesh WHERE mesh_ord % 5 <> 2
      UNION ALL SELECT construct, 10, mesh_ord, 4611686018427387904, '    </outline>
' FROM cat WHERE mesh_ord % 5 <> 2) {v.parts_sql("construct")}""",
)
def _(spark, d):
    rows = v.meshes(spark, d)
    members = rows.select("construct", "mesh_ord", "mesh_name").distinct()
    inline = rows.filter(F.col("mesh_ord") % 5 != 2)
    return opml.construct_opml(rows.select("construct").distinct(), members, inline)


@R.query(
    "sink_payloads",
    PAGED
    + """, top AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) AS k,
        count(*) OVER (PARTITION BY feed_id) AS n FROM paged),
    txt AS (SELECT f.feed_id, any_value(f.title) || ': ' || any_value(n) || ' new' || chr(10)
        || string_agg('• ' || t.title || ' - ' || link, chr(10) ORDER BY entry_ord) FILTER (k <= 10)
        || CASE WHEN any_value(n) > 10 THEN chr(10) || '…and ' || (any_value(n) - 10) || ' more' ELSE '' END AS text
      FROM top t JOIN feeds f ON t.feed_id = f.feed_id GROUP BY f.feed_id)
    SELECT feed_id, 'slack' AS kind, '{"text":' || to_json(text) || '}' AS body FROM txt
    UNION ALL SELECT feed_id, 'discord', '{"content":' || to_json(substr(text, 1, 2000)) || '}' FROM txt""",
)
def _(spark, d):
    feeds, pages = _paged(spark, d)
    return payloads.chat_payloads(feeds, pages).select("feed_id", "kind", "body")


@R.query(
    "sink_kind",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'slack' WHEN 1 THEN 'discord' WHEN 2 THEN 'discord' ELSE 'webhook' END AS kind FROM pages""",
)
def _(spark, d):
    key = F.col("page_id") % 4
    url = (
        F.when(key == 0, F.lit("https://hooks.slack.com/services/"))
        .when(key == 1, F.lit("https://discord.com/api/"))
        .when(key == 2, F.lit("https://discordapp.com/api/"))
        .otherwise(F.col("url"))
    )
    return v.table(spark, d, "pages").select("page_id", payloads.sink_kind(url).alias("kind"))


# Each source names its format; every sixth asks for one that does not exist.
@R.query(
    "write_mixed",
    P
    + """, asked AS (SELECT feed_id, ['atom', 'rss', 'json', 'md', 'nwf', 'pdf'][CAST(substr(feed_id, 4) AS BIGINT) % 6 + 1] AS format FROM feeds)
    SELECT feed_id, format, CASE format WHEN 'atom' THEN 'xml' WHEN 'rss' THEN 'xml' WHEN 'json' THEN 'json' WHEN 'md' THEN 'md'
        WHEN 'nwf' THEN 'nwf' END AS extension, CASE format WHEN 'atom' THEN 'application/atom+xml; charset=utf-8'
        WHEN 'rss' THEN 'application/rss+xml; charset=utf-8' WHEN 'json' THEN 'application/feed+json; charset=utf-8'
        WHEN 'md' THEN 'text/markdown; charset=utf-8' WHEN 'nwf' THEN 'text/plain; charset=utf-8'
        ELSE 'unknown format "' || format || '"' END AS media_type FROM asked""",
)
def _(spark, d):
    feeds, entries = _sources(spark, d)
    names = F.array(*[F.lit(x) for x in (*formats.FORMATS, "pdf")])
    number = (F.substring("feed_id", 4, 20).cast("int") % 6) + 1
    documents, rejects = formats.serialize_by(feeds.withColumn("format", F.element_at(names, number)), entries)
    first = documents.filter("part_no = 0").select("feed_id", "format", "extension", "media_type")
    unknown = rejects.select(
        F.col("key").alias("feed_id"), F.lit("pdf").alias("format"), F.lit(None).cast("string").alias("extension"), F.col("reason").alias("media_type")
    )
    return first.unionByName(unknown)
