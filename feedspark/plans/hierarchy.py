"""Meshes, constructs and definition tables over the order hierarchy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedspark.functions import dates
from feedspark.operators import definitions as defs
from feedspark.operators import merge, overview, validate
from feedspark.plans import views as v
from feedspark.plans.registry import Registry
from feedspark.session import shared_dir
from feedspark.sources import definitions as files

R = Registry()
H = "WITH " + v.HIERARCHY
M = "WITH " + v.MESHES
PER_MESH = 100
GROUPED = f""", grouped AS (
  SELECT * FROM (
    SELECT * FROM hier QUALIFY row_number() OVER (
      PARTITION BY construct, mesh_ord, link ORDER BY part_ord, entry_ord) = 1)
  QUALIFY row_number() OVER (
    PARTITION BY construct, mesh_ord ORDER BY published DESC, part_ord, entry_ord) <= {PER_MESH})
"""


def strings(df, *names):
    return df.select(*[F.col(n).cast("long") if n.endswith("_ord") else F.col(n) for n in names])


@R.query("construct_grouped", H + GROUPED + "SELECT construct, mesh_ord, entry_ord, link, title FROM grouped")
def _(spark, d):
    df = merge.grouped_construct(v.hierarchy(spark, d), PER_MESH)
    return strings(df, "construct", "mesh_ord", "entry_ord", "link", "title")


@R.query(
    "construct_flatten",
    H
    + GROUPED
    + """SELECT construct, entry_ord, link, mesh_name AS source_name FROM grouped
      QUALIFY row_number() OVER (PARTITION BY construct, link
        ORDER BY mesh_ord, published DESC, part_ord, entry_ord) = 1""",
)
def _(spark, d):
    flat = merge.flatten_construct(merge.grouped_construct(v.hierarchy(spark, d), PER_MESH))
    return flat.select("construct", "entry_ord", "link", F.col("source.name").alias("source_name"))


PER_CONSTRUCT = 25


@R.query(
    "construct_latest",
    H
    + GROUPED
    + f""", flat AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY construct, link
        ORDER BY mesh_ord, published DESC, part_ord, entry_ord) = 1)
    SELECT construct, entry_ord, link, mesh_name AS source_name FROM flat
      QUALIFY row_number() OVER (PARTITION BY construct
        ORDER BY published DESC, mesh_ord, part_ord, entry_ord) <= {PER_CONSTRUCT}""",
)
def _(spark, d):
    flat = merge.flatten_construct(merge.grouped_construct(v.hierarchy(spark, d), PER_MESH), PER_CONSTRUCT)
    return flat.select("construct", "entry_ord", "link", F.col("source.name").alias("source_name"))


@R.query(
    "topn_per_mesh",
    H
    + """SELECT construct, mesh_ord, entry_ord, rank FROM (
      SELECT construct, mesh_ord, entry_ord, row_number() OVER (
        PARTITION BY construct, mesh_ord ORDER BY published DESC, part_ord, entry_ord) AS rank FROM hier)
      WHERE rank <= 10""",
)
def _(spark, d):
    from pyspark.sql import Window

    groups = ["construct", "mesh_ord"]
    top = merge.newest(v.hierarchy(spark, d), 10, groups)
    window = Window.partitionBy(*groups).orderBy(*merge.newest_first())
    ranked = top.withColumn("rank", F.row_number().over(window).cast("long"))
    return strings(ranked, "construct", "mesh_ord", "entry_ord", "rank")


SLUGS = """, named AS (SELECT DISTINCT construct, mesh_ord,
    CASE mesh_ord % 4 WHEN 0 THEN 'Top News: ' || construct || '!' WHEN 1 THEN '***' ELSE mesh_name END AS mesh_name
    FROM mesh),
  stems AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(lower(mesh_name), '[^a-z0-9]+', '-', 'g'),
    '^-+|-+$', '', 'g'), ''), 'mesh-' || (mesh_ord + 1)) AS stem FROM named),
  slugs AS (SELECT construct, mesh_ord, mesh_name, stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug
    FROM (SELECT *, row_number() OVER (PARTITION BY construct, stem ORDER BY mesh_ord) AS k FROM stems))
"""


def _named_meshes(spark, d):
    key = F.col("mesh_ord")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("Top News: "), "construct", F.lit("!")))
        .when(key % 4 == 1, F.lit("***"))
        .otherwise(F.col("mesh_name"))
    )
    counted = v.meshes(spark, d).groupBy("construct", "mesh_ord", "mesh_name").agg(F.count("*").alias("source_count"))
    return counted.withColumn("mesh_name", name)


@R.query("mesh_slugs", M + SLUGS + "SELECT construct, mesh_ord, mesh_name, slug FROM slugs")
def _(spark, d):
    df = overview.mesh_slugs(_named_meshes(spark, d), "construct")
    return strings(df, "construct", "mesh_ord", "mesh_name", "slug")


@R.query(
    "mesh_overview",
    "WITH "
    + v.HIERARCHY
    + ","
    + v.MESHES
    + SLUGS
    + f""", merged AS (SELECT * FROM hier QUALIFY row_number() OVER (
        PARTITION BY construct, mesh_ord, link ORDER BY part_ord, entry_ord) = 1),
    totals AS (SELECT construct, mesh_ord, count(*) AS entry_count,
      strftime(max(published), '%Y-%m-%d') AS updated_day FROM merged GROUP BY ALL),
    top AS (SELECT construct, mesh_ord, string_agg(title, ' | ' ORDER BY k) AS preview FROM (
      SELECT *, row_number() OVER (PARTITION BY construct, mesh_ord
        ORDER BY published DESC, part_ord, entry_ord) AS k FROM merged) WHERE k <= 3 GROUP BY ALL),
    counts AS (SELECT construct, mesh_ord, count(*) AS source_count FROM mesh GROUP BY ALL)
    SELECT s.construct, s.mesh_ord, s.mesh_name, s.slug, t.updated_day, t.entry_count, c.source_count, p.preview
    FROM slugs s JOIN totals t USING (construct, mesh_ord) JOIN top p USING (construct, mesh_ord)
      JOIN counts c USING (construct, mesh_ord)""",
)
def _(spark, d):
    grouped = merge.grouped_construct(v.hierarchy(spark, d))
    df = overview.mesh_overview(grouped, _named_meshes(spark, d))
    df = df.withColumn("preview", F.array_join("preview", " | "))
    return strings(df, "construct", "mesh_ord", "mesh_name", "slug", "updated_day", "entry_count", "source_count", "preview")


@R.query(
    "construct_totals",
    H
    + """, merged AS (SELECT * FROM hier QUALIFY row_number() OVER (
        PARTITION BY construct, mesh_ord, link ORDER BY part_ord, entry_ord) = 1)
    SELECT construct, count(DISTINCT mesh_ord) AS mesh_count, count(*) AS entry_count,
      strftime(max(published), '%Y-%m-%d') AS updated_day FROM merged GROUP BY construct""",
)
def _(spark, d):
    grouped = merge.grouped_construct(v.hierarchy(spark, d))
    meshes = v.meshes(spark, d).groupBy("construct", "mesh_ord", "mesh_name").agg(F.count("*").alias("source_count"))
    return overview.construct_totals(overview.mesh_overview(grouped, meshes))


@R.query(
    "source_health",
    M
    + """SELECT construct, mesh_name, count(*) FILTER (NOT bad) AS ok_sources, count(*) FILTER (bad) AS failed_sources,
      CASE WHEN count(*) FILTER (NOT bad) > 0 THEN 1 ELSE 0 END AS mesh_ok
      FROM (SELECT *, source_ord % 13 = 0 OR mesh_ord = 7 AS bad FROM mesh) GROUP BY construct, mesh_name""",
)
def _(spark, d):
    bad = (F.col("source_ord") % 13 == 0) | (F.col("mesh_ord") == 7)
    sources = v.meshes(spark, d).withColumn("error", F.when(bad, F.lit("timeout")))
    health = defs.source_health(sources, ["construct", "mesh_name"])
    return health.withColumn("mesh_ok", F.col("mesh_ok").cast("long"))


FAILED_REGION = "AFRICA"
HEALTH = f"""SELECT construct, count(*) FILTER (ok) AS ok_meshes, CASE WHEN bool_or(ok) THEN 1 ELSE 0 END AS construct_ok
  FROM (SELECT construct, mesh_name, bool_or(NOT (source_ord % 13 = 0 OR mesh_ord % 7 = 0 OR construct = '{FAILED_REGION}')) AS ok
    FROM mesh GROUP BY construct, mesh_name) GROUP BY construct"""


@R.query("construct_health", M + HEALTH)
def _(spark, d):
    bad = (F.col("source_ord") % 13 == 0) | (F.col("mesh_ord") % 7 == 0) | (F.col("construct") == FAILED_REGION)
    sources = v.meshes(spark, d).withColumn("error", F.when(bad, F.lit("timeout")))
    health = defs.construct_health(defs.source_health(sources, ["construct", "mesh_name"]))
    return health.select("construct", "ok_meshes", F.col("construct_ok").cast("long").alias("construct_ok"))


@R.query(
    "mesh_fanout",
    """SELECT 'mesh ' || (page_id % 10) AS mesh_name, page_id // 10 AS source_ord, md5(html) AS etag,
      CASE WHEN page_id % 9 = 0 THEN 'no document' ELSE 'ok' END AS status
      FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE html END AS html FROM pages)""",
)
def _(spark, d):
    docs = v.raw_documents(spark, d).withColumn("error", F.lit(None).cast("string"))
    sources = docs.select(
        F.concat(F.lit("mesh "), (F.col("page_id") % 10).cast("string")).alias("mesh_name"),
        F.floor(F.col("page_id") / 10).alias("source_ord"),
        F.col("requested_url").alias("source_url"),
    )
    fetched = docs.filter(F.col("page_id") % 9 != 0).select("requested_url", "final_url", "etag", "error")
    out = defs.fan_out(sources, fetched)
    return out.select("mesh_name", "source_ord", "etag", F.coalesce("error", F.lit("ok")).alias("status"))


# ---- definition tables; a definition covers a block of customers, so its size is bounded ----

BLOCK = 100
BLOCKS = f"""
block AS (SELECT r_name AS construct, n_name || '-' || (c_custkey // {BLOCK}) AS name,
    min(c_custkey) AS first_key, count(*) AS n, string_agg(c_name, ',' ORDER BY c_custkey) AS names
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
"""


def _blocks(spark, d):
    source = F.struct(F.col("source_name").alias("name"), F.col("source_url").alias("url"))
    ordered = F.array_sort(F.collect_list(F.struct("source_ord", source.alias("source"))))
    block = F.floor(F.col("source_ord") / BLOCK).cast("string")
    return (
        v.meshes(spark, d)
        .groupBy("construct", F.concat("mesh_name", F.lit("-"), block).alias("name"))
        .agg(F.min("source_ord").alias("first_key"), ordered.alias("_sources"))
        .select(
            "construct",
            "name",
            "first_key",
            F.struct("name", F.transform("_sources", lambda s: s["source"]).alias("sources")).alias("mesh"),
        )
    )


@R.query("defs_scan", "WITH " + BLOCKS + "SELECT name, n, names FROM block")
def _(spark, d):
    path = f"{shared_dir(spark)}/definitions-{uuid.uuid4().hex}"
    _blocks(spark, d).select(F.to_json("mesh")).write.text(path)
    df = files.read_meshes(spark, [path], lines=True)
    names = F.array_join(F.transform("mesh.sources", lambda s: s["name"]), ",")
    return df.select("name", F.size("mesh.sources").cast("long").alias("n"), names.alias("names"))


# Constructs over ten blocks of each nation; members are names, references and inline meshes.
@R.query(
    "construct_scan",
    "WITH "
    + BLOCKS
    + f""", placed AS (SELECT construct || '-' || (first_key // {10 * BLOCK}) AS construct, name, n, first_key % 3 AS kind FROM block)
    SELECT construct, row_number() OVER (PARTITION BY construct ORDER BY name) - 1 AS mesh_ord,
      CASE WHEN kind < 2 THEN name END AS ref, CASE WHEN kind = 2 THEN name END AS inline_name,
      CASE WHEN kind = 2 THEN n END AS n FROM placed""",
)
def _(spark, d):
    kind = F.col("first_key") % 3
    member = (
        F.when(kind == 0, F.concat(F.lit('"'), "name", F.lit('"')))
        .when(kind == 1, F.to_json(F.struct(F.col("name").alias("ref"))))
        .otherwise(F.to_json("mesh"))
    )
    group = F.concat("construct", F.lit("-"), F.floor(F.col("first_key") / (10 * BLOCK)).cast("string"))
    members = F.array_sort(F.collect_list(F.struct("name", member.alias("member"))))
    lists = _blocks(spark, d).groupBy(group.alias("name")).agg(F.transform(members, lambda m: m["member"]).alias("members"))
    text = F.concat(F.lit('{"name":"'), "name", F.lit('","meshes":['), F.array_join("members", ","), F.lit("]}"))
    path = f"{shared_dir(spark)}/constructs-{uuid.uuid4().hex}"
    lists.select(text).write.text(path)
    df = files.read_constructs(spark, path, lines=True)
    count = F.when(F.col("mesh").isNotNull(), F.size("mesh.sources").cast("long"))
    return df.select(
        "construct", F.col("mesh_ord").cast("long").alias("mesh_ord"), "ref", F.col("mesh.name").alias("inline_name"), count.alias("n")
    )


@R.query(
    "construct_resolve",
    "WITH "
    + BLOCKS
    + """SELECT construct, first_key AS mesh_ord,
      CASE WHEN first_key % 3 = 2 THEN 'references unknown mesh "gone-' || name || '"' ELSE name END AS result,
      CASE WHEN first_key % 3 = 2 THEN 0 ELSE n END AS n FROM block""",
)
def _(spark, d):
    blocks = _blocks(spark, d)
    key = F.col("first_key")
    members = blocks.select(
        "construct",
        key.alias("mesh_ord"),
        F.when(key % 3 == 1, F.col("name"))
        .when(key % 3 == 2, F.concat(F.lit("gone-"), "name"))
        .alias("ref"),
        F.when(key % 3 == 0, F.col("mesh")).alias("mesh"),
    )
    resolved, rejects = defs.resolve_members(members, blocks.select("name", "mesh"))
    good = resolved.select(
        "construct", "mesh_ord", F.col("mesh.name").alias("result"), F.size("mesh.sources").cast("long").alias("n")
    )
    bad = rejects.select(F.col("key").alias("construct"), "mesh_ord", F.col("reason").alias("result"), F.lit(0).cast("long").alias("n"))
    return good.unionByName(bad)


@R.query(
    "defs_shadow",
    """SELECT name, min(location_rank) AS location_rank, arg_min(title, location_rank) AS title FROM (
      SELECT CASE WHEN c_custkey % 10 = 9 THEN '../' || c_mktsegment ELSE c_mktsegment || '-' || (c_custkey % 97) END AS name,
        c_custkey AS location_rank, c_name AS title FROM customer) WHERE NOT contains(name, '/') GROUP BY name""",
)
def _(spark, d):
    key = F.col("c_custkey")
    rows = v.table(spark, d, "customer").select(
        F.when(key % 10 == 9, F.concat(F.lit("../"), "c_mktsegment"))
        .otherwise(F.concat("c_mktsegment", F.lit("-"), (key % 97).cast("string")))
        .alias("name"),
        key.alias("location_rank"),
        F.col("c_name").alias("title"),
    )
    return defs.shadow(rows).select("name", "location_rank", "title")


@R.query("defs_list", "WITH " + v.MESHES + "SELECT DISTINCT mesh_name AS name FROM mesh UNION SELECT DISTINCT construct FROM mesh")
def _(spark, d):
    df = v.meshes(spark, d)
    names = df.select(F.col("mesh_name").alias("name")).union(df.select("construct"))
    return defs.list_names(names)


CATALOG = """
catalog AS (SELECT lower(mesh_name) AS theme, CASE WHEN mesh_ord = 3 THEN ' ' ELSE construct || ' ' || mesh_name END AS theme_title,
    source_ord, CASE WHEN source_ord = 40 THEN '' ELSE source_name END AS name,
    CASE WHEN source_ord % 50 = 1 THEN 'ftp://x/' || source_ord WHEN mesh_ord % 7 = 0 AND source_ord % 2 = 0 THEN 'https://same.example/'
      ELSE source_url END AS url FROM mesh)
"""


def _catalog(spark, d):
    order, mesh = F.col("source_ord"), F.col("mesh_ord")
    return v.meshes(spark, d).select(
        F.lower("mesh_name").alias("theme"),
        F.when(mesh == 3, F.lit(" ")).otherwise(F.concat("construct", F.lit(" "), "mesh_name")).alias("theme_title"),
        "source_ord",
        F.when(order == 40, F.lit("")).otherwise(F.col("source_name")).alias("name"),
        F.when(order % 50 == 1, F.concat(F.lit("ftp://x/"), order.cast("string")))
        .when((mesh % 7 == 0) & (order % 2 == 0), F.lit("https://same.example/"))
        .otherwise(F.col("source_url"))
        .alias("url"),
    )


@R.query(
    "theme_mesh",
    M + "," + CATALOG + """SELECT theme_title AS mesh_name, source_ord, name AS source_name, url AS source_url
      FROM catalog WHERE theme IN ('nation_2', 'nation_11')""",
)
def _(spark, d):
    return defs.select_themes(_catalog(spark, d), "nation_2, nation_11,nope")


# Each customer asks for a theme: that of its nation, or of its market segment, which no catalog has.
@R.query(
    "theme_unknown",
    M
    + "," + CATALOG
    + """, wanted AS (SELECT c_custkey, lower(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE n_name END) AS theme
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, theme FROM wanted WHERE theme NOT IN (SELECT theme FROM catalog)""",
)
def _(spark, d):
    customer, nation = v.table(spark, d, "customer"), v.table(spark, d, "nation")
    theme = F.lower(F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.col("n_name")))
    wanted = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", theme.alias("theme"))
    return defs.unknown_themes(_catalog(spark, d), wanted).select("c_custkey", "theme")


@R.query(
    "catalog_checks",
    M + "," + CATALOG + """, dup AS (SELECT theme FROM catalog GROUP BY theme, url HAVING count(*) > 1)
    SELECT theme, 'too few sources' AS rule FROM catalog GROUP BY theme HAVING count(*) < 62
    UNION ALL SELECT DISTINCT theme, 'empty source name' FROM catalog WHERE trim(name) = ''
    UNION ALL SELECT DISTINCT theme, 'url is not http' FROM catalog WHERE NOT starts_with(url, 'http')
    UNION ALL SELECT DISTINCT theme, 'empty title' FROM catalog WHERE trim(theme_title) = ''
    UNION ALL SELECT DISTINCT theme, 'duplicate url' FROM dup""",
)
def _(spark, d):
    return defs.catalog_checks(_catalog(spark, d), min_sources=62)


@R.query(
    "defs_validate",
    """SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'item is required' ELSE 'title is required' END AS reason
      FROM pages WHERE page_id % 4 IN (1, 2)""",
)
def _(spark, d):
    key = F.col("page_id")
    templates = v.table(spark, d, "pages").select(
        "page_id",
        F.col("url").alias("host"),
        F.when(key % 4 != 1, F.lit("nav li")).alias("item"),
        F.when(key % 4 != 2, F.lit("a")).alias("title"),
    )
    return defs.invalid_templates(templates).select("page_id", "reason")


@R.query(
    "template_join",
    """, """.join(
        [
            """WITH host AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""",
            """t AS (SELECT host, arg_max('li.v' || page_id, page_id) AS item FROM host WHERE page_id % 3 <> 0 GROUP BY host)""",
        ]
    )
    + " SELECT page_id, host.host, coalesce(item, '-') AS item FROM host LEFT JOIN t ON host.host = t.host",
)
def _(spark, d):
    from feedspark.functions.urls import url_host

    pages = v.raw_documents(spark, d).select("page_id", "final_url")
    templates = pages.filter(F.col("page_id") % 3 != 0).select(
        url_host(F.col("final_url")).alias("host"),
        F.concat(F.lit("li.v"), F.col("page_id").cast("string")).alias("item"),
        F.lit("a").alias("title"),
        F.col("page_id").alias("load_ord"),
    )
    joined = defs.join_templates(pages, templates)
    return joined.select("page_id", "host", F.coalesce("template.item", F.lit("-")).alias("item"))


@R.query(
    "record_validate",
    "WITH "
    + v.ENTRIES
    + """SELECT entry_ord AS key, CASE entry_ord % 6 WHEN 1 THEN 'not JSON' WHEN 2 THEN 'title is required'
      WHEN 3 THEN 'entries must be a list' WHEN 4 THEN 'entries.link is required' ELSE 'updated is required' END AS reason
      FROM entries WHERE entry_ord % 6 <> 0""",
)
def _(spark, d):
    kind = F.col("entry_ord") % 6
    item = F.when(kind == 4, F.to_json(F.struct("id", "title"))).otherwise(F.to_json(F.struct("id", "title", "link")))
    record = F.concat(
        F.lit('{"id":"x"'),
        F.when(kind == 2, F.lit(',"title":3')).otherwise(F.lit(',"title":"t"')),
        F.when(kind == 5, F.lit("")).otherwise(F.lit(',"updated":"2024-01-01"')),
        F.when(kind == 3, F.lit(',"entries":{}')).otherwise(F.concat(F.lit(',"entries":['), item, F.lit("]"))),
        F.when(kind == 1, F.lit("")).otherwise(F.lit("}")),
    )
    records = v.entries(spark, d).select("entry_ord", record.alias("json"))
    return validate.validate_records(records, "json", "feed", "entry_ord").select("key", "reason")
