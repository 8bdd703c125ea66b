"""Filters, windows, sorts, merges and diffs over the entry view."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedspark.functions import dates, ids, text
from feedspark.operators import diff, filters, merge, overview, refine, search
from feedspark.plans import views as v
from feedspark.plans.registry import Registry

R = Registry()
E1 = "WITH " + v.ENTRIES
LOW = "lower(title)"
NAMES = "array_to_string(authors, ' ')"
MERGE_TIME = "coalesce(updated, published, TIMESTAMP '1970-01-01')"
REFINE_TIME = "coalesce(published, updated)"


def brief(df, *extra):
    return df.select("entry_ord", "id", "title", "link", *extra)


BRIEF = "entry_ord, id, title, link"


# ---- filters ----

SUB = filters.parse_spec(["title:er"])


@R.query("filter_substring", E1 + f"SELECT {BRIEF} FROM entries WHERE contains(lower(title), 'er')")
def _(spark, d):
    return brief(filters.filter_entries(v.entries(spark, d), SUB))


@R.query(
    "filter_regex",
    E1
    + f"""SELECT {BRIEF} FROM entries
      WHERE regexp_matches(coalesce(summary, ''), '^[a-d]\\w+ ', 'i')
        OR regexp_matches({NAMES}, '^user \\d{{2}}\\b', 'i')""",
)
def _(spark, d):
    spec = filters.parse_spec([r"summary:/^[a-d]\w+ /", r"author:/^user \d{2}\b/"])
    return brief(filters.filter_entries(v.entries(spark, d), spec))


RULES = filters.parse_spec(
    ["tag:EN", "author:editor", "source:src1", "title:/^the/"], ["tag:error", "summary:onst"]
)
RULES_SQL = f"""
  (list_bool_or(list_transform(tags, lambda t: contains(lower(t), 'en')))
   OR contains(lower({NAMES}), 'editor') OR contains(lower(source_name), 'src1')
   OR regexp_matches(title, '^the', 'i'))
  AND NOT (coalesce(list_bool_or(list_transform(tags, lambda t: contains(lower(t), 'error'))), false)
   OR contains(lower(coalesce(summary, '')), 'onst'))"""


@R.query("filter_rules", E1 + f"SELECT {BRIEF} FROM entries WHERE {RULES_SQL}")
def _(spark, d):
    return brief(filters.filter_entries(v.entries(spark, d), RULES))


@R.query(
    "filter_rules_table",
    E1
    + """, rules AS (
      SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'exclude' ELSE 'include' END AS kind,
        CASE n_nationkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'source' ELSE 'author' END AS field,
        CASE n_nationkey % 3 WHEN 0 THEN chr(97 + n_nationkey) || 'n'
          WHEN 1 THEN 'src' || (n_nationkey % 20) ELSE 'user ' || n_nationkey || '0' END AS pattern
      FROM nation),
    texts AS (
      SELECT entry_ord, 'title' AS field, lower(title) AS value FROM entries UNION ALL
      SELECT entry_ord, 'source', lower(source_name) FROM entries UNION ALL
      SELECT entry_ord, 'author', lower(array_to_string(authors, ' ')) FROM entries),
    hits AS (
      SELECT entry_ord, bool_or(kind = 'include') AS wanted, bool_or(kind = 'exclude') AS unwanted
      FROM texts JOIN rules ON texts.field = rules.field AND contains(value, lower(pattern))
      GROUP BY entry_ord)
    SELECT entry_ord, id, title, link FROM entries JOIN hits USING (entry_ord)
    WHERE wanted AND NOT unwanted""",
)
def _(spark, d):
    key = F.col("n_nationkey")
    rules = v.table(spark, d, "nation").select(
        F.when(key % 5 == 4, "exclude").otherwise("include").alias("kind"),
        F.when(key % 3 == 0, "title").when(key % 3 == 1, "source").otherwise("author").alias("field"),
        F.when(key % 3 == 0, F.concat(F.chr(key + 97), F.lit("n")))
        .when(key % 3 == 1, F.concat(F.lit("src"), (key % 20).cast("string")))
        .otherwise(F.concat(F.lit("user "), key.cast("string"), F.lit("0")))
        .alias("pattern"),
        F.lit(False).alias("regex"),
    )
    return brief(filters.filter_by_rules_table(v.entries(spark, d), rules))


@R.query(
    "filter_rules_many",
    E1
    + """, rules AS (SELECT DISTINCT CASE WHEN entry_ord % 7 = 3 THEN 'exclude' ELSE 'include' END AS kind,
        CASE entry_ord % 3 WHEN 0 THEN 'summary' ELSE 'title' END AS field, entry_ord % 5 = 0 AS regex,
        CASE WHEN entry_ord % 5 = 0 THEN '\\b' || substr(word, 1, 4) || '[a-z]*' || substr(word, 6) || ' ' ELSE upper(word) END AS pattern
      FROM (SELECT entry_ord, regexp_extract(title, '[A-Za-z]{6,}[ a-z]+', 0) AS word FROM entries) WHERE length(word) >= 6),
    texts AS (SELECT entry_ord, 'title' AS field, title AS value FROM entries UNION ALL
      SELECT entry_ord, 'summary', coalesce(summary, '') FROM entries),
    hits AS (SELECT entry_ord, bool_or(kind = 'include') AS wanted, bool_or(kind = 'exclude') AS unwanted
      FROM texts JOIN rules ON texts.field = rules.field AND CASE WHEN regex THEN regexp_matches(value, pattern, 'i') ELSE contains(lower(value), lower(pattern)) END
      GROUP BY entry_ord)
    SELECT entry_ord, id, title, link FROM entries JOIN hits USING (entry_ord) WHERE wanted AND NOT unwanted""",
)
def _(spark, d):
    entries = v.entries(spark, d)
    key = F.col("entry_ord")
    words = entries.select(key, F.regexp_extract("title", "[A-Za-z]{6,}[ a-z]+", 0).alias("word")).filter(F.length("word") >= 6)
    regex = key % 5 == 0
    expression = F.concat(F.lit("\\b"), F.substring("word", 1, 4), F.lit("[a-z]*"), F.expr("substring(word, 6)"), F.lit(" "))
    rules = words.select(
        F.when(key % 7 == 3, "exclude").otherwise("include").alias("kind"),
        F.when(key % 3 == 0, "summary").otherwise("title").alias("field"),
        F.when(regex, expression).otherwise(F.upper("word")).alias("pattern"),
        regex.alias("regex"),
    )
    return brief(filters.filter_by_rules_table(entries, rules))


@R.query(
    "filter_tally",
    E1 + f"SELECT feed_id, count(*) FILTER ({RULES_SQL}) AS kept, count(*) AS given FROM entries GROUP BY feed_id",
)
def _(spark, d):
    return filters.filter_tally(v.entries(spark, d), RULES, ["feed_id"])


@R.query(
    "search_entries",
    E1
    + f"""SELECT {BRIEF} FROM entries WHERE contains(lower(array_to_string(
        list_concat([title, coalesce(summary, ''), source_name], tags, authors), ' ')), 'click user')""",
)
def _(spark, d):
    hay = text.haystack(
        F.col("title"),
        F.col("summary"),
        F.col("source.name"),
        F.col("tags"),
        F.transform("authors", lambda a: a["name"]),
    )
    return brief(filters.search_entries(v.entries(spark, d), " Click User", hay))


HAY_SQL = "lower(array_to_string(list_concat([title, coalesce(summary, ''), source_name], tags, authors), ' '))"


@R.query(
    "search_many",
    E1
    + f""", queries AS (SELECT DISTINCT '  ' || upper(event_type) || ' user ' || (user_id // 4) AS query FROM events
        UNION ALL SELECT DISTINCT 'r' || substr(n_name, 1, 1) FROM nation)
    SELECT query, count(*) AS n, min(entry_ord) AS first_entry, max(entry_ord) AS last_entry
    FROM queries JOIN entries ON contains({HAY_SQL}, lower(trim(query))) GROUP BY query""",
)
def _(spark, d):
    hay = text.haystack(
        F.col("title"), F.col("summary"), F.col("source.name"), F.col("tags"), F.transform("authors", lambda a: a["name"])
    )
    haystacks = v.entries(spark, d).select(F.col("entry_ord").alias("row"), hay.alias("text"))
    events, nation = v.table(spark, d, "events"), v.table(spark, d, "nation")
    user = F.floor(F.col("user_id") / 4).cast("string")
    queries = events.select(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" user "), user).alias("query")).unionByName(
        nation.select(F.concat(F.lit("r"), F.substring("n_name", 1, 1)).alias("query"))
    )
    found = search.search(haystacks, queries)
    return found.groupBy("query").agg(
        F.count("*").alias("n"), F.min("row").alias("first_entry"), F.max("row").alias("last_entry")
    )


# ---- windows and sorts ----

WEEK = refine.resolve_window(datetime(2024, 1, 18, 9, tzinfo=timezone.utc), this_week=True)


@R.query(
    "select_window",
    E1
    + f"""SELECT {BRIEF}, epoch_ms({REFINE_TIME}) AS time_ms FROM entries
      WHERE {REFINE_TIME} >= TIMESTAMP '2024-01-01 00:00:00' AND {REFINE_TIME} <= TIMESTAMP '2024-01-01 00:20:00'""",
)
def _(spark, d):
    window = refine.resolve_window(v.NOW, between=("2024-01-01", "2024-01-01T00:20:00Z"))
    df = refine.in_window(v.entries(spark, d), window)
    return brief(df, F.unix_millis(refine.entry_time()).alias("time_ms"))


@R.query(
    "cutoff_filter",
    "WITH "
    + v.HIERARCHY
    + """SELECT construct, entry_ord, link FROM hier
      WHERE published >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY""",
)
def _(spark, d):
    cutoff = refine.resolve_cutoff(datetime(1998, 6, 1, tzinfo=timezone.utc), since="90d")
    return refine.after_cutoff(v.hierarchy(spark, d), cutoff).select("construct", "entry_ord", "link")


def _ranked_top(df, order, n):
    from pyspark.sql import Window

    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def _rank_sql(order, n=None, where=""):
    tail = f" QUALIFY rank <= {n}" if n else ""
    return f"""SELECT {BRIEF}, row_number() OVER (ORDER BY {order}) AS rank
      FROM entries {where}{tail}"""


@R.query("sort_date", E1 + _rank_sql(f"{REFINE_TIME} ASC NULLS FIRST, part_ord, entry_ord"))
def _(spark, d):
    df = v.entries(spark, d)
    return brief(overview.ranked_list(df, refine.sort_keys("date", "asc")), "rank")


@R.query("sort_title", E1 + _rank_sql("icu_sort_key(title, 'und'), part_ord, entry_ord"))
def _(spark, d):
    df = v.entries(spark, d)
    return brief(overview.ranked_list(df, refine.sort_keys("title")), "rank")


@R.query(
    "sort_source",
    E1 + _rank_sql(f"source_name DESC, {REFINE_TIME} DESC NULLS LAST, part_ord, entry_ord"),
)
def _(spark, d):
    df = v.entries(spark, d)
    return brief(overview.ranked_list(df, refine.sort_keys("source", "desc")), "rank")


@R.query("topk_date", E1 + _rank_sql(f"{REFINE_TIME} DESC NULLS LAST, part_ord, entry_ord", 100))
def _(spark, d):
    df = refine.select_entries(v.entries(spark, d), refine.Select(sort="date", limit=100))
    return brief(_ranked_top(df, refine.sort_keys("date"), 100), "rank")


@R.query("ranked_list", E1 + _rank_sql(f"{MERGE_TIME} DESC, part_ord, entry_ord"))
def _(spark, d):
    return brief(overview.ranked_list(v.entries(spark, d), merge.newest_first()), "rank")


@R.query(
    "refine_entries",
    E1
    + _rank_sql(
        f"{REFINE_TIME} DESC NULLS LAST, part_ord, entry_ord",
        200,
        f"WHERE {RULES_SQL} AND {REFINE_TIME} >= TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 40 DAY",
    ),
)
def _(spark, d):
    select = refine.build_select(v.NOW, sort="date", limit=200, max_age="40d")
    df = refine.refine(v.entries(spark, d), RULES, select)
    return brief(_ranked_top(df, refine.sort_keys("date"), 200), "rank")


# ---- merge ----

MERGED = f""", merged AS (
  SELECT * FROM entries
  QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(link, ''), id) ORDER BY part_ord, entry_ord) = 1)
"""


@R.query(
    "merge_feeds",
    E1
    + MERGED
    + f"SELECT {BRIEF}, source_name, epoch_ms({MERGE_TIME}) AS time_ms FROM merged",
)
def _(spark, d):
    df = merge.merge_feeds(v.entries(spark, d))
    time = dates.merge_time(F.col("published"), F.col("updated"))
    return brief(df, F.col("source.name").alias("source_name"), F.unix_millis(time).alias("time_ms"))


@R.query(
    "merge_feeds_topk",
    E1
    + MERGED
    + f"""SELECT {BRIEF}, row_number() OVER (ORDER BY {MERGE_TIME} DESC, part_ord, entry_ord) AS rank
      FROM merged QUALIFY rank <= 50""",
)
def _(spark, d):
    df = merge.merge_feeds(v.entries(spark, d), limit=50)
    return brief(_ranked_top(df, merge.newest_first(), 50), "rank")


@R.query("dedup_first", E1 + MERGED + "SELECT entry_ord, part_ord, id, link FROM merged")
def _(spark, d):
    df = merge.merge_entries(v.entries(spark, d))
    return df.select("entry_ord", F.col("part_ord").cast("long").alias("part_ord"), "id", "link")


@R.query(
    "union_parts",
    E1
    + """SELECT CASE WHEN part_ord % 3 = 0 THEN 0 WHEN part_ord % 3 = 1 THEN 1 ELSE 2 END AS part_ord,
      count(*) AS n, count(DISTINCT link) AS links, min(entry_ord) AS first_ord FROM entries GROUP BY 1""",
)
def _(spark, d):
    df = v.entries(spark, d)
    parts = merge.union_parts([df.filter(F.col("part_ord") % 3 == i) for i in range(3)])
    return parts.groupBy(F.col("part_ord").cast("long").alias("part_ord")).agg(
        F.count("*").alias("n"),
        F.count_distinct("link").alias("links"),
        F.min("entry_ord").alias("first_ord"),
    )


@R.query(
    "source_tag",
    E1
    + """SELECT entry_ord, CASE WHEN part_ord % 4 = 0 THEN 'Feed ' || feed_id ELSE 'Label ' || part_ord END AS name,
      CASE WHEN part_ord % 4 = 0 THEN NULL ELSE source_url END AS url FROM entries""",
)
def _(spark, d):
    own = F.col("part_ord") % 4 != 0
    label = merge.source_label(
        F.when(own, F.concat(F.lit("Label "), F.col("part_ord").cast("string"))),
        F.when(own, F.col("source.url")),
        F.concat(F.lit("Feed "), "feed_id"),
        F.lit(""),
    )
    df = v.entries(spark, d).withColumn("source", label)
    return df.select("entry_ord", "source.name", "source.url")


@R.query(
    "merge_header",
    "WITH "
    + v.HIERARCHY
    + f""", merged AS (
      SELECT *, coalesce(updated_, published, TIMESTAMP '1970-01-01') AS t FROM (
        SELECT *, NULL::TIMESTAMP AS updated_ FROM hier)
      QUALIFY row_number() OVER (PARTITION BY construct, mesh_ord, link ORDER BY part_ord, entry_ord) = 1),
    kept AS (
      SELECT * FROM merged
      QUALIFY row_number() OVER (PARTITION BY construct, mesh_ord ORDER BY t DESC, part_ord, entry_ord) <= 20)
    SELECT construct, 'urn:feed:mesh:' || url_encode('Mesh (' || mesh_name || ') *') AS feed_id_encoded,
      mesh_name, count(*) AS entry_count,
      epoch_ms(coalesce(max(t) FILTER (t > TIMESTAMP '1970-01-01'), {v.NOW_SQL})) AS updated_ms
    FROM kept GROUP BY construct, mesh_ord, mesh_name""".replace(
        "url_encode('Mesh (' || mesh_name || ') *')",
        "replace(replace(replace(url_encode('Mesh (' || mesh_name || ') *'), '%28', '('), '%29', ')'), '%2A', '*')",
    ),
)
def _(spark, d):
    grouped = merge.grouped_construct(v.hierarchy(spark, d), 20)
    title = F.concat(F.lit("Mesh ("), F.col("mesh_name"), F.lit(") *"))
    head = merge.merged_header(grouped, title, v.NOW, ["construct", "mesh_ord", "mesh_name"])
    return head.select(
        "construct",
        F.col("feed_id").alias("feed_id_encoded"),
        "mesh_name",
        "entry_count",
        F.unix_millis("updated").alias("updated_ms"),
    )


@R.query(
    "newest_entry",
    E1 + "SELECT feed_id, epoch_ms(max(coalesce(updated, published))) AS newest_ms FROM entries GROUP BY feed_id",
)
def _(spark, d):
    df = merge.newest_entry(v.entries(spark, d), ["feed_id"])
    return df.select("feed_id", F.unix_millis("newest").alias("newest_ms"))


@R.query(
    "finalize_feed",
    E1
    + f""", f AS (SELECT 'http://hub.example/' || feed_id || '/feed.xml' AS source_url, feed_id, part_ord,
        max(coalesce(updated, published)) FILTER (part_ord % 5 <> 0) AS newest FROM entries GROUP BY ALL)
    SELECT source_url,
      CASE WHEN part_ord % 2 = 0 THEN source_url ELSE 'id ' || feed_id END AS feed_id,
      CASE WHEN part_ord % 3 = 0 THEN 'Untitled' ELSE feed_id END AS title,
      'http://hub.example/' || feed_id || '/home' AS home,
      epoch_ms(coalesce(CASE WHEN part_ord % 4 = 0 THEN TIMESTAMP '2023-05-06 07:08:09' END, newest, {v.NOW_SQL})) AS updated_ms
    FROM f""",
)
def _(spark, d):
    df = v.entries(spark, d).withColumn(
        "source_url", F.concat(F.lit("http://hub.example/"), "feed_id", F.lit("/feed.xml"))
    )
    part = F.col("part_ord")
    feeds = df.groupBy("source_url", F.col("feed_id").alias("name"), "part_ord").agg(F.count("*")).select(
        "source_url",
        F.when(part % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" id "), "name")).alias("feed_id"),
        F.when(part % 3 == 0, F.lit(" ")).otherwise(F.col("name")).alias("title"),
        F.lit("home").alias("home"),
        F.lit("").alias("self"),
        dates.norm_date(
            F.when(part % 4 == 0, F.lit("Sat, 06 May 2023 07:08:09 GMT")).otherwise(F.lit("no date"))
        ).alias("updated"),
        F.array().cast("array<struct<name:string,url:string,email:string>>").alias("authors"),
    )
    dated = df.filter(part % 5 != 0)
    out = merge.finalize_feeds(feeds, dated, v.NOW)
    return out.select("source_url", "feed_id", "title", "home", F.unix_millis("updated").alias("updated_ms"))


# ---- diff, lists ----


@R.query("entry_key", E1 + "SELECT entry_ord, coalesce(nullif(id, ''), link) AS key FROM entries")
def _(spark, d):
    return diff.with_key(v.entries(spark, d)).select("entry_ord", "key")


@R.query(
    "new_entries",
    E1
    + f""", seen AS (SELECT DISTINCT coalesce(nullif(id, ''), link) AS key FROM entries WHERE published < TIMESTAMP '2024-01-01 00:15:00')
    SELECT {BRIEF} FROM entries WHERE coalesce(nullif(id, ''), link) NOT IN (SELECT key FROM seen)""",
)
def _(spark, d):
    df = v.entries(spark, d)
    seen = diff.with_key(df.filter(F.col("published") < F.lit(datetime(2024, 1, 1, 0, 15, tzinfo=timezone.utc))))
    return brief(diff.new_entries(df, seen.select("key").distinct()))


@R.query("tag_counts", E1 + "SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM entries) GROUP BY tag")
def _(spark, d):
    return overview.tag_counts(v.entries(spark, d))


@R.query(
    "explode_entries",
    E1
    + ", "
    + v.PAGED
    + """SELECT feed_id, row_number() OVER (PARTITION BY feed_id ORDER BY entry_ord) - 1 AS entry_ord, title, link FROM paged""",
)
def _(spark, d):
    cols = ["id", "title", "link", "published", "updated", "summary", "authors", "tags", "source"]
    nested = (
        v.paged(v.entries(spark, d))
        .groupBy("feed_id")
        .agg(F.array_sort(F.collect_list(F.struct("entry_ord", *cols))).alias("entries"))
    )
    return merge.explode_entries(nested, ["feed_id"]).select("feed_id", "entry_ord", "title", "link")


@R.query(
    "source_palette",
    E1
    + """SELECT source_name, (row_number() OVER (ORDER BY min(part_ord), min(entry_ord)) - 1) % 6 AS slot
      FROM entries GROUP BY source_name""",
)
def _(spark, d):
    return overview.source_palette(v.entries(spark, d), F.col("source.name"))


# Refinements that users saved, one per document: words of its text, its language and its length as arguments.
@R.query(
    "select_checks",
    """WITH saved AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'date' ELSE lang END AS sort,
        CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) || '.0' WHEN doc_id % 5 = 0 THEN '-' || n_chars
          ELSE CAST(n_chars / 2 AS VARCHAR) END AS limit_text,
        n_chars || CASE doc_id % 4 WHEN 0 THEN 'h' WHEN 1 THEN ' d' WHEN 2 THEN 'w' ELSE '' END AS since,
        CASE WHEN doc_id % 7 < 5 THEN '2024-01-0' || (doc_id % 7) || '..2024-02-' || (20 + doc_id % 13) ELSE source END AS between_text
      FROM documents)
    SELECT doc_id, 'sort' AS option, sort AS given, 'one of date, title, source' AS expected FROM saved
      WHERE sort NOT IN ('date', 'title', 'source')
    UNION ALL SELECT doc_id, 'limit', limit_text, 'a whole number from 0' FROM saved
      WHERE limit_text LIKE '-%' OR CAST(limit_text AS DOUBLE) <> floor(CAST(limit_text AS DOUBLE))
    UNION ALL SELECT doc_id, 'since', since, 'a duration, a number and a unit' FROM saved
      WHERE NOT regexp_matches(since, '^[0-9]+ *[mhd]$')
    UNION ALL SELECT doc_id, 'between', between_text, 'two dates joined by two dots' FROM saved
      WHERE doc_id % 7 >= 5 OR try_cast(split_part(between_text, '..', 1) AS DATE) IS NULL
        OR try_cast(split_part(between_text, '..', 2) AS DATE) IS NULL""",
)
def _(spark, d):
    doc, size = F.col("doc_id"), F.col("n_chars").cast("string")
    unit = F.when(doc % 4 == 0, "h").when(doc % 4 == 1, " d").when(doc % 4 == 2, "w").otherwise("")
    number = lambda c: c.cast("string")
    saved = v.table(spark, d, "documents").select(
        "doc_id",
        F.when(doc % 3 == 0, F.lit("date")).otherwise(F.col("lang")).alias("sort"),
        F.when(doc % 2 == 0, F.concat(size, F.lit(".0")))
        .when(doc % 5 == 0, F.concat(F.lit("-"), size))
        .otherwise(number(F.col("n_chars") / 2))
        .alias("limit"),
        F.concat(size, unit).alias("since"),
        F.when(
            doc % 7 < 5,
            F.concat(F.lit("2024-01-0"), number(doc % 7), F.lit("..2024-02-"), number(20 + doc % 13)),
        )
        .otherwise(F.col("source"))
        .alias("between"),
    )
    return refine.wrong_options(saved, ["doc_id"])
