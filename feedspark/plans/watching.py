"""The event table as a stream of entries, watched tick by tick."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedspark.functions.dates import millis
from feedspark.operators import filters, refine
from feedspark.plans import views as v
from feedspark.plans.registry import Registry
from feedspark.session import shared_dir
from feedspark.sinks.assemble import whole
from feedspark.streaming.watch import Watch, bounded_watch, expiring_watch

R = Registry()
TICKS = 4
STREAM = f"""stream AS (SELECT event_id, user_id || '|' || event_type AS key, event_type, ts,
    event_id * {TICKS} // (SELECT max(event_id) + 1 FROM events) AS tick FROM events)
"""


def _entries(spark, d):
    events = v.table(spark, d, "events")
    key = F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type")
    absent = lambda t: F.lit(None).cast(t)
    return events.select(
        key.alias("id"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("https://e.example/"), F.col("event_id").cast("string")).alias("link"),
        millis(F.col("ts").cast("timestamp")).alias("published"),
        absent("timestamp").alias("updated"),
        absent("string").alias("summary"),
        absent("array<struct<name:string,url:string,email:string>>").alias("authors"),
        F.array("event_type").alias("tags"),
        absent("struct<name:string,url:string>").alias("source"),
        F.lit(0).alias("part_ord"),
        F.col("event_id").alias("entry_ord"),
    )


def _ticks(spark, d):
    rows = _entries(spark, d)
    end = rows.agg(F.max("entry_ord") + 1).scalar()
    return rows.withColumn("tick", F.floor(F.col("entry_ord") * TICKS / end))


def _watch(spark, d, repeat=False, **options):
    """Feed the quarters of the table one after the other; ``repeat`` sends the first again."""
    folder = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    watch = Watch(folder, **options)
    rows = _ticks(spark, d)
    quarters = [*range(TICKS), *([0] if repeat else [])]
    for quarter in quarters:
        part = rows.filter(F.col("tick") == quarter).drop("tick")
        part.write.mode("append").parquet(watch.path("source"))
        # Every run resumes from the checkpoint of the one before.
        stream = spark.readStream.schema(part.schema).parquet(watch.path("source"))
        watch.start(stream, once=True).awaitTermination()
    return watch


FIRST = """first AS (SELECT key, min(tick) AS tick FROM stream {} GROUP BY key)"""


@R.query(
    "watch_ticks",
    "WITH "
    + STREAM
    + ","
    + FIRST.format("")
    + "SELECT s.tick AS batch_id, s.key, count(*) AS n, min(event_id) AS first_event FROM stream s JOIN first f ON s.key = f.key AND s.tick = f.tick GROUP BY s.tick, s.key",
)
def _(spark, d):
    emitted = _watch(spark, d).emitted(spark)
    return emitted.groupBy(F.col("batch_id").cast("long").alias("batch_id"), "key").agg(
        F.count("*").alias("n"), F.min("entry_ord").alias("first_event")
    )


@R.query(
    "watch_filtered",
    "WITH "
    + STREAM
    + ","
    + FIRST.format("WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01 00:10:00'")
    + """SELECT s.tick AS batch_id, s.key, count(*) AS n FROM stream s JOIN first f ON s.key = f.key AND s.tick = f.tick
      WHERE event_type = 'error' AND date_trunc('millisecond', ts) >= TIMESTAMP '2024-01-01 00:10:00' GROUP BY s.tick, s.key""",
)
def _(spark, d):
    spec = filters.parse_spec(["tag:error"])
    window = refine.resolve_window(v.NOW, between=("2024-01-01T00:10:00Z", "later"))
    watch = _watch(spark, d, spec=spec, select=refine.Select(window=window))
    emitted = watch.emitted(spark)
    return emitted.groupBy(F.col("batch_id").cast("long").alias("batch_id"), "key").agg(F.count("*").alias("n"))


@R.query(
    "watch_restart",
    "WITH " + STREAM + "SELECT key, min(tick) AS batch_id FROM stream GROUP BY key",
)
def _(spark, d):
    watch = _watch(spark, d, repeat=True)
    return watch.seen(spark)


@R.query(
    "watch_tally",
    "WITH "
    + STREAM
    + ","
    + FIRST.format("")
    + """, t AS (SELECT s.tick, count(*) AS new, count(DISTINCT s.key) AS added FROM stream s JOIN first f ON s.key = f.key AND s.tick = f.tick GROUP BY s.tick)
    SELECT tick AS batch_id, new, CAST(sum(added) OVER (ORDER BY tick) AS BIGINT) AS seen FROM t""",
)
def _(spark, d):
    return _watch(spark, d).tallies(spark).select("batch_id", "new", "seen")


SINKS = ["https://hooks.slack.com/x", "https://discord.com/api/y", "https://hub.example/hook"]


@R.query(
    "watch_outbox",
    "WITH "
    + STREAM
    + ","
    + FIRST.format("")
    + """, n AS (SELECT s.tick AS batch_id, count(*) AS n FROM stream s JOIN first f ON s.key = f.key AND s.tick = f.tick GROUP BY s.tick)
    SELECT batch_id, 'slack' AS kind, 'Watch: ' || n || ' new' AS head FROM n
    UNION ALL SELECT batch_id, 'discord', 'Watch: ' || n || ' new' FROM n
    UNION ALL SELECT batch_id, 'webhook', n || ' items' FROM n""",
)
def _(spark, d):
    watch = _watch(spark, d, repeat=True, sinks=SINKS)
    box = watch.outbox(spark)
    head = F.regexp_extract("body", r'^\{"\w+":"([^\\]*)', 1)
    items = F.regexp_count("body", F.lit('"url": "https://e.example/'))
    shown = F.when(F.col("kind") == "webhook", F.concat(F.sum(items).cast("string"), F.lit(" items"))).otherwise(F.max(head))
    return box.groupBy(F.col("batch_id").cast("long").alias("batch_id"), "kind").agg(shown.alias("head"))


@R.query("watch_bounded", "SELECT DISTINCT user_id || '|' || event_type AS key FROM events")
def _(spark, d):
    folder = f"{shared_dir(spark)}/bounded-{uuid.uuid4().hex}"
    rows = _entries(spark, d)
    rows.write.parquet(f"{folder}/source")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/source")
    query = (
        bounded_watch(stream, "published", "60 days")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key")


@R.query(
    "watch_bodies",
    "WITH "
    + STREAM
    + ","
    + FIRST.format("")
    + """, items AS (SELECT s.tick AS batch_id, event_id, '    {
      "id": ' || to_json(s.key) || ',
      "url": "https://e.example/' || event_id || '",
      "title": ' || to_json(event_type || ' ' || event_id) || ',
      "date_published": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '",
      "tags": [
        ' || to_json(event_type) || '
      ]
    }' AS item FROM stream s JOIN first f ON s.key = f.key AND s.tick = f.tick)
    SELECT batch_id, '{
  "version": "https://jsonfeed.org/version/1.1",
  "title": "Watch",
  "items": [
' || string_agg(item, ',
' ORDER BY event_id) || '
  ]
}
' AS body FROM items GROUP BY batch_id""",
)
def _(spark, d):
    box = _watch(spark, d, sinks=SINKS[2:]).outbox(spark)
    return whole(box, ["batch_id"])


KEPT_HOURS, LATE_MINUTES = 60, 10


@R.query(
    "watch_expiring",
    "WITH RECURSIVE "
    + STREAM
    + f""", marks AS (SELECT tick, max(ts) - INTERVAL {LATE_MINUTES} MINUTE AS mark FROM stream GROUP BY tick),
    told AS (SELECT t.tick, max(m.mark) AS mark FROM (SELECT unnest(range({TICKS + 1})) AS tick) t LEFT JOIN marks m ON m.tick < t.tick GROUP BY t.tick),
    met AS (SELECT s.tick, key, min(ts) AS first, max(ts) AS last, count(*) AS n FROM stream s JOIN told w ON w.tick = s.tick
      WHERE w.mark IS NULL OR date_trunc('millisecond', ts) >= date_trunc('millisecond', w.mark) GROUP BY s.tick, key),
    walk AS (
      SELECT 0::BIGINT AS step, key, NULL::TIMESTAMP AS last, false AS shown, NULL::TIMESTAMP AS first, NULL::BIGINT AS n FROM (SELECT DISTINCT key FROM stream)
      UNION ALL
      SELECT step + 1, w.key,
        CASE WHEN greatest(w.last, m.last) + INTERVAL {KEPT_HOURS} HOUR <= e.mark THEN NULL ELSE greatest(w.last, m.last) END,
        m.key IS NOT NULL AND w.last IS NULL, m.first, m.n
      FROM walk w LEFT JOIN met m ON m.key = w.key AND m.tick = w.step JOIN told e ON e.tick = w.step + 1
      WHERE step < {TICKS})
    SELECT step - 1 AS tick, key, epoch_ms(date_trunc('millisecond', first)) AS first_ms, n FROM walk WHERE shown""",
)
def _(spark, d):
    folder = f"{shared_dir(spark)}/expiring-{uuid.uuid4().hex}"
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = _ticks(spark, d)
    for quarter in range(TICKS):
        part = rows.filter(F.col("tick") == quarter).drop("tick")
        part.write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/source")
        out = f"{folder}/out/tick={quarter}"
        query = (
            expiring_watch(stream, "published", f"{LATE_MINUTES} minutes", f"{KEPT_HOURS}h")
            .writeStream.foreachBatch(lambda df, n, out=out: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    told = spark.read.schema("key string, first timestamp, n bigint, tick bigint").parquet(f"{folder}/out")
    return told.select("tick", "key", v.ms(F.col("first")).alias("first_ms"), "n")
