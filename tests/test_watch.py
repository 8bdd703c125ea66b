"""The watch: seen state in buckets, the commit log, replays and failing destinations."""

import json

import pytest
from pyspark.sql import functions as F

from feedspark.sinks.assemble import whole
from feedspark.streaming import seen as seen_module
from feedspark.streaming import watch as watch_module
from feedspark.streaming.seen import SeenKeys
from feedspark.streaming.watch import Watch, expiring_watch
from helpers import entries

HOOK = "https://hub.example/hook"
CHAT = "https://hooks.slack.com/x"


def batch(spark, *names):
    return entries(spark, *[{"id": n, "title": f"t {n}", "link": f"https://h.example/{n}"} for n in names])


def bodies(spark, watch):
    rows = whole(watch.outbox(spark).filter("kind = 'webhook'"), ["batch_id"]).collect()
    return {r["batch_id"]: [i["id"] for i in json.loads(r["body"])["items"]] for r in rows}


def test_ticks_emit_once(spark, tmp_path):
    watch = Watch(str(tmp_path / "w"), sinks=[HOOK, CHAT])
    watch.tick(batch(spark, "a", "b", "b"), 0)
    watch.tick(batch(spark, "b", "c"), 1)
    watch.tick(batch(spark, "a"), 2)
    got = sorted((r["batch_id"], r["id"]) for r in watch.emitted(spark).collect())
    assert got == [(0, "a"), (0, "b"), (0, "b"), (1, "c")]
    assert sorted(tuple(r) for r in watch.seen(spark).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert bodies(spark, watch) == {0: ["a", "b", "b"], 1: ["c"]}
    assert [(r["batch_id"], r["new"], r["seen"]) for r in watch.tallies(spark).orderBy("batch_id").collect()] == [(0, 3, 2), (1, 1, 3)]
    assert watch.outbox(spark).filter("kind = 'slack'").count() == 2


def test_a_published_tick_is_not_run_again(spark, tmp_path):
    watch = Watch(str(tmp_path / "w"), sinks=[HOOK])
    watch.tick(batch(spark, "a"), 0)
    watch.tick(batch(spark, "other"), 0)
    assert [r["id"] for r in watch.emitted(spark).collect()] == ["a"]
    assert bodies(spark, watch) == {0: ["a"]}


@pytest.mark.parametrize("step", ["deliver", "added", "publish"])
def test_a_tick_that_fails_is_run_again_without_loss_or_repeat(spark, tmp_path, monkeypatch, step):
    watch = Watch(str(tmp_path / "w"), sinks=[HOOK])
    watch.tick(batch(spark, "a"), 0)

    class Lost(BaseException):
        """Ends the process, unlike a failing destination."""

    def lost(*_):
        raise Lost

    with monkeypatch.context() as m:
        m.setattr(SeenKeys if step == "added" else Watch, step, lost)
        with pytest.raises(Lost):
            watch.tick(batch(spark, "a", "b"), 1)
    assert [r["id"] for r in watch.emitted(spark).collect()] == ["a"] and bodies(spark, watch) == {0: ["a"]}
    watch.tick(batch(spark, "a", "b"), 1)
    watch.tick(batch(spark, "b", "c"), 2)
    assert sorted((r["batch_id"], r["id"]) for r in watch.emitted(spark).collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert bodies(spark, watch) == {0: ["a"], 1: ["b"], 2: ["c"]}


def test_a_failing_destination_is_served_later(spark, tmp_path, monkeypatch):
    watch = Watch(str(tmp_path / "w"), sinks=[HOOK, CHAT])
    real = Watch.deliver

    def fails(self, emitted, url, batch_id):
        if url == HOOK:
            raise OSError("no answer")
        real(self, emitted, url, batch_id)

    with monkeypatch.context() as m:
        m.setattr(Watch, "deliver", fails)
        watch.tick(batch(spark, "a", "b"), 0)
    assert [(b, u) for b, u, _ in watch.failures] == [(0, HOOK)]
    assert bodies(spark, watch) == {} and watch.outbox(spark).filter("kind = 'slack'").count() == 1
    watch.tick(batch(spark, "b"), 1)
    assert bodies(spark, watch) == {0: ["a", "b"]}
    assert watch.outbox(spark).filter("kind = 'slack'").count() == 1


def test_imported_keys_are_not_emitted(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps(["a", "c"]))
    watch = Watch(str(tmp_path / "w"))
    watch.import_seen(spark, str(tmp_path / "state.json"))
    watch.tick(batch(spark, "a", "b"), 0)
    assert [r["id"] for r in watch.emitted(spark).collect()] == ["b"]
    assert watch.tallies(spark).first()["seen"] == 3


def test_seen_keys_are_compacted_and_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen_module, "BUCKET_KEYS", 40)
    keys = lambda low, high: spark.range(low, high).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    state = SeenKeys(spark, str(tmp_path), [])
    assert state.hits(keys(0, 5), 5).count() == 0
    for tick in range(9):
        state = state.compacted(tick).added(keys(tick * 200, tick * 200 + 200), 200, tick)
    assert [(p.level, p.keys) for p in state.parts] == [(1, 800), (1, 800), (0, 200)]
    assert state.parts[0].buckets == 32
    rows = state.rows()
    assert rows.count() == 1800 and rows.filter("key = 'k1234'").first()["batch_id"] == 6
    old = state.hits(keys(1000, 1003), 3)
    assert sorted(r["key"] for r in old.collect()) == ["k1000", "k1001", "k1002"]
    assert 1 <= len(state.read_buckets) <= 5  # of 80
    assert state.hits(keys(5000, 5003), 3).count() == 0 and len(state.read_buckets) <= 1
    monkeypatch.setattr(seen_module, "BUCKET_KEYS", 3)
    assert state.hits(keys(0, 1800), 1800).count() == 1800  # keys dealt to shares of a bucket


def test_wide_keys(spark, tmp_path):
    state = SeenKeys(spark, str(tmp_path), []).added(spark.createDataFrame([("",), ("é" * 5000,)], "key string"), 2, 0)
    asked = spark.createDataFrame([("",), ("é" * 5000,), ("é" * 4999,)], "key string")
    assert state.hits(asked, 3).count() == 2


def test_expiring_watch_keeps_keys_in_any_session_zone(spark, tmp_path):
    """A key met an hour ago is kept for three hours, whatever zone the session shows times in."""
    name = "spark.sql.streaming.stateStore.providerClass"
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for tick, hours in enumerate([[("a", 12), ("b", 12)], [("a", 13), ("c", 13)], [("c", 16)], [("a", 18), ("c", 18), ("c", 19)]]):
            rows = spark.range(1).selectExpr(
                "inline(array(" + ",".join(f"struct('{k}' AS id, timestamp_seconds({1704067200 + 3600 * h}) AS published)" for k, h in hours) + "))"
            ).selectExpr("id", "string(null) AS link", "id AS title", "published")
            rows.write.mode("append").parquet(f"{tmp_path}/source")
            stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/source")
            out = f"{tmp_path}/out/tick={tick}"
            expiring_watch(stream, "published", "0 minutes", "3h").writeStream.foreachBatch(
                lambda df, n, out=out: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
            ).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        told = spark.read.schema("key string, first timestamp, n bigint, tick bigint").parquet(f"{tmp_path}/out")
        got = {(r["tick"], r["key"][-1], r["at"], r["n"]) for r in told.selectExpr("tick", "key", "(unix_seconds(first) - 1704067200) / 3600 AS at", "n").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.unset(name)
    assert got == {(0, "a", 12, 1), (0, "b", 12, 1), (1, "c", 13, 1), (3, "a", 18, 1)}


def test_expiring_watch_holds_keys_in_buckets(spark, tmp_path, monkeypatch):
    """Keys of a bucket come, stay and go by themselves, and the state has a row for a bucket, not for a key."""
    import random

    monkeypatch.setattr(watch_module, "STATE_BUCKETS", 3, raising=False)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dice, base, kept = random.Random(5), 1704067200, 7200
    last, mark, want, got, most = {}, 0, set(), set(), 0
    try:
        for tick in range(5):
            given = [(f"k{dice.randrange(60)}", base + 3600 * tick + dice.randrange(-1800, 3600)) for _ in range(50)]
            given += [given[0], ("late", base - 90000)]
            # The plain form: late rows are dropped, keys are told once and forgotten after the tick.
            fresh = {}
            for k, t in given:
                if t >= mark:
                    fresh.setdefault(k, []).append(t)
            want |= {(tick, k, min(ts), len(ts)) for k, ts in fresh.items() if k not in last}
            last |= {k: max([last.get(k, 0), *ts]) for k, ts in fresh.items()}
            mark = max(mark, *[t - 600 for _, t in given])
            last = {k: t for k, t in last.items() if t + kept > mark}
            rows = spark.createDataFrame(given, "id string, s long").selectExpr("id", "string(null) AS link", "timestamp_seconds(s) AS published")
            rows.write.mode("append").parquet(f"{tmp_path}/source")
            stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/source")
            out = f"{tmp_path}/out/tick={tick}"
            query = expiring_watch(stream, "published", "10 minutes", "2h").writeStream.foreachBatch(
                lambda df, n, out=out: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
            ).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            most = max([most, *[p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]])
        told = spark.read.schema("key string, first timestamp, n bigint, tick bigint").parquet(f"{tmp_path}/out")
        got = {(r["tick"], r["key"].split(":")[-1], r["s"], r["n"]) for r in told.selectExpr("tick", "key", "unix_seconds(first) AS s", "n").collect()}
    finally:
        spark.conf.unset(name)
    assert got == want and len({k for _, k, _, _ in want}) < len(want)  # some came back
    assert 1 <= most <= 3
