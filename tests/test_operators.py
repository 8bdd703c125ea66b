from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from feedspark.operators import definitions, diff, filters, merge, overview, ranking, refine, validate
from helpers import at, column, entries

PERSON = lambda n: (n, None, None)


@pytest.fixture(scope="module")
def mixed(spark):
    return entries(
        spark,
        {"title": "Beta", "published": at("2024-01-02"), "source": ("Alpha", None)},
        {"title": "alpha", "source": ("Beta", None)},
        {"title": "Éclair", "updated": at("2024-01-03"), "source": ("Alpha", None), "authors": [PERSON("Ann Lee"), PERSON("Bo")], "tags": ["AI", "go"]},
        {"title": "zeta", "summary": "About AI", "source": ("Beta", None)},
    )


# ---- filters ----


@pytest.mark.parametrize(
    "include, exclude, want",
    [
        ([], [], [0, 1, 2, 3]),
        (["title:ETA"], [], [0, 3]),
        (["title:eta"], ["source:beta"], [0]),
        (["author:lee bo"], [], [2]),
        (["tag:ai go"], [], []),
        (["tag:ai", "summary:ai"], [], [2, 3]),
        (["tag:"], [], [2]),
        (["title:"], [], [0, 1, 2, 3]),
        (["title:/^(b|z)/"], [], [0, 3]),
        (["title"], [], [0, 1, 2, 3]),
        ([], ["tag:/^g/"], [0, 1, 3]),
    ],
)
def test_rules(mixed, include, exclude, want):
    spec = filters.parse_spec(include, exclude)
    assert column(filters.filter_entries(mixed, spec), "entry_ord") == want


def test_rules_table_agrees_with_the_spec(spark, mixed):
    rules = spark.createDataFrame(
        [("include", "tag", "AI", False), ("include", "title", "^z", True), ("exclude", "author", "BO", False)],
        "kind string, field string, pattern string, regex boolean",
    )
    assert column(filters.filter_by_rules_table(mixed, rules), "entry_ord") == [3]
    assert filters.filter_by_rules_table(mixed, rules.limit(0)).count() == 4


@pytest.mark.parametrize("text", ["nope:x", "", "Title:x"])
def test_unknown_field_names_the_token(text):
    with pytest.raises(ValueError, match="does not start with a field"):
        filters.parse_rule(text)


def test_first_colon_splits():
    assert filters.parse_rule("title:a:b") == filters.Rule("title", "a:b")
    assert filters.parse_rule("title:/a/") == filters.Rule("title", "a", True)
    assert filters.parse_rule("title:/") == filters.Rule("title", "/")


# ---- windows, sorts, limits ----

NOW = at("2024-01-10T12:30:00")


def test_window_precedence():
    w = refine.resolve_window
    assert w(NOW, since="24h").since == NOW - timedelta(days=1)
    assert w(NOW, since="24h", max_age="7d").since == NOW - timedelta(days=1)
    assert w(NOW, today=True, this_week=True).since == at("2024-01-10")
    assert w(NOW, this_week=True, since="1h").since == at("2024-01-08")
    assert w(NOW, between=("2024-01-01", "bad"), today=True) == refine.Window(at("2024-01-01"), None)
    assert w(NOW, since="bad") == refine.Window()


def test_window_is_inclusive_and_drops_undated(mixed):
    got = refine.in_window(mixed, refine.Window(at("2024-01-02"), at("2024-01-03")))
    assert column(got, "entry_ord") == [0, 2]
    assert refine.in_window(mixed, refine.Window()).count() == 4


@pytest.mark.parametrize(
    "select, want",
    [
        (refine.Select(sort="date"), [2, 0, 1, 3]),
        (refine.Select(sort="date", order="asc"), [1, 3, 0, 2]),
        (refine.Select(sort="title"), [1, 0, 2, 3]),
        (refine.Select(sort="title", order="desc"), [3, 2, 0, 1]),
        (refine.Select(sort="source"), [0, 2, 1, 3]),
        (refine.Select(sort="source", order="desc"), [1, 3, 2, 0]),
        (refine.Select(limit=2), [0, 1]),
        (refine.Select(limit=0), []),
        (refine.Select(sort="date", limit=-1), [2, 0, 1, 3]),
    ],
)
def test_select(mixed, select, want):
    assert column(refine.select_entries(mixed, select), "entry_ord", None) == want


@pytest.mark.parametrize(
    "bad",
    [{"sort": "x"}, {"order": "up"}, {"limit": "-1"}, {"limit": "1.5"}, {"limit": "z"}, {"since": "1w"}, {"max_age": ""}, {"between": "a"}, {"between": "2024-01-01.."}, {"between": "a..b"}],
)
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        refine.build_select(NOW, **bad)


def test_cutoff():
    assert refine.resolve_cutoff(NOW) is None
    assert refine.resolve_cutoff(NOW, today=True, since="1h") == at("2024-01-10")
    with pytest.raises(ValueError):
        refine.resolve_cutoff(NOW, since="soon")


# ---- merge ----


def test_merge_first_wins_and_newest_first(spark):
    rows = entries(
        spark,
        {"link": "a", "published": at("2024-01-01")},
        {"link": "b", "updated": at("2024-01-03"), "published": at("2020-01-01")},
        {"link": "a", "part_ord": 1, "published": at("2024-01-09")},
        {"link": "", "id": "x", "part_ord": 1},
        {"link": "", "id": "x", "part_ord": 2, "published": at("2024-02-01")},
        {"link": "old", "part_ord": 2, "published": at("1969-06-01")},
    )
    assert column(merge.merge_feeds(rows), "entry_ord", None) == [1, 0, 3, 5]
    assert column(merge.merge_feeds(rows, 2), "entry_ord", None) == [1, 0]
    assert merge.merge_feeds(rows, 0).count() == 4


def test_header_falls_back_to_now(spark):
    head = merge.merged_header(entries(spark, {}), F.lit("A b"), NOW, ["part_ord"], namespace="urn:x:").first()
    assert head["feed_id"] == "urn:x:A%20b"
    assert head["updated"].replace(tzinfo=None) == NOW.replace(tzinfo=None)


def test_source_label(spark):
    label = lambda *v: spark.range(1).select(merge.source_label(*[F.lit(x) for x in v]).alias("s")).first()[0]
    assert tuple(label(None, None, "Feed", "home")) == ("Feed", "home")
    assert tuple(label("Own", "", "Feed", "home")) == ("Own", None)


def test_flatten_relabels_and_dedups_in_mesh_order(spark):
    rows = entries(
        spark,
        {"link": "a", "published": at("2024-01-01")},
        {"link": "b", "published": at("2024-01-02")},
        {"link": "a", "published": at("2024-01-05")},
    ).withColumn("construct", F.lit("c"))
    rows = rows.withColumn("mesh_ord", (F.col("entry_ord") == 2).cast("int")).withColumn("mesh_name", F.concat(F.lit("m"), "mesh_ord"))
    flat = merge.flatten_construct(merge.grouped_construct(rows))
    assert column(flat, "entry_ord") == [0, 1]
    assert column(flat, "source.name") == ["m0", "m0"]


def test_new_entries_keep_repeats(spark):
    rows = entries(spark, {"id": "k"}, {"id": "k"}, {"id": "", "link": "l"}, {"id": "seen"})
    seen = spark.createDataFrame([("seen",)], "key string")
    assert column(diff.new_entries(rows, seen), "entry_ord") == [0, 1, 2]


# ---- ranks over large groups ----


def test_spread_positions_equal_the_window(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        (F.hash("id")).alias("v"),
        "id",
    )
    order = [F.col("v"), F.col("id")]
    plain = ranking.positions(rows, ["k"], order, "pos", peak=0)
    spread = ranking.positions(rows, ["k"], order, "pos", group_rows=10)
    assert sorted(map(tuple, plain.select("id", "pos").collect())) == sorted(map(tuple, spread.select("id", "pos").collect()))
    total = ranking.spread_positions(rows, [], order, "pos")
    want = [r[0] for r in rows.orderBy(*order).select("id").collect()]
    assert [r[0] for r in total.orderBy("pos").select("id").collect()] == want
    assert total.agg(F.min("pos"), F.max("pos")).first() == (0, 4999)


def test_top_rows_beyond_the_planner_threshold(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), F.hash("id").alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    few = ranking.top_rows(rows, ["k"], order, 900)
    many = ranking.top_rows(rows, ["k"], order, 1500)
    assert (few.count(), many.count()) == (1800, 3000)
    assert few.join(many, "id", "left_anti").count() == 0


def test_palette_cycles(spark):
    rows = entries(spark, *[{"source": (f"s{i % 8}", None)} for i in range(16)])
    got = dict(overview.source_palette(rows, F.col("source.name")).collect())
    assert got == {f"s{i}": i % 6 for i in range(8)}


def test_slug_collisions(spark):
    rows = spark.createDataFrame([("c", i, n) for i, n in enumerate(["A b", "a-b", "!", "A_B"])], "construct string, mesh_ord int, mesh_name string")
    assert column(overview.mesh_slugs(rows, "construct"), "slug", "mesh_ord") == ["a-b", "a-b-2", "mesh-3", "a-b-3"]


# ---- definitions and records ----


def test_shadowing_rejects_paths(spark):
    rows = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y"), ("../a", 0, "x"), ("a..b", 0, "x")], "name string, location_rank int, v string")
    assert [tuple(r) for r in definitions.shadow(rows).collect()] == [("a", 1, "y")]


def test_health(spark):
    rows = spark.createDataFrame([("c", "m1", None), ("c", "m1", "e"), ("c", "m2", "e")], "construct string, mesh string, error string")
    health = definitions.source_health(rows, ["construct", "mesh"])
    assert {r["mesh"]: r["mesh_ok"] for r in health.collect()} == {"m1": True, "m2": False}
    assert tuple(definitions.construct_health(health).first()) == ("c", 1, True)


def test_unknown_themes(spark):
    catalog = spark.createDataFrame([("t1", "T", 0, "n", "u")], "theme string, theme_title string, source_ord int, name string, url string")
    wanted = spark.createDataFrame([("t1",), ("t2",)], "theme string")
    assert column(definitions.unknown_themes(catalog, wanted), "theme", None) == ["t2"]
    assert definitions.select_themes(catalog, "all").count() == 1
    assert definitions.select_themes(catalog, "x, t1").count() == 1


@pytest.mark.parametrize(
    "kind, json, want",
    [
        ("mesh", '{"name":"m","sources":[{"name":"a","url":"u"}]}', []),
        ("mesh", '{"name":"m","sources":[{"name":"a"}]}', ["sources.url is required"]),
        ("mesh", '{"sources":3}', ["name is required", "sources must be a list"]),
        ("construct", '{"name":"c","meshes":["a",{"ref":"b"},{"name":"m","sources":[]}]}', []),
        ("construct", '{"name":"c","meshes":[{"x":1}]}', ["bad member"]),
        ("feed", "nope", ["not JSON"]),
    ],
)
def test_records(spark, kind, json, want):
    df = spark.createDataFrame([("k", json)], "k string, j string")
    assert column(validate.validate_records(df, "j", kind, "k"), "reason", None) == want


def test_wrong_options_agree_with_the_arguments(spark):
    values = {
        "sort": ["date", "Date", "", None],
        "order": ["asc", "up", None],
        "limit": ["0", "5", " 7 ", "5.0", "5.5", "-1", "1e2", "x", "", "5d", "nan", None],
        "between": ["2024-01-01..2024-02-01", "2024-01-01..", "..", "a..b", "2024-01-01", "2024-01-01..2024-02-30", "2024-01-01T10:00:00..2024-01-02", None],
        "since": ["24h", "7 d", "x", "", "3w", None],
        "max_age": ["5m", "m", None],
    }
    rows, want = [], set()
    for name, given in values.items():
        for value in given:
            rows.append((len(rows), *[value if n == name else None for n in values]))
            try:
                refine.build_select(NOW, **{name: value})
            except ValueError:
                want.add((rows[-1][0], name, value))
    saved = spark.createDataFrame(rows, "k int, " + ", ".join(f"`{n}` string" for n in values))
    got = refine.wrong_options(saved, ["k"]).collect()
    assert {(r["k"], r["option"], r["given"]) for r in got} == want and len(got) == len(want)
    both = spark.createDataFrame([(1, "x", "y")], "k int, sort string, `limit` string")
    assert refine.wrong_options(both, ["k"]).count() == 2
    assert refine.wrong_options(both.limit(0), ["k"]).count() == 0
