import pytest
from pyspark.sql import functions as F

from feedspark.functions import dates, ids, text, urls
from helpers import evaluate, lit


@pytest.mark.parametrize(
    "given, want",
    [
        ("Wed, 02 Oct 2024 13:00:00 GMT", "2024-10-02 13:00:00"),
        ("Wed, 2 Oct 2024 13:00:00 +0200", "2024-10-02 11:00:00"),
        ("2024-01-02", "2024-01-02 00:00:00"),
        ("2024-01-02T03:04:05.678Z", "2024-01-02 03:04:05.678"),
        ("2024-01-02T03:04:05-05:00", "2024-01-02 08:04:05"),
        ("May 28, 2026", "2026-05-28 00:00:00"),
        ("May 2026", "2026-05-01 00:00:00"),
        ("3 September 2024 10:00 PDT", "2024-09-03 17:00:00"),
        ("12:30", None),
        ("soon", None),
        ("2024-13-45", None),
        ("", None),
    ],
)
def test_norm_date(spark, given, want):
    assert evaluate(spark, dates.norm_date(lit(given)).cast("string")) == [want]


@pytest.mark.parametrize(
    "href, want",
    [
        ("/x", "https://ex.com/x"),
        ("y", "https://ex.com/a/b/y"),
        ("../z", "https://ex.com/a/z"),
        ("../../../..", "https://ex.com/"),
        ("./", "https://ex.com/a/b/"),
        ("?p=2", "https://ex.com/a/b/c.html?p=2"),
        ("#g", "https://ex.com/a/b/c.html?q=1#g"),
        ("//CDN.com/k", "https://cdn.com/k"),
        ("https://a.com", "https://a.com/"),
        ("http://a.com:80/b", "http://a.com/b"),
        ("", "https://ex.com/a/b/c.html?q=1"),
        (" /pad ", "https://ex.com/pad"),
        ("mailto:a@b", "mailto:a@b"),
        ("/é ü", "https://ex.com/%C3%A9%20%C3%BC"),
        ("/a%20b", "https://ex.com/a%20b"),
    ],
)
def test_resolve_url(spark, href, want):
    assert evaluate(spark, urls.resolve_url(lit(href), lit("https://Ex.com:443/a/b/c.html?q=1#f"))) == [want]


def test_resolve_without_a_base_keeps_the_link(spark):
    assert evaluate(spark, urls.resolve_url(lit("x/y"), lit("no url"))) == ["x/y"]


def test_hash_of_known_texts(spark):
    got = evaluate(spark, *[ids.fnv1a64(lit(s)) for s in ("", "hello world", "a")])
    assert got == ["cbf29ce484222325", "779a65e7023cd2e7", "af63dc4c8601ec8c"]


def test_hash_matches_a_plain_loop(spark):
    texts = ["é", "😀 astral", "x" * 300, "mixed ÄÖ\n\t", ""]

    def plain(s):
        h = 0xCBF29CE484222325
        raw = s.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x100000001B3) % 2**64
        return f"{h:016x}"

    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    got = [r[0] for r in df.select(ids.fnv1a64(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts] + [None]


def test_stable_id_only_fills_blanks(spark):
    kept, filled = evaluate(
        spark,
        ids.with_stable_id(lit("real"), lit("l"), lit("t")),
        ids.with_stable_id(lit("  "), lit("l"), lit("t")),
    )
    assert kept == "real"
    assert filled.startswith("urn:nwf:") and len(filled) == len("urn:nwf:") + 16


def test_keys(spark):
    assert evaluate(
        spark,
        ids.entry_key(lit(""), lit("l")),
        ids.entry_key(lit("i"), lit("l")),
        ids.merge_key(lit(""), lit("i")),
        ids.merge_key(lit("l"), lit("i")),
    ) == ["l", "i", "i", "l"]


def test_durations(spark):
    assert [dates.parse_duration(s) for s in ("90m", " 24h ", "7 d", "1w", "h", "-1h")] == [
        5_400_000,
        86_400_000,
        604_800_000,
        None,
        None,
        None,
    ]
    assert evaluate(spark, dates.duration_ms(lit("90m")), dates.duration_ms(lit("x"))) == [5_400_000, None]


def test_text(spark):
    assert evaluate(
        spark,
        text.strip_html(lit("<p>a&b</p>\n <b>c</b> ")),
        text.strip_html(lit("<br>")),
        text.truncate(lit("a  b\nc d e f"), 6),
        text.slug(lit("--- AI & News!"), lit(0)),
        text.slug(lit("***"), lit(4)),
        text.decode_entities(lit("&hellip;&amp;&lt;&#8217;&nope;")),
        text.keywords(lit(" a, b ,,c")),
        text.keywords(lit(" , ")),
        text.json_string(lit('q"\\\n')),
    ) == ["a&b c", None, "a b c...", "ai-news", "mesh-5", "…&amp;&lt;&#8217;&nope;", ["a", "b", "c"], None, '"q\\"\\\\\\n"']


@pytest.mark.parametrize("raw", ["a\tb\nc\rd", "a\\tb", "\\\\n\\", "xy\\tb", "plain"])
def test_cells_survive_a_round_trip(spark, raw):
    encoded = text.cell_encode(lit(raw))
    assert evaluate(spark, text.cell_decode(encoded)) == [raw]


def test_unknown_escape_drops_the_backslash(spark):
    assert evaluate(spark, text.cell_decode(lit("a\\qb"))) == ["aqb"]


def test_merged_feed_id_is_percent_encoded(spark):
    got = evaluate(spark, ids.merged_feed_id(lit("AI News (é)!*~'"), "urn:x:"))
    assert got == ["urn:x:AI%20News%20(%C3%A9)!*~'"]


def test_python_functions_travel_by_value(tmp_path):
    """Executors have no copy of the package: what is sent to them must be complete."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from feedspark.sources import html, opml

    sent = (ids._fnv1a64.func, text._decode_named.func, html._scan_pages.func, text._decode_apart.func, opml.Outlines)
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    code = (
        "import pickle, sys, pandas as pd; f = pickle.load(open('sent', 'rb'));"
        "print(f[0](pd.Series(['a'])).tolist(), f[2](pd.Series(['<a href=x>t</a>']), pd.Series(['{\"item\":\"a\",\"title\":\"a\"}'])).shape,"
        "f[3](pd.Series(['a &amp; b'])).tolist(), list(f[4]().eval('<opml/>')));"
        "assert not any(m.startswith('feedspark') for m in sys.modules)"
    )
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert run.stdout.startswith("['af63dc4c8601ec8c'] (1, 4) ['a & b'] [(-1")


def test_entities_are_decoded_once_and_bodies_stay_out_of_python(spark):
    import html
    import re

    from feedspark.functions import text

    named = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z][A-Za-z0-9]*;")
    bodies = ["", "no name", "&middot;", "a&middot;b&middot;&eacute;&lt;&amp;middot;", "&AMP;middot; &ampAMP; &AMP;AMP;", "&notit; &foo; & &;&&middot", "&#183;&middot;\n&hellip;&", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string").withColumn("got", text.decode_entities(F.col("body")))
    got = [r["got"] for r in df.orderBy("n").collect()]
    assert got == [b and named.sub(lambda m: html.unescape(m.group(0)), b) for b in bodies]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_decode_named(" in plan and not re.search(r"_decode_named\([^\n]*THEN body#\d+ END\)#", plan)


def test_python_batches_are_bounded(spark):
    from feedspark.session import PYTHON_ROWS, spread

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", PYTHON_ROWS), ("0", PYTHON_ROWS), ("5", 5)):
            spark.conf.set(name, given)
            spread(spark.range(3)).count()
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
