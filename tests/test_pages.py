import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.model import TEMPLATE
from feedspark.plans.meshes import fetch_meshes
from feedspark.sources import cascade, definitions, html, propose, raw
from feedspark.streaming.watch import Watch
from helpers import column, docs, entries

CARDS = """<html><head><title>Blog &amp; more</title></head><body>
<ul><li class="note"><span class="who">Ann</span> <b class="t">a</b><b class="t"> </b><h3><a href="/p/1">First &amp; best</a></h3><div class="sum">S1</div><time datetime="2024-01-02">x</time></li>
<li class="note"><time>May 28, 2026</time><h3><a href="/p/2">Second</a></h3></li>
<li class="note"><h3>No link</h3></li></ul></body></html>"""


def templates(spark, *rows):
    schema = T.StructType([*TEMPLATE.fields, T.StructField("load_ord", T.IntegerType())])
    names = TEMPLATE.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)], schema)


def test_template(spark):
    t = templates(
        spark,
        {"host": "h.example", "item": "b", "title": "b"},
        {"host": "h.example", "feedTitle": "Mine", "item": ".note", "title": "h3", "link": "h3 a", "date": "time", "summary": ".sum", "author": ".who", "tags": "b.t"},
        {"item": "p", "title": "p"},
    )
    scanned = html.scan_pages(docs(spark, CARDS), t)
    one, two = html.template_entries(scanned).orderBy("entry_ord").collect()
    assert (one["title"], one["link"], one["summary"], one["authors"][0]["name"], one["tags"]) == ("First & best", "https://h.example/p/1", "S1", "Ann", ["a"])
    assert (one["published"].isoformat(), two["published"].isoformat()) == ("2024-01-02T00:00:00", "2026-05-28T00:00:00")
    assert two["id"].startswith("urn:nwf:")
    assert column(html.template_feeds(scanned), "title", None) == ["Mine"]


def test_item_can_be_the_link(spark):
    body = '<a class="row" href="/n/1"><p>One</p></a><a class="row ad" href="/n/2"><p>Two</p></a><a href="/x"><p>No</p></a>'
    t = templates(spark, {"host": "h.example", "item": "a.row:not(.ad)", "title": "p"})
    assert column(html.template_entries(html.scan_pages(docs(spark, body), t)), "link") == ["https://h.example/n/1"]


def test_bad_selector_is_reported(spark):
    t = templates(spark, {"host": "h.example", "item": "a:hover", "title": "p"})
    assert "unsupported" in html.scan_pages(docs(spark, CARDS), t).select("page.problem").first()[0]


def test_jsonld(spark):
    data = {"@graph": [{"@type": "WebSite"}, [{"@type": ["Thing", "Article"], "name": "N", "@id": "/id", "author": "Solo", "keywords": ["a", 1, "b"], "articleBody": "<p>B</p>"}], {"@type": "ItemList", "itemListElement": {"item": {"headline": "H", "url": "/h"}}}, {"@type": "Article", "headline": "dup", "url": "/id"}, {"@type": "Article", "headline": 3, "url": "/n"}]}
    body = f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">oops</script>'
    one, two = html.jsonld_entries(html.scan_pages(docs(spark, body))).orderBy("entry_ord").collect()
    assert (one["title"], one["link"], one["authors"][0]["name"], one["tags"], one["summary"]) == ("N", "https://h.example/id", "Solo", ["a", "b"], "B")
    assert (two["title"], two["link"]) == ("H", "https://h.example/h")


def test_articles_need_two(spark):
    a = '<article><h3>Head</h3><a href="/a">go</a><p> text </p></article>'
    b = '<article><h2><a href="/b">B</a></h2></article>'
    rows = html.article_entries(html.scan_pages(docs(spark, a + b, a + a, b)))
    assert column(rows, "link") == ["https://h.example/a", "https://h.example/b"]
    assert column(rows, "summary") == ["text", None]


def test_declared_links(spark):
    link = '<link rel="alternate" type="{}" href="{}">'
    body = link.format("application/rss+xml", "/r") + link.format("Application/ATOM+xml", "a")
    assert html.feed_links(html.scan_pages(docs(spark, body))).first()["feed_url"] == "https://h.example/a"
    assert html.feed_links(html.scan_pages(docs(spark, "<p>"))).first()["feed_url"] is None


def test_titles(spark):
    one = '<meta property="og:site_name" content="Site"><title>T</title>'
    t = lambda b: spark.range(1).select(raw.page_title(F.lit(b), F.lit("u"))).first()[0]
    assert [t(one), t("<title>\n T &amp; U</title>"), t("<p>"), t("<meta property='og:site_name' content='Q'>")] == ["Site", "T & U", "u", "Q"]
    assert spark.range(1).select(raw.listing_title(F.lit("<h1>A <b>B</b></h1>"))).first()[0] == "A B"


def test_cascade(spark):
    rss = "<rss><channel><title>R</title><item><title>x</title><link>/x</link></item></channel></rss>"
    alt = '<link rel="alternate" type="application/rss+xml" href="/{}">'
    articles = '<article><h2><a href="/1">1</a></h2></article><article><h2><a href="/2">2</a></h2></article>'
    rows = [
        ("https://a.example/", alt.format("feed") + articles),
        ("https://a.example/feed", rss),
        ("https://b.example/", alt.format("gone") + articles),
        ("https://c.example/", CARDS),
        ("https://d.example/", "<p>nothing</p>"),
        ("https://e.example/", alt.format("bad") + articles),
        ("https://e.example/bad", "<rss><broken"),
    ]
    df = spark.createDataFrame([(u, b, "") for u, b in rows], "final_url string, body string, content_type string")
    t = templates(spark, {"host": "c.example", "item": ".note", "title": "h3", "link": "a"})
    out, rejects = cascade.extract(df, t)
    got = {(r["source_url"], r["strategy"], r["n"]) for r in out.groupBy("source_url", "strategy").agg(F.count("*").alias("n")).collect()}
    assert got == {("https://a.example/", "feed", 1), ("https://a.example/feed", "feed", 1), ("https://b.example/", "articles", 2), ("https://c.example/", "template", 2), ("https://e.example/", "articles", 2)}
    assert sorted(column(rejects, "key", None)) == ["https://d.example/", "https://e.example/bad"]


def test_redirected_sources_keep_their_entries(spark):
    rss = "<rss><channel><title>R</title><item><title>x</title><link>/x</link></item></channel></rss>"
    alt = '<link rel="alternate" type="application/rss+xml" href="/feed">'
    rows = [
        ("https://a.example/", "https://www.a.example/", rss),
        ("https://b.example/", "https://b.example/", alt),
        ("https://b.example/feed", "https://feeds.example/b", rss),
        ("https://c.example/", "https://www.c.example/", "<p>nothing</p>"),
    ]
    documents = spark.createDataFrame(
        [(*r, "", None) for r in rows], "requested_url string, final_url string, body string, content_type string, error string"
    )
    sources = spark.createDataFrame(
        [("k", 0, "m", i, n, f"https://{n}.example/") for i, n in enumerate("abc")],
        "construct string, mesh_ord int, mesh_name string, source_ord int, source_name string, source_url string",
    )
    got = fetch_meshes(sources, documents, None)
    assert {(r["source"]["name"], r["link"]) for r in got.entries.collect()} == {("a", "https://www.a.example/x"), ("b", "https://feeds.example/x")}
    assert [(r["ok_sources"], r["failed_sources"]) for r in got.health.collect()] == [(2, 1)]
    assert column(got.rejects, "key", None) == ["https://c.example/"]


def test_explicit_template_is_not_followed(spark):
    alt = '<link rel="alternate" type="application/rss+xml" href="/feed">'
    rss = "<rss><channel><item><title>x</title><link>/x</link></item></channel></rss>"
    mine = dict.fromkeys(TEMPLATE.fieldNames()) | {"item": ".note", "title": "h3", "link": "a"}
    rows = [("https://a.example/", alt + CARDS, "", tuple(mine.values())), ("https://a.example/feed", rss, "", None)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("final_url", "body", "content_type")] + [T.StructField("explicit_template", TEMPLATE)])
    out, _ = cascade.extract(spark.createDataFrame(rows, schema), None)
    assert {(r["source_url"], r["strategy"]) for r in out.collect()} == {("https://a.example/", "template"), ("https://a.example/feed", "feed")}


def test_proposal(spark):
    got = propose.propose_templates(docs(spark, CARDS)).first()
    assert (got["item"], got["title"], got["link"], got["date"], got["matched"], got["feedTitle"]) == ("li.note", "h3", "h3 a", "time", 2, "Blog & more")
    assert got["sample_titles"] == ["First & best", "Second"]
    anchors = '<a class="c" href="/1"><h3>One</h3></a><a class="c" href="/2"><h3>Two</h3></a>'
    got = propose.propose_templates(docs(spark, anchors)).first()
    assert (got["item"], got["title"], got["link"]) == ("a.c", "h3", None)
    assert propose.propose_templates(docs(spark, "<p>none</p>")).count() == 0


def test_definition_files(spark, tmp_path):
    mesh = {"name": "M", "sources": [{"name": "s", "url": "u"}]}
    for folder, name in (("one", "x.json"), ("one", "y.mesh.json"), ("two", "x.mesh.json"), ("one", "y.json")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(mesh))
    rows = definitions.read_meshes(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert sorted((r["name"], r["location_rank"]) for r in rows.collect()) == [("x", 1), ("x", 2), ("y", 0), ("y", 1)]
    (tmp_path / "c.json").write_text(json.dumps({"name": "C", "meshes": ["a", {"ref": "b"}, mesh]}))
    members = definitions.read_constructs(spark, str(tmp_path / "c.json")).orderBy("mesh_ord").collect()
    assert [(m["ref"], m["mesh"] and m["mesh"]["name"]) for m in members] == [("a", None), ("b", None), (None, "M")]
    (tmp_path / "taps").mkdir()
    (tmp_path / "taps" / "a.json").write_text(json.dumps([{"item": "i", "title": "t", "host": "h"}, {"item": "j", "title": "t"}]))
    (tmp_path / "taps" / "b.json").write_text(json.dumps({"item": "k", "title": "t", "host": "h"}))
    loaded = definitions.read_templates(spark, str(tmp_path / "taps"))
    assert column(loaded, "item", "load_ord") == ["i", "j", "k"]


def test_watch_remembers_only_what_it_emitted(spark, tmp_path):
    watch = Watch(str(tmp_path / "w"), sinks=["https://hooks.slack.com/x", "https://hook.example/"])
    (tmp_path / "state.json").write_text('["old"]')
    watch.import_seen(spark, str(tmp_path / "state.json"))
    batch = entries(spark, {"id": "a"}, {"id": "a"}, {"id": "old"}, {"id": "", "link": "l"})
    watch.tick(batch, 0)
    watch.tick(batch, 0)  # a replay finds its work done
    watch.tick(batch, 1)  # nothing new
    assert sorted(column(watch.emitted(spark), "key", None)) == ["a", "a", "l"]
    assert sorted(column(watch.seen(spark), "key", None)) == ["a", "l", "old"]
    assert sorted(column(watch.outbox(spark), "kind", None)) == ["slack", "webhook"]


def test_failing_sink_does_not_stop_the_others(spark, tmp_path, monkeypatch):
    watch = Watch(str(tmp_path / "w"), sinks=["https://bad.example/", "https://hooks.slack.com/x"])
    deliver = Watch.deliver

    def flaky(self, emitted, url, batch_id):
        if "bad" in url:
            raise OSError("down")
        deliver(self, emitted, url, batch_id)

    monkeypatch.setattr(Watch, "deliver", flaky)
    watch.tick(entries(spark, {"id": "a"}), 0)
    assert watch.failures == [(0, "https://bad.example/", "down")]
    assert watch.seen(spark).count() == 1


def test_proposals_scan_their_pages_once(spark):
    page = "<body>" + "".join(f'<article class="p"><h2><a href="/{i}">t{i}</a></h2></article>' for i in range(3)) + "</body>"
    out = propose.propose_templates(spark.createDataFrame([("https://h.example/", page, "text/html")], "final_url string, body string, content_type string"))
    assert "_scan_pages" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["item"], r["matched"]) for r in out.collect()] == [("article.p", 3)]


def test_plain_tags_are_read_as_the_parser_reads_them():
    """The quick path for plain tags gives the nodes and texts that the parser alone gives."""
    from html.parser import HTMLParser

    from feedspark.sources.markup import Page

    class Slow(Page):
        parse_starttag = HTMLParser.parse_starttag
        parse_endtag = HTMLParser.parse_endtag

    pages = [
        '<title>a <b>c</b></title><p class="x y" id="1">one<p>two<br/>three<a href="/u?a=1&amp;b">f</a>',
        '<script>if (a < b) { "<p>" }</script><style>p > a {}</style><textarea><b>no</b></textarea><i>x</i>',
        '<ul><li>1<li a="1" a="2">2</ul ><A HREF="/x">Up</A><a href=/y>bare</a></p></nothing><a href="/z',
        "<p title='q'>&lt;b&gt;</p><div hidden><h1>t</h1></div><!-- <p> --><section data-k=\"v\">z</section",
        '<p x="1"y="2">a</p><a  href="/two">b</a><svg:g a="">c</svg:g><h2\n class="n">d</h2>< p>e<3',
    ]
    shown = lambda page: ([(n.tag, n.attrs, n.index, n.end, page.text(n), n.parent and n.parent.index) for n in page.nodes], page.texts)
    for text in pages:
        assert shown(Page(text)) == shown(Slow(text))


def test_articles_are_read_once(spark):
    """The list of a page's articles stands once in the plan, and one link of all articles drops the page."""
    post = '<article><h2><a href="{}">t{}</a></h2></article>'
    pages = {
        "https://h.example/a": post.format("/1", 1) + post.format("/2", 2),
        "https://h.example/b": post.format("/1", 1) + post.format("https://h.example/1", 2),
        "https://h.example/c": post.format("/1", 1),
        "https://h.example/d": "<p>none</p>",
    }
    docs = spark.createDataFrame([(u, b) for u, b in pages.items()], "final_url string, body string")
    found = html.article_entries(html.scan_pages(docs))
    assert sorted((r["source_url"], r["title"]) for r in found.collect()) == [("https://h.example/a", "t1"), ("https://h.example/a", "t2")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count(" IN (h1") == 1


def test_batches_are_bounded_by_bytes(spark):
    """Short texts go to Python in large batches, long ones in small batches."""
    from feedspark.session import PYTHON_BYTES, spread

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], ["n", "size"])

    try:
        short = spread(spark.range(3000).selectExpr("cast(id as string) AS t")).coalesce(1)
        assert [r["n"] for r in short.mapInArrow(rows, "n bigint, size bigint").collect()] == [3000]
        long = spread(spark.range(40).selectExpr(f"repeat('x', {PYTHON_BYTES // 4}) AS t")).coalesce(1)
        assert max(r["size"] for r in long.mapInArrow(rows, "n bigint, size bigint").collect()) < 2 * PYTHON_BYTES
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
