import json
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedspark.plans import views
from feedspark.plans.extraction import BROKEN
from feedspark.sinks import assemble, compact, formats, jsonfeed, markdown, payloads, xmlfeeds
from feedspark.sources import compact as compact_source
from feedspark.sources import dispatch, opml, raw
from helpers import at, column, docs, entries, feed

SF_DIR = "/root/testdata/sf0.001"
AUTHORS = [("Ann", "https://ann.example", "a@x.org"), ("Bo", None, None)]


@pytest.fixture(scope="module")
def rich(spark):
    rows = entries(
        spark,
        {"title": "A & <B>", "published": at("2024-01-02T10:00:00"), "updated": at("2024-01-03T10:00:00"), "summary": "tab\there\nand \\ there", "authors": AUTHORS, "tags": ["x", "y"], "source": ("S", "https://s.example/")},
        {"title": "second", "link": "https://other.example/q", "tags": ["y"], "source": ("S", None)},
        {"id": "https://h.example/2", "title": "third", "updated": at("2023-12-31T23:59:59"), "authors": AUTHORS[:1]},
    )
    return feed(spark, home="https://h.example/", self="https://h.example/self", authors=AUTHORS[:1], generator=("gen", "1")), rows


def as_docs(written):
    return written.select(F.lit("https://h.example/feed").alias("final_url"), "body", F.lit("").alias("content_type"))


def read(fmt, written):
    return dispatch.read_feeds(as_docs(written), (fmt,))


def test_compact_round_trip(rich):
    feeds, rows, _ = compact_source.read_compact(as_docs(compact.write_compact(*rich)))
    got = rows.orderBy("entry_ord").collect()
    want = rich[1].orderBy("entry_ord").collect()
    for g, w in zip(got, want):
        for name in ("id", "title", "link", "summary", "authors", "tags", "source"):
            assert g[name] == w[name], name
        assert g["updated"] == (w["updated"] or w["published"])
    head = feeds.first()
    assert head["authors"] == rich[0].first()["authors"]
    assert (head["feed_id"], head["home"], head["self"]) == ("f", "https://h.example/", "https://h.example/self")


def test_compact_text(rich):
    lines = compact.write_compact(*rich).first()["body"].split("\n")
    assert lines[0] == "NWF1"
    assert lines[1] == "F\tf\tFeed\thttps://h.example/\thttps://h.example/self\t1704164645\t0"
    assert lines[2] == "A\tAnn\x1fhttps://ann.example\x1fa@x.org\tBo"
    assert lines[3] == "T\tx\ty"
    assert lines[4] == "S\tS\x1fhttps://s.example/\tS"
    assert lines[5].split("\t") == ["E", "id0", "-111355", "https://h.example/0", "0,1", "0,1", "A & <B>", "tab\\there\\nand \\\\ there", "0"]
    assert lines[6].split("\t")[2] == "-" and lines[6].split("\t")[-1] == "1"
    assert lines[-1] == ""


def shuffles_of(df, column):
    """How many shuffles carry a column, as planned without broadcasts that only small tables get."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return len(re.findall(rf"\) Exchange\nInput \[\d+\]: \[[^\]]*\b{column}#", text))


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compact_writing_shuffles_texts_for_references_alone(rich, no_small_tables):
    assert shuffles_of(compact.write_compact(*rich), "summary") == 1


def test_compact_reading_shuffles_lines_once(rich, no_small_tables):
    _, rows, _ = compact_source.read_compact_parts(compact.write_compact(*rich))
    assert shuffles_of(rows, "line") + shuffles_of(rows, "cells") == 1


def test_links_need_no_shuffled_texts(spark, no_small_tables):
    assert shuffles_of(views.entries(spark, SF_DIR).select("feed_id", "link"), "text") == 0


def test_compact_bad_references_are_dropped(spark):
    text = "NWF1\nF\tid\tt\t\t\t100\t5\nA\tann\nB\thttps://b.example/\nE\te\t-5\t~x\t0,7,z\t1\ttitle\ts\t9\nZ\t?\n"
    feeds, rows, rejects = compact_source.read_compact(docs(spark, text, "NWF2\n"))
    row = rows.first()
    assert (row["link"], [a["name"] for a in row["authors"]], row["tags"], row["source"]) == ("https://b.example/x", ["ann"], None, None)
    assert row["updated"].timestamp() == 105
    assert feeds.first()["authors"] is None
    assert rejects.count() == 1


@pytest.mark.parametrize("k", range(len(BROKEN)))
def test_compact_validation(spark, k):
    lines, want = BROKEN[k]
    issues = compact_source.validate_compact(docs(spark, "\n".join(lines) + "\n"))
    got = [tuple(r) for r in issues.select("line", "severity", "rule", "message").collect()]
    assert sorted(got) == sorted(want)


def test_rss_reading(spark):
    body = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/">
    <channel><title>C &hellip;</title><link>https://c.example/</link><pubDate>Wed, 02 Oct 2024 13:00:00 GMT</pubDate><managingEditor>ed</managingEditor>
    <item><title>One</title><link>/one</link><guid isPermaLink="false"> g1 </guid><dc:date>2024-01-02</dc:date><category>a</category><category> </category><category>b</category>
      <content:encoded><![CDATA[<p>Hi <b>there</b></p>]]></content:encoded></item>
    <item><guid>https://c.example/two</guid><dc:creator>x</dc:creator><dc:creator>y</dc:creator><title>a</title><title>b</title></item>
    </channel></rss>"""
    feeds, rows, rejects = dispatch.read_feeds(docs(spark, body))
    one, two = rows.orderBy("entry_ord").collect()
    assert (one["id"], one["link"], one["summary"], one["tags"]) == ("g1", "https://h.example/one", "Hi there", ["a", "b"])
    assert one["published"].isoformat() == "2024-01-02T00:00:00"
    assert (two["link"], two["title"], two["authors"]) == ("https://c.example/two", "Untitled", None)
    head = feeds.first()
    assert (head["title"], head["feed_id"], head["authors"][0]["name"]) == ("C …", "https://c.example/", "ed")
    assert rejects.count() == 0


def test_atom_reading(spark):
    body = """<feed xmlns="http://www.w3.org/2005/Atom"><id>f</id><title type="text">T</title><link rel="self" href="https://me"/><link href="https://home"/>
    <entry><id>e1</id><title>x</title><link rel="enclosure" href="/enc"/><link href="/alt"/><author><name>N</name><uri>u</uri></author><author><email>e</email></author>
      <category term="t1" label="z"/><category>t2</category><summary type="html">&lt;i&gt;S&lt;/i&gt;</summary><updated>2024-01-01T00:00:00Z</updated></entry>
    <entry><id>/only-id</id></entry></feed>"""
    feeds, rows, _ = dispatch.read_feeds(docs(spark, body))
    one, two = rows.orderBy("entry_ord").collect()
    assert (one["link"], one["tags"], one["summary"]) == ("https://h.example/alt", ["t1", "t2"], "S")
    assert [(a["name"], a["url"], a["email"]) for a in one["authors"]] == [("N", "u", None), ("Unknown", None, "e")]
    assert (two["link"], two["title"]) == ("https://h.example/only-id", "Untitled")
    assert (feeds.first()["home"], feeds.first()["self"]) == ("https://home", "https://me")


def test_json_reading(spark):
    body = '{"version":"https://jsonfeed.org/version/1.1","title":"J","author":{"name":"solo"},"items":[{"id":7,"external_url":"/e","content_html":"<p>h</p>","authors":[{"name":""},{"name":"A","url":"u"}],"tags":[]},{"id":"x","url":"/u","title":"","summary":"","content_text":"t"}]}'
    feeds, rows, _ = dispatch.read_feeds(docs(spark, body))
    one, two = rows.orderBy("entry_ord").collect()
    assert (one["id"], one["link"], one["summary"], one["title"], one["tags"]) == ("7", "https://h.example/e", "h", "Untitled", None)
    assert [a["name"] for a in one["authors"]] == ["A"]
    assert (two["title"], two["summary"]) == ("", None)
    assert feeds.first()["authors"][0]["name"] == "solo"


def test_rejects(spark):
    _, rows, rejects = dispatch.read_feeds(docs(spark, "hello", "{broken", "<rss><channel><item>", "<html></html>"))
    assert sorted(column(rejects, "reason", None)) == ["not a JSON document", "not well-formed", "unrecognized feed format", "unrecognized feed format"]
    assert rows.count() == 0


def test_atom_round_trip(rich):
    _, rows, _ = read("atom", xmlfeeds.write_atom(*rich))
    got = rows.orderBy("entry_ord").collect()
    assert [r["title"] for r in got] == ["A & <B>", "second", "third"]
    assert got[0]["summary"] == "tab here and \\ there"
    assert got[1]["updated"] == rich[0].first()["updated"]


def test_rss_permalink_and_source(rich):
    body = xmlfeeds.write_rss(*rich).first()["body"]
    assert body.count('isPermaLink="true"') == 1
    assert body.count("<source url=") == 1
    assert 'xmlns:dc="http://purl.org/dc/elements/1.1/"' in body


def test_json_of_an_empty_feed(spark):
    body = jsonfeed.write_jsonfeed(feed(spark), entries(spark).limit(0)).first()["body"]
    assert body == '{\n  "version": "https://jsonfeed.org/version/1.1",\n  "title": "Feed",\n  "items": []\n}\n'


def test_markdown_of_bare_entries(spark):
    body = markdown.write_markdown(feed(spark), entries(spark, {})).first()["body"]
    assert body == "# Feed\n\nUpdated 2024-01-02\n\n### [t0](https://h.example/0)\n"


@pytest.mark.parametrize("fmt", formats.FORMATS)
def test_large_feeds_come_in_parts(spark, rich, fmt, monkeypatch):
    rows = entries(spark, *[{"tags": [f"t{i % 5}"], "summary": f"s{i} é"} for i in range(57)])
    whole = formats.serialize(rich[0], rows, fmt).first()
    monkeypatch.setattr(assemble, "PART_BYTES", 300)
    parts = formats.serialize(rich[0], rows, fmt).orderBy("part_no").collect()
    assert len(parts) > 5
    assert "".join(p["body"] for p in parts) == whole["body"]
    assert (parts[0]["media_type"], parts[0]["extension"]) == (formats.MEDIA_TYPES[fmt], formats.EXTENSIONS[fmt])
    again = assemble.whole(formats.serialize(rich[0], rows, fmt)).first()
    assert again["body"] == whole["body"]


@pytest.fixture(scope="module")
def long_feed(spark):
    """120,000 entries, with letters of one to four bytes and breaks inside fields."""
    n, k = F.col("id"), F.col("id").cast("string")
    given = spark.range(120_000).select(
        F.lit("f/ö").alias("feed_id"),
        (n % 3).cast("int").alias("part_ord"),
        n.alias("entry_ord"),
        F.concat(F.lit("urn:"), k).alias("id"),
        F.concat(F.lit("Title é😀 "), k).alias("title"),
        F.concat(F.lit("https://h.example/"), k).alias("link"),
        F.lit(None).cast("timestamp").alias("published"),
        F.timestamp_seconds(n + 1_700_000_000).alias("updated"),
        F.when(n % 2 == 0, F.concat(F.lit("first\n\tsecond "), k)).alias("summary"),
        F.array(F.struct(F.concat(F.lit("a"), (n % 700).cast("string")).alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("email"))).alias("authors"),
        F.when(n % 5 != 0, F.array(F.concat(F.lit("t"), (n % 11).cast("string")), F.lit("all"))).alias("tags"),
        F.struct(F.lit("S").alias("name"), F.lit("https://s.example/").alias("url")).alias("source"),
    )
    return feed(spark, feed_id="f/ö"), given


@pytest.mark.parametrize("fmt", formats.FORMATS)
def test_documents_of_any_size_are_files_and_read_back(spark, long_feed, fmt, tmp_path):
    feeds, given = long_feed
    whole_feed = fmt in ("nwf", "json")
    parts = formats.serialize(feeds, given if whole_feed else given.filter("entry_ord < 12000"), fmt)
    rows = parts.orderBy("part_no").collect()
    bound = max(len(r["body"].encode()) for r in rows)
    assert len(rows) > (100 if whole_feed else 10) and bound <= assemble.PART_BYTES + 1000 * (20 if fmt == "nwf" else 1)
    body = "".join(r["body"] for r in rows)
    formats.save(parts, str(tmp_path))
    files = [p for p in tmp_path.iterdir() if p.is_file()]
    assert [p.name for p in files] == [f"f%2F%C3%B6.{formats.EXTENSIONS[fmt]}"]
    assert files[0].read_text(encoding="utf-8") == body
    read = formats.load(spark, str(tmp_path), part_bytes=1 << 16)
    assert assemble.whole(read).first()["body"] == body
    assert read.select("feed_id").distinct().collect()[0][0] == "f/ö"


def test_compact_documents_of_any_size_read_back_by_lines(spark, long_feed, tmp_path):
    feeds, given = long_feed
    written = formats.serialize(feeds, given, "nwf")
    formats.save(written, str(tmp_path))
    read = formats.load(spark, str(tmp_path), part_bytes=1 << 14)
    got_feeds, got, rejects = compact_source.read_compact_parts(read)
    assert rejects.count() == 0 and got_feeds.first()["authors"] is None
    names = ["id", "title", "link", "updated", "summary", "authors", "tags", "source"]
    ordered = given.withColumn("entry_ord", F.row_number().over(Window.orderBy("part_ord", "entry_ord")) - 1)
    assert got.count() == 120_000
    want = ordered.select("entry_ord", *names)
    assert got.select(F.col("entry_ord").cast("int"), *names).exceptAll(want).count() == 0


def test_both_compact_readers_agree(spark, rich):
    feeds, rows = rich
    written = formats.serialize(feeds, rows, "nwf")
    broken = spark.createDataFrame([("bad", 0, "NWF2\n"), ("odd", 0, "NWF1\nT\tx\nT\ty\tz\nE\ti\tq\t~l\t9,z\t1,0,7\ttitle\nE"), ("empty", 0, "")], "feed_id string, part_no int, body string")
    parts = written.select("feed_id", "part_no", "body").unionByName(broken)
    small = parts.select("feed_id", F.posexplode(F.split(F.regexp_replace("body", "(?s)(.{7})", "$1\0"), "\0")).alias("part_no", "body"))
    docs_ = parts.select(F.col("feed_id").alias("final_url"), "body")
    for one, two in zip(compact_source.read_compact(docs_), compact_source.read_compact_parts(small), strict=True):
        two = two.select(*[F.col(c).cast(one.schema[c].dataType) for c in one.columns])
        assert one.count() == two.count() and one.exceptAll(two).count() == 0


def test_parts_that_are_out_of_place_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("f", 0, "a", "md"), ("g", 0, "b", "md"), ("f", 1, "c", "md")], "feed_id string, part_no long, body string, extension string")
    spark.dataSource.register(formats.FeedFiles)
    with pytest.raises(Exception, match="not together"):
        rows.coalesce(1).write.format(formats.NAME).mode("overwrite").save(str(tmp_path))
    assert [p for p in tmp_path.iterdir() if p.is_file()] == []


def test_unknown_format(spark, rich):
    assert not formats.is_format("pdf")
    with pytest.raises(ValueError):
        formats.serialize(*rich, "pdf")


def test_each_feed_in_its_own_format(rich):
    feeds, rows = rich
    names = [*formats.FORMATS, "pdf", None]
    wanted = F.explode(F.array(*[F.lit(n) for n in names]))
    ids = F.concat("feed_id", F.lit("-"), F.coalesce("format", F.lit("none")))
    many = feeds.withColumn("format", wanted).withColumn("feed_id", ids)
    given = rows.withColumn("format", wanted).withColumn("feed_id", ids).drop("format")
    documents, rejects = formats.serialize_by(many, given)
    got = {(r["feed_id"], r["part_no"]): (r["format"], r["extension"], r["body"]) for r in documents.collect()}
    want = {}
    for fmt in formats.FORMATS:
        own = lambda df: df.filter(F.col("feed_id").endswith("-" + fmt))  # noqa: B023, E731
        for r in formats.serialize(own(many).drop("format"), own(given), fmt).collect():
            want[r["feed_id"], r["part_no"]] = (fmt, r["extension"], r["body"])
    assert got == want and {v[0] for v in got.values()} == set(formats.FORMATS)
    reasons = sorted((r["key"].rsplit("-", 1)[1], r["reason"]) for r in rejects.collect())
    assert reasons[0] == ("none", 'unknown format ""') and reasons[-1] == ("pdf", 'unknown format "pdf"')


def test_opml_reading(spark):
    nested = '<opml><head><title><![CDATA[My list]]></title></head><body><outline text="Cat"><outline text=" A " xmlUrl="https://a.example/f"/><outline title="B" xmlUrl="u2"/></outline><outline xmlUrl="https://c.example/f"/></body></opml>'
    sources, rejects = opml.read_opml(docs(spark, nested, "<opml", "<html/>", "<opml><body/></opml>"))
    rows = sources.filter("source_ord >= 0").orderBy("source_ord").collect()
    assert [(r["mesh_name"], r["source_name"]) for r in rows] == [("My list", "A"), ("My list", "B"), ("My list", "c.example")]
    assert rejects.count() == 2
    assert column(sources.filter("source_ord < 0"), "mesh_name", None) == ["imported"]


def test_kinds(spark):
    cases = [("application/atom+xml", "x", "atom"), ("text/xml", "<RSS>", "rss"), ("application/json", '{"items":[]}', "jsonfeed"), ("", ' {"a":1}', "html"), ("text/html", "<p>jsonfeed.org", "jsonfeed"), ("", "<rdf:RDF", "rdf"), ("", " " * 2000 + "<rss>", "html")]
    df = spark.createDataFrame(cases, "ct string, body string, want string")
    for row in df.select("want", raw.detect_kind(F.col("ct"), F.col("body")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_messages(spark):
    rows = entries(spark, *[{} for _ in range(12)])
    body = {r["kind"]: r["body"] for r in payloads.chat_payloads(feed(spark), rows).collect()}
    assert body["slack"].startswith('{"text":"Feed: 12 new\\n• t0 - https://h.example/0\\n')
    assert body["slack"].endswith('…and 2 more"}')
    long = entries(spark, *[{"title": "x" * 400} for _ in range(9)])
    content = {r["kind"]: r["body"] for r in payloads.chat_payloads(feed(spark), long).collect()}["discord"]
    assert len(content) == len('{"content":""}') + 2000 + content.count("\\n")
    assert payloads.webhook_payloads(feed(spark), rows.limit(0)).count() == 0


def test_a_webhook_body_is_one_document(spark, monkeypatch):
    monkeypatch.setattr(assemble, "PART_BYTES", 500)
    rows = entries(spark, *[{} for _ in range(25)])
    parts = payloads.webhook_payloads(feed(spark), rows)
    assert parts.count() > 3 and {r["content_type"] for r in parts.collect()} == {"application/feed+json"}
    read = json.loads(assemble.whole(parts).first()["body"])
    assert read["title"] == "Feed" and [i["id"] for i in read["items"]] == [f"id{k}" for k in range(25)]


def test_kept_documents_are_parsed_once(spark):
    given = docs(spark, "hello", '{"version":"https://jsonfeed.org/version/1","title":"t","items":[{"id":"1","url":"u","title":"x"}]}')
    feeds, rows, rejects = dispatch.read_feeds(given, keep=True)
    for df in (feeds, rows, rejects):
        assert "from_json" not in df._jdf.queryExecution().executedPlan().toString().lower()
    assert (feeds.count(), rows.count(), rejects.count()) == (1, 1, 1)
