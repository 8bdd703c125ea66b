"""Rule tables, search by trigrams, link chains and carried documents against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from feedspark.operators import filters, occurrences, rule_index, search
from feedspark.sources import cascade, raw
from helpers import at, entries

PATTERNS = [
    ("abc", "abc"), ("^Spark\\b", "Spark"), ("a+bcd", "bcd"), ("(abc)?def", ""), ("ab|cd", ""), ("(?x) a b", ""),
    ("colou?r", "colo"), ("[abc]def", "def"), ("[a[bc]defgh]x", ""), ("x{2}abcd", "abcd"), ("a.b.cde", "cde"),
    ("\\Qa.b\\E", ""), ("\\x41bc", ""), ("über straße", "ber stra"), ("", ""), ("\\d+ items", " items"), ("foo\\.bar", "foo"),
]


def test_required_pieces_of_expressions(spark):
    df = spark.createDataFrame(PATTERNS, "pattern string, want string")
    for r in df.select("pattern", "want", rule_index.required(F.col("pattern")).alias("got")).collect():
        assert r["got"] == r["want"], r["pattern"]


def plain_keeps(row, rules):
    texts = {"title": [row["title"]], "summary": [row["summary"] or ""], "source": [(row["source"] or {"name": ""})["name"] or ""], "author": [" ".join(a["name"] for a in row["authors"] or [])], "tag": row["tags"] or []}
    hit = lambda r: any(re.search(r[2], t, re.I) if r[3] else r[2].lower() in t.lower() for t in texts[r[1]])
    wanted = [r for r in rules if r[0] == "include"]
    return (not wanted or any(map(hit, wanted))) and not any(hit(r) for r in rules if r[0] == "exclude")


@pytest.mark.parametrize("kinds", [["include", "exclude"], ["exclude"], []])
def test_rules_tables(spark, kinds):
    rand = random.Random(4)
    word = lambda: "".join(rand.choice("abcÉ😀 ") for _ in range(rand.randrange(0, 9)))
    rows = entries(
        spark,
        *[{"title": word(), "summary": rand.choice([None, word()]), "tags": rand.choice([None, [], [word(), word()]]), "authors": rand.choice([None, [(word(), None, None)]]), "source": rand.choice([None, (word(), None)])} for _ in range(120)],
    ).withColumn("rule", F.lit("clash"))
    pattern = lambda: rand.choice([word()[:4], "", "[ab]c", "a+b", "^b", "bca?", "É", "abc"])
    rules = [(rand.choice(kinds), rand.choice(filters.FIELDS), p, p in ("[ab]c", "a+b", "^b", "bca?")) for p in (pattern() for _ in range(14 if kinds else 0))]
    rules = [r for r in rules if r[2] or r[0] == "include"]
    table = spark.createDataFrame(rules, "kind string, field string, pattern string, regex boolean")
    got = filters.filter_by_rules_table(rows, table)
    assert got.columns == rows.columns
    want = [r["entry_ord"] for r in rows.collect() if plain_keeps(r, rules)]
    assert sorted(r["entry_ord"] for r in got.collect()) == want


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).select(
        F.when(F.col("id") % 10 == 9, "exclude").otherwise("include").alias("kind"),
        F.lit("title").alias("field"),
        F.concat(F.lit("Rule "), F.col("id").cast("string"), F.lit(";")).alias("pattern"),
        F.lit(False).alias("regex"),
    )
    rows = entries(spark, {"title": "see rule 7; now"}, {"title": "rule 19;"}, {"title": "rule 100000;"}, {"title": "rule 5; rule 99999;"}, {"title": "rule 123"})
    assert [r["entry_ord"] for r in filters.filter_by_rules_table(rows, rules).collect()] == [0]


def test_search(spark, tmp_path):
    texts = ["", "ab", "abc abd", "xabcab", "éa😀b", "a b c", "abcabcabc", "zab"]
    queries = ["abc", " ABC ", "ab", "", "a", "😀b", "éa😀", "bca", "zzz", "c a"]
    hay = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    asked = spark.createDataFrame([(q,) for q in [*queries, "abc"]], "query string")
    want = {(q, i) for q in queries for i, t in enumerate(texts) if q.strip().lower() in t}
    rows = [tuple(r) for r in search.search(hay, asked).collect()]
    assert len(rows) == len(want) and set(rows) == want
    search.save_postings(hay, str(tmp_path / "p"))
    assert {tuple(r) for r in search.search(hay, asked, spark.read.parquet(str(tmp_path / "p"))).collect()} == want


def test_long_needles_are_hashed_where_short_beginnings_stand(spark, monkeypatch):
    """Each place of a text is hashed about once, not once for each size of needles, and all needles are found."""
    import numpy as np
    import pyarrow as pa

    rand = random.Random(9)
    word = lambda size: "".join(rand.choice("abcdefgh ") for _ in range(size))
    asked = [word(size) for size in (4, 9, 17, 33, 70, 300) for _ in range(20)]
    texts = [word(500) + asked[k] + word(500) for k in range(len(asked))] + ["", "ab"]
    hay = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    kept, real = {}, occurrences._scan
    monkeypatch.setattr(occurrences, "_scan", lambda filters, keys, once: kept.setdefault("task", real(filters, keys, once)))
    needles = spark.createDataFrame([(n,) for n in asked], "needle string")
    got = {(r["row"], r["needle"]) for r in occurrences.held(hay, ["row"], needles).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in asked if n in t}
    counted, hashed = [], occurrences._Hashes.at
    monkeypatch.setattr(occurrences._Hashes, "at", lambda *a: counted.append(len(got_ := hashed(*a))) or got_)
    batch = pa.record_batch({"row": pa.array(range(len(texts))), "text": texts, "salt": pa.array(np.zeros(len(texts), np.int64))})
    assert sum(b.num_rows for b in kept["task"]([batch])) >= len(got)
    assert sum(counted) < 2 * sum(map(len, texts))


def plain_chain(pages, origin, most):
    """The pages met from an origin; without a limit, each once."""
    at_, met, best = origin, [origin], None
    if pages[origin][1]:
        best = origin
    while most is None or len(met) <= most:
        to = pages[at_][0]
        if to is None or to == at_ or to not in pages or (most is None and to in met):
            break
        met.append(to)
        at_ = to
        if pages[to][1]:
            best = to
    return len(met) - 1, best


@pytest.mark.parametrize("most", [0, 1, 3, 6, None])
def test_link_chains(spark, most):
    rand = random.Random(9)
    pages = {f"p{k}": [f"p{k + 1}", rand.choice([None, None, "o"])] for k in range(30)}
    pages["p29"][0] = None
    pages |= {f"c{k}": [f"c{(k + 1) % 7}", "o" if k in (2, 5) else None] for k in range(7)}
    pages |= {f"t{k}": [f"t{k + 1}" if k < 20 else "c3", "o" if k == 4 else None] for k in range(21)}
    pages |= {"self": ["self", "o"], "gone": ["nowhere", None], "null": [None, "o"], "e0": ["e1", None], "e1": ["e0", None], "r": ["e0", "o"]}
    pages |= {f"x{k}": [f"x{rand.randrange(25)}", rand.choice([None, "o"])] for k in range(25)}
    df = spark.createDataFrame([(u, n, o) for u, (n, o) in pages.items()], "source_url string, feed_url string, outcome string")
    got = {r["origin"]: (r["hops"], r["source_url"]) for r in cascade.follow_links(df, most).collect()}
    assert got == {u: plain_chain(pages, u, most) for u in pages}


def test_carried_documents_of_many_snapshots(spark):
    schema = "requested_url string, final_url string, content_type string, body string, etag string, last_modified string, http_status int, snapshot_ts timestamp"
    when = lambda h: at(f"2024-01-01T{h:02d}:00:00")
    stored = [("u", "f", "t", f"body {h}", f"e{h}", None, 200, when(h)) for h in (1, 3, 5)] + [("u", "f", "t", None, None, None, 500, when(4)), ("u", "f", "t", "late", "z", None, 200, None), ("w", "f", "t", "w1", "a", None, 200, when(1)), ("w", "f", "t", "w2", "b", None, 200, when(1))]
    asked = [("u", None, None, None, None, None, 304, when(h)) for h in (0, 1, 2, 4, 9)] + [(None, None, None, None, None, None, 304, when(2)), ("v", None, None, None, None, None, 304, when(2)), ("u", "n", "t", "new", "e", None, 200, when(2)), ("w", None, None, None, None, None, 304, when(1)), ("u", None, None, None, None, None, 304, when(9))]
    out = raw.carry_forward(spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema))
    got = sorted(((r["requested_url"], r["snapshot_ts"].hour, r["http_status"], r["body"], r["carried"]) for r in out.collect()), key=str)
    want = [("u", h, 304, b, b is not None) for h, b in ((0, None), (1, "body 1"), (2, "body 1"), (4, "body 3"), (9, "body 5"), (9, "body 5"))]
    want += [("u", 2, 200, "new", False), (None, 2, 304, None, False), ("v", 2, 304, None, False), ("w", 1, 304, "w2", True)]
    assert got == sorted(want, key=str)


def test_planning_of_cycles_does_not_grow_with_the_rounds(spark):
    """Tails into rings of 16, rings of 23 and open ends; rounds over checkpoints took minutes of planning."""
    n, size = 23 * 2175, 23
    key, turn = F.col("id"), F.floor(F.col("id") / size) % 3
    url = lambda k: F.concat(F.lit("u"), k.cast("string"))
    pages = spark.range(n).select(
        url(key).alias("source_url"),
        F.when(key % size < size - 1, url(key + 1)).when(turn == 0, url(key - 15)).when(turn == 2, url(key - (size - 1))).alias("feed_url"),
        F.when(key % 4 == 0, "o").alias("outcome"),
    )
    start = time.monotonic()
    got = cascade.follow_links(pages, None).agg(F.count("*"), F.sum("hops"), F.count("strategy")).first()
    tail, ring, straight = sum(range(16, 23)) + 16 * 15, 23 * 22, sum(range(23))
    assert tuple(got)[:2] == (n, n // size // 3 * (tail + ring + straight)) and got[2] > 0
    assert time.monotonic() - start < 90


def test_occurrences_are_those_of_a_plain_search(spark):
    """What is found is what is there, though all needles share their rarest trigrams."""
    from feedspark.operators import occurrences

    rand = random.Random(5)
    texts = ["", "a", None] + ["".join(rand.choice("abé😀 ") for _ in range(rand.randrange(1, 300))) for _ in range(60)]
    texts += [f"signup user {k} of user {k * 7 % 500}" for k in range(300)]
    needles = {t[i : i + n] for t in texts[3:63] for i, n in [(rand.randrange(len(t)), rand.randrange(1, 200))]} | {f"user {k} of" for k in range(100, 400)} | {"none of these", "😀"}
    hay = spark.createDataFrame([(i, "x" if i % 2 else "y", t) for i, t in enumerate(texts)], "row long, side string, text string")
    asked = spark.createDataFrame([(n, s) for n in needles for s in ("x", "z")], "needle string, side string")
    want = {(i, n) for i, t in enumerate(texts) for n in needles if t and n in t}
    plain = asked.filter("side = 'x'").drop("side")
    found = [tuple(r) for r in occurrences.held(hay, ["row"], plain).select("row", "needle").collect()]
    assert len(found) == len(want) and set(found) == want
    grouped = [tuple(r) for r in occurrences.held(hay, ["row", "side"], asked, F.col("side")).select("row", "needle").collect()]
    assert len(grouped) == len(set(grouped)) and set(grouped) == {w for w in want if w[0] % 2}
    once = [tuple(r) for r in occurrences.held(hay, ["row"], plain, once=True).select("row", "needle").collect()]
    # A false hit may take the place of a true one, so a few texts are left to be tried again.
    assert len(once) == len({r for r, _ in once}) > 200 and set(once) <= want


def test_expressions_with_letters_folded_otherwise(spark):
    rules = spark.createDataFrame([("include", "title", "spar[a-z]*iti ks", True), ("exclude", "title", "no[a-z]+ones", True)], "kind string, field string, pattern string, regex boolean")
    rows = entries(spark, {"title": "ſparkıti Ks"}, {"title": "SPARkiti KS, nobones"}, {"title": "spariti ks none"}, {"title": "park iti ks"})
    got = filters.filter_by_rules_table(rows, rules)
    want = filters.filter_entries(rows, filters.parse_spec(["title:/spar[a-z]*iti ks/"], ["title:/no[a-z]+ones/"]))
    assert sorted(r["entry_ord"] for r in got.collect()) == sorted(r["entry_ord"] for r in want.collect()) == [0, 2]
