"""The operators on small tables of awkward rows, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedspark.llm import brown_lm, chat, decontam, langmix, linkgraph, ngram_join, packing, pii, quality, toxicity
from feedspark.llm.common import table, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
PROSE = "the cat sat on the mat and it was a good day for all of us in the old house by the sea with no end"
LONG = " ".join(f"word{k} of the house" for k in range(5000))
ROWS = [
    (1, PROSE, "en"),
    (2, PROSE, "en"),
    (2, PROSE, "en"),
    (3, PROSE + " again", "en"),
    (4, None, None),
    (5, "", "en"),
    (6, " \t\n ", "en"),
    (7, "one two", "en"),
    (8, LONG, "en"),
    (None, "ein kleines Haus steht am Meer und der Wind weht über das weite Land", "de"),
    (9, "ein kleines Haus steht am Meer und der Wind weht über das weite Land", None),
]
CLASHING = ["n_words", "kept", "row", "spans", "sig", "row_key", "score", "host", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return rows.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain_words(text):
    return [w for w in re.split(r"[ \t-\r]+", text or "") if w]


def test_quality(docs, none):
    got = quality.judged(docs).select("doc_id", "text", "n_words", "word_chars", "n_repeat_words", "kept").collect()
    assert len(got) == len(ROWS)
    for row in got:
        ws = plain_words(row["text"])
        seen = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        covered = {k + j for k in range(len(ws) - 7) if seen[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        assert (row["n_words"], row["word_chars"]) == (len(ws), sum(map(len, ws)))
        assert row["n_repeat_words"] == len(covered)
        assert row["kept"] == (len(ws) >= 20)
    assert quality.judged(none).count() == 0
    assert quality.passed(docs).columns == docs.columns


def test_repeated_windows(spark):
    text = " ".join(f"a{k}" for k in range(30)) + " x " + " ".join(f"a{k}" for k in range(12))
    docs = spark.createDataFrame([(1, text), (2, "go " * 50)], "doc_id bigint, text string")
    got = dict(quality.judged(docs).select("doc_id", "n_repeat_words").collect())
    assert got == {1: 24, 2: 50}


def plain_decontam(texts, items):
    """Every pair above the thresholds, by trying all places of every item in every text."""

    def reach(agree):
        score = best = at = 0
        for n, one in enumerate(agree, 1):
            score += 1 if one else -1
            if score > best:
                best, at = score, n
            if score < best - decontam.DROP:
                break
        return at

    out = {}
    for doc, text in texts.items():
        for name, item in items.items():
            tokens, sought = ([w for w in re.split(r"[\W_]+", t.lower()) if w] for t in (text, item))
            fixed = [m for m in decontam.MASKS if len(m) <= len(sought)] or ["1" * len(sought)]
            found, aligned = [], 0
            for start in range(1 - len(sought), len(tokens)):
                same = lambda k: 0 <= start + k < len(tokens) and tokens[start + k] == sought[k]  # noqa: B023, E731
                lo, hi = max(0, -start), min(len(sought), len(tokens) - start)
                agree = {k: same(k) for k in range(lo, hi)}
                ends = []
                for at in range(lo, hi):
                    for mask in fixed:
                        if at + len(mask) <= hi and all(agree[at + j] for j, bit in enumerate(mask) if bit == "1"):
                            left = reach(agree[k] for k in range(at - 1, lo - 1, -1))
                            ends.append((at - left, at + len(mask) - 1 + reach(agree[k] for k in range(at + len(mask), hi))))
                if ends:
                    aligned = max(aligned, sum(agree.values()))
                for begin, end in {*ends}:
                    if not any(b <= begin and end <= e and (b, e) != (begin, end) for b, e in ends):
                        found.append((start + begin, start + end, begin, end, [k for k in range(begin, end + 1) if agree[k]]))
            if not found:
                continue
            matched = max(aligned, len({k for x in found for k in x[4]}))
            longest, chain = 0, None
            for x in sorted(found):
                near = chain and x[0] <= chain[0] + decontam.GAP + 1 and x[2] <= chain[1] + decontam.GAP + 1
                chain = (max(chain[0], x[1]), max(chain[1], x[3]), chain[2] | {*x[4]}) if near else (x[1], x[3], {*x[4]})
                longest = max(longest, len(chain[2]))
            enough = matched / len(sought) >= decontam.MIN_SHARE and matched >= min(len(sought), decontam.MIN_TOKENS)
            if enough or longest >= decontam.OVERLAP:
                out[doc, name] = matched
    return out


def test_decontam_against_all_places(spark):
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    items = {k: " ".join(rng.choices(words, k=rng.choice([2, 6, 9, 14, 25, 60]))) for k in range(25)}
    texts = {}
    for k in range(60):
        own = rng.choice(list(items.values())).split()
        lo = rng.randrange(len(own))
        part = [w if rng.random() > 0.12 else rng.choice(words) for w in own[lo // 2 : len(own) - lo // 3]]
        for _ in range(rng.randrange(3)):
            part.insert(rng.randrange(len(part) + 1), rng.choice(words))
        texts[k] = " ".join(rng.choices(words, k=rng.randrange(30)) + part + rng.choices(words, k=rng.randrange(30)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    tested = spark.createDataFrame([*items.items(), *items.items()], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in decontam.contaminated(docs, tested).collect()}
    assert got == plain_decontam(texts, items) and len(got) > 20


def test_decontam_of_a_long_item(spark):
    item = [f"w{k * 7919 % 5003}" for k in range(8000)]
    changed = ["zz" if k % 37 == 0 else w for k, w in enumerate(item)]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    rows = [(1, "x y z " + " ".join(changed)), (2, " ".join(item[100:140])), (3, "nothing of it")]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()
    assert {r["doc_id"] for r in got} == {1, 2}


def brute_components(rows):
    def grams(text):
        ws = plain_words((text or "").lower())
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    sets = [(i, grams(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(sets, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), least.get(g)) for (i, s), g in zip(sets, group, strict=True)), key=str)


def test_ngram_join(docs, none):
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == brute_components([(i, t) for i, t, _ in ROWS])
    assert ngram_join.jaccard_components(none).count() == 0


def test_ngram_join_of_altered_copies(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 60, 3)]
    rows += [(100 + k, " ".join(base[:20] + [f"y{k}{j}" for j in range(4 * k)])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == brute_components(rows)


def join_rows(df, key):
    """Rows that the joins on a column make."""

    def walk(node):
        name = node.nodeName()
        if "Join" in name and f"[{key}#" in node.simpleString(1000):
            yield node.metrics().apply("numOutputRows").value()
        children = node.children()
        for k in range(children.size()):
            yield from walk(children.apply(k))

    df.collect()
    return sum(walk(df._jdf.queryExecution().executedPlan()))


def test_ngram_join_makes_no_pairs_of_all_near_copies(spark, monkeypatch):
    base, draw = [f"w{k}" for k in range(100)], random.Random(7)
    rows = []
    for k in range(80):
        at = set(draw.sample(range(5, 95, 5), 3))
        rows.append((k, " ".join(f"x{k}y{i}" if i in at else w for i, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made, open_pairs = [], ngram_join._open_pairs

    def counted(prefixes, roots, percent):
        out = open_pairs(prefixes, roots, percent)
        made.append(join_rows(out, "gram"))
        return out

    monkeypatch.setattr(ngram_join, "_open_pairs", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((tuple(r) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == brute_components(rows)
    assert made[0] <= 5 * len(rows)


def test_deduplicated(docs, none):
    got = ngram_join.deduplicated(docs)
    assert got.columns == docs.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=str)
    assert ids == [1, 4, 5, 6, 7, 8, 9]
    assert ngram_join.deduplicated(none).count() == 0


def test_decontam(spark, docs, none):
    item = [f"token{k}" for k in range(30)]
    changed = [("z" if k % 7 == 3 else w) for k, w in enumerate(item)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "rare pair here"), (3, None), (4, "")], "item_id bigint, text string")
    rows = [(1, "a b " + " ".join(item).upper() + " c"), (2, " ".join(changed)), (3, " ".join(item[:9])), (4, None), (5, "x rare pair here y"), (6, PROSE), (1, "a b " + " ".join(item) + " c")]
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(given, items).collect()}
    assert got == {(1, 1), (2, 1), (5, 2)}
    kept = decontam.clean(given.withColumn("row_key", F.lit(0)), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6]
    assert decontam.clean(docs, items).columns == docs.columns
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(given, items.limit(0)).count() == 0


def test_decontam_of_passages_and_shifted_copies(spark):
    item = [f"token{k}" for k in range(59)]
    other = [f"plain{k}" for k in range(40)]
    short = [f"s{k}" for k in range(45)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id bigint, text string")
    texts = {
        1: other + item[20:45] + other,  # a passage of 25 of 59
        2: other[:3] + item[:20] + ["new"] + item[20:40] + ["new", "er"] + item[40:] + other,  # words inserted
        3: short[:15] + short[16:30] + short[31:],  # words left out
        4: other + item[30:43],  # at the end of the text
        5: item[:6] + ["z"] + item[7:15] + other,  # a passage with a word replaced
        6: other + item[10:20] + ["new"] + item[20:30] + other,  # 10 and 10 around an inserted word
        7: other + item[10:22] + other,  # 12 tokens
        8: item[:11] + other + item[30:41] + other,  # 11 and 11, apart, 22 of 59
        9: short[:12] + other + short[30:42],  # 12 and 12, apart, 24 of 45
        10: (item[:11] + other) * 30,  # the same 11 again and again
        11: other,
    }
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in texts.items()], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1): 25, (2, 1): 59, (3, 2): 43, (4, 1): 13, (5, 1): 14, (6, 1): 20, (9, 2): 24}
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [7, 8, 10, 11]


# The base patterns of the four kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


PII_TEXTS = [
    None,
    "",
    "mail a.b@c.example.org. or a@b..c or x@y.z%q@r.s, é ñ 😀 j+k@l-m.no..p",
    "1.2.3.4.5 and 300.1.1.1 and 0255.1.1.01 5.6.7.8",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5 6 7",
    "call +1 (017) 555-7713, +12, +49 30 123456789012345 end+1 555 0100 99",
    "9" * 20000 + "@" + "a." * 9000 + "de",
    "iban DE89 3704 0044 0532 0130 00 and DE88370400440532013000, ssn 123-45-6789, tel 555 123 4567",
]


def test_pii(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id bigint, text string")
    rows = pii.found(docs).withColumn("spans", pii.listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))))
    for row in rows.collect():
        assert row["spans"] == ",".join(plain_spans(row["text"])), row["doc_id"]
    extra = pii.found(docs).filter("doc_id = 7").select("spans.kind").first()[0]
    assert {"iban", "ssn", "local_phone"} <= set(extra) and extra.count("iban") == 1
    shown = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert shown[0] is None and shown[4].startswith("card [CARD] or 4111-1111") and "[PHONE]" in shown[5]
    assert shown[2].startswith("mail [EMAIL]. or a@b..c")


IBANS = ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19")


@pytest.mark.parametrize(
    "text",
    ["{} Bank", "{} Please", "{} BIC COBADEFF", "{} 12 items", "{} A", "{}", "😀 {} X1 Y2 {} Z", "({}), {} GB29 {} é", "{} {} {}"],
)
def test_pii_ibans_before_capitals_and_numbers(spark, text):
    texts = [text.replace("{}", iban) for iban in IBANS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "iban"] for r in pii.found(docs).collect()}
    shown = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    for k, iban in enumerate(IBANS):
        want = [(m.start(), m.end()) for m in re.finditer(iban, texts[k])]
        assert [(s["start"], s["end"]) for s in spans[k]] == want and {s["value"] for s in spans[k]} == {iban}
        assert not re.search(iban, shown[k]) and shown[k].count("[IBAN]") + shown[k].count("[CARD]") == len(want)


def test_pii_context_on_both_sides(spark):
    texts = {
        "call 555-123-4567 or 555-765-4321": "call [LOCAL_PHONE] or [LOCAL_PHONE]",
        "555-123-4567 is my mobile": "[LOCAL_PHONE] is my mobile",
        "123-45-6789, 123-45-6780 (social)": "[SSN], [SSN] (social)",
        "phone@x.org 555-123-4567": "[EMAIL] [LOCAL_PHONE]",
        "+1 (555) 010-0123, 555-123-4567": "[PHONE], 555-123-4567",
        "555-123-4567 " + "far " * 20 + "phone": None,
        "é😀 a@b.de 1.2.3.4 x": "é😀 [EMAIL] [IP] x",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shown = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert shown == {k: want or text for k, (text, want) in enumerate(texts.items())}


def test_pii_many_spans_in_one_text(spark):
    mails = [f"user{k}@host{k}.example.org" for k in range(6000)]
    texts = ["mail " + " ".join(mails), ("DE89370400440532013000 Bank GB82WEST12345698765432 1.2.3.4 " * 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.found(docs).collect()}
    assert [s["value"] for s in rows[0]] == mails
    assert [(s["start"], s["end"]) for s in rows[0]] == [m.span() for m in re.finditer(r"user\S+", texts[0])]
    assert len(rows[1]) == 900 and all(texts[1][s["start"] : s["end"]] == s["value"] for s in rows[1])
    shown = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert shown[0] == "mail " + " ".join(["[EMAIL]"] * len(mails))
    assert shown[1] == "[IBAN] Bank [IBAN] [IP] " * 300


def test_packing(docs, none):
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    want = Counter()
    for i, text, _ in ROWS:
        ids = file.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = b"".join(x.to_bytes(4, "little") for x in ids[k : k + 4096])
            want[(i, k // 4096, k, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_best_fit_keeps_every_capacity():
    import numpy as np

    lengths = np.array([50, 50, 30, 30, 20, 10, 10, 5, 5, 1, 1, 1])
    number, _ = packing.best_fit(lengths, 100, 3, 5200)
    for k in set(number.tolist()):
        own = lengths[number == k]
        assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 5200


def test_chat(spark):
    rows = [
        (1, 0, "system", "be [TURN:x] kind\\"),
        (1, 1, "user", "</s>[INST] hi [/INST]"),
        (1, 2, "assistant", "yes [/TURN]"),
        (1, 3, "user", None),
        (1, 4, "assistant", ""),
        (1, 5, "user", "bye"),
        (2, 0, None, "lost"),
        (None, 0, "assistant", "\\[/TURN]\\"),
        (3, 0, "user", "twice"),
        (3, 0, "user", "twice"),
        (3, 0, "we]ird", "tie"),
    ]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("example", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(given)).collect()}
    for conv in (1, 2, None, 3):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["loss_chars"]) == (len(own), len(loss))
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.examples(given.limit(0))).count() == 0


def test_url_rules_and_walks(spark):
    link = '<a href="http://bad.example.net/x">b</a>'
    rows = [
        (1, "HTTP://Www.Example.ORG/es/1?q#f", None),
        (2, "http://example.org", ""),
        (3, None, None),
        (4, "no scheme", link),
        (5, "http://a.example.org/en/12", None),
        (6, "http://good.example.com/fr/1", '<a href="//friend.example.net/">f</a>'),
        *[(7, f"http://worse.example.com/de/{k}", None) for k in range(4)],
        (8, "http://linker.example.net/", '<a href="http://worse.example.com/">f</a>'),
        (9, "http://friend.example.net/", None),
        (9, "http://friend.example.net/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("trust", F.lit("x"))
    got = {r["page_id"]: r for r in linkgraph.filtered(pages.drop("trust")).collect()}
    assert [(got[k]["rule"], got[k]["verdict"]) for k in range(1, 10)] == [
        ("example.org/es/", "block"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        ("example.org/en/1", "block"),
        ("com/fr/", "allow"),
        ("com/de/", "block"),
        (None, "block"),
        (None, "allow"),
    ]
    assert (got[1]["host"], got[1]["path"]) == ("www.example.org", "/es/1")
    assert linkgraph.filtered(pages.drop("trust").limit(0)).count() == 0


def test_walks_against_a_plain_iteration(spark):
    import random

    rng = random.Random(3)
    edges = {(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}"): float(rng.randrange(1, 5)) for _ in range(40)}
    edges = {(a, b): w for (a, b), w in edges.items() if a != b}
    seeds = {0: {"h1": 0.5, "h2": 0.5}, 1: {"h3": 1.0}}
    want = {}
    for walk, start in seeds.items():
        steps = {(a, b) if walk == 0 else (b, a): w for (a, b), w in edges.items()}
        out = Counter()
        for (a, _), w in steps.items():
            out[a] += w
        rank = dict(start)
        for _ in range(linkgraph.ROUNDS):
            new = Counter({h: (1 - linkgraph.DAMPING) * r for h, r in start.items()})
            for (a, b), w in steps.items():
                new[b] += linkgraph.DAMPING * rank.get(a, 0.0) * w / out[a]
            rank = new
        want.update({(walk, h): r for h, r in rank.items() if r})
    given = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    starts = spark.createDataFrame([(k, h, r) for k, s in seeds.items() for h, r in s.items()], "walk int, host string, rank double")
    got = {(r["walk"], r["host"]): r["rank"] for r in linkgraph.walks(given, starts).collect() if r["rank"]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_url_filters_with_clashing_columns(spark):
    rows = [(1, "http://a.example.org/es/1", None, "x", "y", 1), (2, "http://b.example.com/", "<p>", "x", "y", 2)]
    names = "page_id bigint, url string, html string"
    plain = spark.createDataFrame([r[:3] for r in rows], names)
    want = sorted(tuple(r) for r in linkgraph.filtered(plain).select("page_id", *linkgraph.RESULTS).collect())
    for other in ("trust", "distrust", "blocked", "_host", "host", "path", "rule", "verdict", "rule_verdict", "walk", "weight", "a.b"):
        given = spark.createDataFrame([(*r[:4],) for r in rows], f"{names}, `{other}` string")
        got = linkgraph.filtered(given)
        assert sorted(tuple(r) for r in got.select("page_id", *linkgraph.RESULTS).collect()) == want
        if other not in linkgraph.RESULTS:
            assert {r[other] for r in got.collect()} == {"x"}


def test_language(spark, docs, none):
    rows = [r["lang_pred"] for r in langmix.identified(docs).collect()]
    assert len(rows) == len(ROWS) and rows.count(langmix.UNKNOWN) == 3
    assert langmix.identified(none).count() == 0
    given = table(spark, SF_DIR, "documents")
    held = langmix.identified(given).filter("held_out").join(given.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()


def test_language_mixture(spark):
    given = table(spark, SF_DIR, "documents")
    model = langmix.trained(given)
    texts = {r["lang"]: r["text"] for r in given.filter("n_chars between 800 and 2000").collect()}
    chosen, shares, _ = langmix.mixture(model, texts["en"] + " " + texts["de"])
    assert {model.languages[k] for k in chosen} == {"en", "de"} and min(shares) > 0.2


def test_brown_scores(spark, docs, none):
    import math

    given = docs.select("doc_id", "text")
    rows = {(r["doc_id"], r["n_tokens"]): r for r in brown_lm.scored(given).collect()}
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    tokens = lambda t: [*plain_words((t or "").lower()), ""]
    counts = Counter(w for i, t, _ in ROWS if learn(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, text, _ in ROWS:
        ws = tokens(text)
        row = rows[(i, len(ws))]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert row["base_score"] == pytest.approx(base) and row["n_known"] == sum(counts[w] > 0 for w in ws)
        assert row["train_tokens"] == total and row["score"] < 0
    assert brown_lm.scored(none).count() == 0


def test_exchange_finds_classes():
    import numpy as np

    pairs = np.zeros((7, 7))
    for a in (1, 2, 3):
        for b in (4, 5, 6):
            pairs[a, b], pairs[b, a] = 10 + a, 9 + b
    label = brown_lm.exchanged(pairs, 3)
    assert len({*label[1:4]}) == 1 and len({*label[4:]}) == 1 and label[1] != label[4]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.scored(docs, labels).collect()} == {0.0}
    assert toxicity.scored(none, labels).count() == 0
    given, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    held = toxicity.scored(given, marks).filter("held_out").join(marks, "doc_id").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in held)
    assert wrong <= 0.1 * len(held)


def test_pipeline_stages(spark, none):
    given = table(spark, SF_DIR, "documents")
    rows = given.collect()
    one = corpus_pipeline.quality_stage(spark, given, SF_DIR)
    assert one.columns == given.columns and 0 < one.count() < len(rows)
    two = corpus_pipeline.ngram_join_stage(spark, one, SF_DIR)
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    want = {c for i, _, c in brute_components(list(kept.items()))}
    assert {r["doc_id"] for r in two.collect()} == want
    three = corpus_pipeline.decontam_stage(spark, two, SF_DIR)
    four = corpus_pipeline.pii_stage(spark, three, SF_DIR)
    assert four.columns == given.columns and four.count() == three.count()
    five = corpus_pipeline.packing_stage(spark, four, SF_DIR)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF_DIR)
    assert empty.count() == 0


def test_language_model_batches_are_bounded(spark):
    """Workers get at most a megabyte of text at once, not 10,000 texts with all their rare words."""
    from feedspark.llm import brown_lm
    from feedspark.session import PYTHON_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        docs = spark.range(40).selectExpr("id AS doc_id", "concat('a b c w', id) AS text")
        assert brown_lm.scored(docs).count() == 40
        assert spark.conf.get(name) == str(PYTHON_BYTES)
    finally:
        spark.conf.set(name, before)


def test_brown_classes_take_every_word(spark, monkeypatch):
    """No word outside the most frequent ones is left to its ending: none gains by another class."""
    import numpy as np

    monkeypatch.setattr(brown_lm, "START", 3)
    monkeypatch.setattr(brown_lm, "KNOWN", 5)
    monkeypatch.setattr(brown_lm, "CLASSES", 5)
    monkeypatch.setattr(brown_lm, "ONE_BY_ONE", 2)
    picks = np.random.default_rng(3).integers(0, 8, (300, 6))
    texts = [" ".join(f"{'nv'[k % 2]}{p}ing" for k, p in enumerate(row)) for row in picks] + [None, "n1ing n1ing", "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    kept = {}
    real = brown_lm.trained
    monkeypatch.setattr(brown_lm, "trained", lambda blocks, words: kept.setdefault("model", real(blocks, words)))
    numbers = brown_lm.numbered
    monkeypatch.setattr(brown_lm, "numbered", lambda counts: kept.setdefault("words", numbers(counts)))
    dropped = brown_lm.dropped
    monkeypatch.setattr(brown_lm, "dropped", lambda df: kept.setdefault("ids", {bytes(r["word"]): r["id"] for r in df.collect()}) if "id" in df.columns else dropped(df))
    rows = {r["doc_id"]: r for r in brown_lm.scored(docs).collect()}
    ids = {w: k for k, w in enumerate(kept["words"][0])} | kept["ids"]
    model = kept["model"]
    given = {i: [w.encode() for w in plain_words(texts[i])] + [b""] for i in range(len(texts))}
    counts = Counter(w for i in learned for w in given[i])
    assert set(ids) == set(counts) and sorted(ids.values()) == list(range(len(counts))) and len(kept["ids"]) == len(counts) - 5
    label = {w: int(model.label[k]) for w, k in ids.items()}
    pairs = Counter(p for i in learned for p in zip([b"", *given[i][:-1]], given[i]))

    def likelihood(label):
        table = np.zeros((5, 5))
        for (a, b), n in pairs.items():
            table[label[a], label[b]] += n
        entropy = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        return entropy(table) - entropy(table.sum(0)) - entropy(table.sum(1)), table

    best, table = likelihood(label)
    assert max(likelihood(label | {w: c})[0] for w in label if w for c in range(1, 5)) <= best + 1e-6
    assert not {label[w] for w in label if w.startswith(b"n")} & {label[w] for w in label if w.startswith(b"v")}
    mass, members = table.sum(0), Counter(label.values())
    prior = (mass + 0.5) / (mass + 0.5).sum()
    step = (table + 20 * prior) / (table.sum(1, keepdims=True) + 20)
    unseen = min(range(5), key=lambda c: (-members[c], c))
    for i, ws in given.items():
        at = [label.get(w, unseen) for w in ws]
        want = sum(np.log10(step[a, b]) for a, b in zip([0, *at[:-1]], at))
        want += sum(np.log10((counts[w] + 0.5) / (mass[c] + 0.5 * (members[c] + 1))) for w, c in zip(ws, at, strict=True))
        assert rows[i]["score"] == pytest.approx(want)
        assert rows[i]["perplexity"] == pytest.approx(10 ** (-want / len(ws)))


def test_gains_of_a_move():
    import numpy as np

    dice = np.random.default_rng(1)
    pairs = dice.integers(0, 30, (40, 40)) * (dice.random((40, 40)) < 0.3) * 9.0
    label = np.append(0, dice.integers(1, 6, 39))
    table = lambda label: np.eye(6)[label].T @ pairs @ np.eye(6)[label]
    away = pairs - np.diag(np.diagonal(pairs))
    got = brown_lm.gains(away @ np.eye(6)[label], away.T @ np.eye(6)[label], np.diagonal(pairs), label, table(label), brown_lm._levels(table(label)))
    for w in range(1, 40):
        for c in range(1, 6):
            moved = np.where(np.arange(40) == w, c, label)
            assert got[w, c] == pytest.approx(brown_lm.likelihood(table(moved)) - brown_lm.likelihood(table(label)), abs=1e-7)
