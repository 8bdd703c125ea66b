"""Mixing, spelling variants and conversation repair on awkward rows, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedspark.llm import mixing, repair, spelling
from feedspark.llm.common import stored, table

SF_DIR = "/root/testdata/sf0.001"


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# Mixing


def plain_mix(rows, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST_EPOCHS):
    """Copies of each (doc_id, source, text) row, by the same rules, source by source."""
    size = lambda t: len(plain_words(t))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(t) for _, x, t in rows if x == s) for s in sources}
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(sources)}
    clamped: set = set()
    while True:
        open_ = sum(weight[s] for s in sources if s not in clamped)
        if not open_:
            break
        found = (sum(total.values()) * share - sum(total[s] for s in clamped) * most) / open_
        over = {s for s in sources if total[s] * most < weight[s] * found}
        if over == clamped:
            break
        clamped = over
    target = {s: total[s] * most if s in clamped or not open_ else min(total[s] * most, weight[s] * found) for s in sources}
    copies = {}
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        room = limit = int(target[s]) - whole * total[s]
        draws = defaultdict(list)
        for i, x, t in rows:
            if x == s:
                text = hashlib.md5((t or "").encode()).hexdigest()
                name = f"{mixing.SEED}:{'' if i is None else i}:{text}"
                draws[int(hashlib.md5(name.encode()).hexdigest()[:15], 16)].append((i, t))
        live = room > target[s] * mixing.NEAR
        for _, unit in sorted(draws.items()):
            words = sum(size(t) for _, t in unit)
            taken = live and words and size(unit[0][1]) <= limit and words <= room
            if taken:
                room -= words
            elif live and words and size(unit[0][1]) <= limit:
                limit, live = room, room > target[s] * mixing.NEAR
            for i, t in unit:
                copies[(i, s, t)] = whole + bool(taken)
    return target, total, copies


def mix_rows(seed=3):
    rand = random.Random(seed)
    rows = [(k, rand.choice(["a", "a", "a", "b", "é", "z", "", None]), " ".join(["w"] * rand.choice([1, 3, 9, 40, 200]))) for k in range(300)]
    rows += [(7, "a", None), (8, "a", " \t\n"), (None, "b", "one two"), (None, "b", "one two"), (None, "b", "three")]
    rows += [(9, "b", "copy of a row"), (9, "b", "copy of a row"), (500, "long", "x " * 60_000), (501, "long", "y " * 50), (502, "void", "")]
    return rows


def test_mixing(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("size", F.lit("x")).withColumn("copies", F.lit(0))
    drawn = stored(mixing.drawn(docs.repartition(5)))
    plan = mixing.planned(drawn)
    target, total, copies = plain_mix(rows)
    for r in plan.collect():
        assert (r["source_size"], r["target"]) == (total[r["source"]], pytest.approx(target[r["source"]]))
    got = Counter((r["doc_id"], r["size"], r["source_size"], r["copies"], r["taken"]) for r in mixing.mixed(drawn, plan).collect())
    want = Counter((i, len(plain_words(t)), total[s], copies[(i, s, t)], copies[(i, s, t)] * len(plain_words(t))) for i, s, t in rows)
    assert got == want
    again = mixing.repeated(docs, plan)
    assert again.columns == docs.columns
    seen = Counter((r["doc_id"], r["source"], r["text"]) for r in again.collect())
    expect = Counter()
    for i, s, t in rows:
        expect[(i, s, t)] += copies[(i, s, t)]
    assert seen == +expect


def test_mixing_when_every_source_is_at_its_cap(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x")], "doc_id bigint, source string, text string")
    drawn = stored(mixing.drawn(docs))
    plan = mixing.planned(drawn, share=5.0)
    assert {r["source"]: r["target"] for r in plan.collect()} == {"a": 4.0, "b": 2.0}
    assert sorted(r["taken"] for r in mixing.mixed(drawn, plan).collect()) == [2, 4]


def test_mixing_reruns_agree_and_come_near(spark):
    drawn = stored(mixing.drawn(table(spark, SF_DIR.replace("0.001", "0.01"), "documents")))
    first, second = (sorted(tuple(r) for r in mixing.mixed(drawn, mixing.planned(drawn)).collect()) for _ in range(2))
    assert first == second and all(r[5] <= 2 * r[1] for r in first)


def test_mixing_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    drawn = stored(mixing.drawn(none))
    assert mixing.mixed(drawn, mixing.planned(drawn)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id bigint, source string, text string")
    drawn = stored(mixing.drawn(blank))
    assert sorted(r["taken"] for r in mixing.mixed(drawn, mixing.planned(drawn)).collect()) == [0, 0]


# Spelling


def plain_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_groups(rows):
    words = plain_vocabulary(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


SPELLED = [
    (1, "Elephant elephant ÉLÉPHANT×÷ elefant elephants, " * 30),
    (2, "elephan elephan elephent elephent eelephant eelephant elephaant elephaant"),
    (20, "elephantsss " * 2 + "elephants " * 400 + "elephantss " * 25),
    (None, "banana-bananas bananas' bananas bananaß bananaß " * 12),
    (4, None),
    (5, ""),
    (6, "short 123 ''' \t\n"),
    (2, "elephan elephan elephent elephent eelephant eelephant elephaant elephaant"),
    (7, "tieaaaa tieaaaa tiebbbb tiebbbb " + "tieaabb tiebbaa " * 3),
    (8, "z" * 30_000 + " " + "z" * 30_000 + " " + "z" * 29_999 + " " + "z" * 29_999),
    (9, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaab aaaaaab"),
]


@pytest.mark.parametrize("pass_bytes", [spelling.PASS_BYTES, 128])
def test_spelling(spark, pass_bytes):
    docs = spark.createDataFrame(SPELLED, "doc_id bigint, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in spelling.grouped(docs, pass_bytes).collect())
    assert got == plain_groups(SPELLED)
    assert any(r[1] is not None and r[1] != r[2] for r in got)


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.grouped(none).count() == 0
    assert spelling.grouped(spark.createDataFrame([(1, "nothing twice")], none.schema)).count() == 0


def test_spelling_filters_lose_no_pair(spark):
    rand = random.Random(5)
    words = {"".join(rand.choice("abcé") for _ in range(rand.choice([7, 7, 8, 9]))) for _ in range(600)}
    vocab = stored(spark.createDataFrame([(w, 2 + len(w)) for w in words], "word string, n bigint"))
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(vocab, 2048).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want


# Repair


def plain_rows(conversations):
    """Rows of each conversation after damage, in order."""
    own = defaultdict(list)
    spelled = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{spelled(conv)}:{spelled(turn)}".encode()) % 20
        role, text = spelled(role), spelled(text)
        own[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in own.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        stripped = text.strip(" \t\n\v\f\r")
        out.append(
            "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        )
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Every choice of edits, with up to two inserted turns in each gap, tried out."""
    faults = plain_faults(rows)
    best = None
    choices = [("D",) if f in ("blank", "duplicate") else ("D", "K", "R") for f in faults]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, turns = 3 * sum(gaps), "", []
            for k in range(len(rows) + 1):
                audit += "I" * gaps[k]
                turns += [("?", "")] * gaps[k]
                if k == len(rows):
                    break
                audit += edits[k]
                cost += {"D": 4, "K": 0, "R": 3}[edits[k]] + (3 if edits[k] != "D" and faults[k] == "truncated" else 0)
                if edits[k] != "D":
                    turns.append((rows[k][1] if edits[k] == "K" else "?", rows[k][2]))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            lead = bool(turns) and turns[0][0][:1] == "s"
            wanted = ["s"] * lead + [("u", "a")[k % 2] for k in range(len(turns) - lead)]
            if (len(turns) - lead) % 2 or (lead and len(turns) == 1):
                continue
            if all(role == "?" or role[:1] == w for (role, _), w in zip(turns, wanted, strict=True)):
                named = [({"u": "user", "a": "assistant"}[w] if role == "?" else role, text) for (role, text), w in zip(turns, wanted, strict=True)]
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in named))
    return best


def plain_report(conversations):
    out = []
    for conv, rows in plain_rows(conversations).items():
        faults, turns = plain_faults(rows), {t for t, _, _ in rows if t is not None}
        cost, audit, whole = plain_repair(rows)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


TALKS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hi."),
    (1, 2, "assistant", "Yes"),
    (1, 9, "user", "and?"),
    (2, 0, "assistant", "First."),
    (2, 0, "assistant", "First."),
    (2, 1, None, None),
    (3, None, "user", "No turn!"),
    (3, None, "tool", "Odd one."),
    (3, 4, "", "No role."),
    (None, 0, "user", "Nobody's?"),
    (None, 1, "assistant", " \n"),
    (4, 0, "system", "Alone."),
    (5, 0, "user", "x" * 50_000 + "."),
    (5, 1, "assistant", "é😀." * 9_000),
    (6, 0, "user", "Tie a."),
    (6, 0, "user", "Tie b."),
    (6, 0, "assistant", "Tie c."),
    *[(7 + k, 0, "user", "Dropped?") for k in range(40)],
]
TALK_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_repair(spark):
    given = spark.createDataFrame(TALKS, TALK_SCHEMA).withColumn("key", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("copy", F.lit(2))
    got = sorted((tuple(r) for r in repair.reported(given, repair.damaged(given)).collect()), key=str)
    assert got == plain_report(TALKS)
    assert any(r[7] == "" and r[8] == hashlib.sha256().hexdigest() for r in got)


def test_repair_of_random_conversations(spark):
    rand = random.Random(11)
    texts = ["Fine.", "cut off", "", "Why?", "Fine.", "So!"]
    rows = [(c, t, rand.choice(["user", "assistant", "system", "tool", "user"]), rand.choice(texts)) for c in range(60) for t in range(rand.randrange(1, 5))]
    given = spark.createDataFrame(rows, TALK_SCHEMA)
    got = sorted((tuple(r) for r in repair.reported(given, repair.damaged(given)).collect()), key=str)
    assert got == plain_report(rows)


def test_repair_of_a_long_conversation_by_blocks(spark):
    rand = random.Random(2)
    rows = [(1, t, rand.choice(["user", "assistant", "assistant", "system"]), rand.choice(["Yes.", "no", f"{t}.", f"{t}"])) for t in range(700)]
    own = plain_rows(rows)[1]
    flags = list(zip([r[:1] for _, r, _ in own], plain_faults(own), strict=True))
    whole = repair.searched(flags, repair.START)
    cost, audit = min(whole[g] for g in repair.GOALS if g in whole)
    given = spark.createDataFrame(rows, TALK_SCHEMA)
    flag_table, numbered = repair.ordered(repair.damaged(given))
    kept = repair.BLOCK
    for block in (3, 64):
        repair.BLOCK = block
        try:
            audits = stored(repair.audited(flag_table))
        finally:
            repair.BLOCK = kept
        row = audits.first()
        assert (row["cost"], row["audit"]) == (cost, audit)
    turns = repair.repaired(numbered, audits).collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns))
    assert [r["place"] for r in turns] == list(range(len(turns)))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TALK_SCHEMA)
    assert repair.reported(none, repair.damaged(none)).count() == 0
