"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All work is done by column expressions inside the row. A pattern is applied to the whole
text for the matches, for what lies between them and, where a kind's end is found by its
checksum, for what follows; the running sum of the lengths gives the places. Patterns start
only where a match can start and give nothing back, so their time grows with the length of
the text, however it is made. Context is read around the span from the text as given.

Defined results. A null or empty text has no spans. Repeated rows are searched one by one.
Offsets count code points, ends are exclusive. Spans of different kinds may overlap. Other
columns pass through untouched. Values and contexts are kept per span only inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import let, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    """``certainty`` of a confirmed match; ``bonus`` if a context word stands near it.

    ``ahead``, if given, is what the end is looked for in: the match is then only the head.
    """

    name: str
    pattern: str
    needs: str
    certainty: float
    bonus: float
    context: str
    ahead: str = ""


# Patterns and context words by kind. The first four are the base kinds. Each is
# written so that a run of admitted characters is scanned once.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)",
        "@",
        0.9,
        0.1,
        r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]",
        0.6,
        0.3,
        r"(?i)\b(?:ip|host|server|address|adresse|login)\b",
    ),
    Kind(
        "card",
        r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))+(?<=[0-9])",
        r"[0-9]",
        0.7,
        0.3,
        r"(?i)\b(?:card|visa|credit|debit|karte|carte|tarjeta)\b",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        0.7,
        0.3,
        r"(?i)\b(?:call|phone|tel|mobile|fax|telefon|téléphone|teléfono)\b",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}",
        r"[A-Z]{2}[0-9]{2}",
        0.6,
        0.4,
        r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
        r"(?:\x20?[A-Z0-9]){11,30}+[\s\S]?",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"[0-9]-[0-9]{2}-[0-9]",
        0.3,
        0.4,
        r"(?i)\b(?:ssn|social|security)\b",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        r"[0-9][\x20.-][0-9]{4}",
        0.2,
        0.4,
        r"(?i)\b(?:call|phone|tel|mobile|fax|telefon|téléphone|teléfono)\b",
    ),
)


# The lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    places = F.sequence(F.lit(1), F.length(digits))
    ends = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        d = F.substring(ends, place, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(place % 2 == 0, doubled).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its first four characters moved to the end."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def account(run: Column) -> Column:
    """The account number a run starts with, or null.

    ``run`` holds one character more than may belong to the number. Every place at which a
    word ends is tried: first the country's length, then from the longest down.
    """
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n)])
    ends = F.filter(
        F.sequence(F.lit(15), F.greatest(F.lit(15), F.length(run))),
        lambda k: F.substring(run, k, F.lit(2)).rlike(r"^[A-Z0-9](?![A-Za-z0-9])"),
    )
    known = lengths[F.substring(run, 1, 2)]
    tried = F.transform(ends, lambda k: F.substring(run, F.lit(1), k))
    size = lambda v: F.length(F.regexp_replace(v, r"\x20", ""))
    good = F.filter(tried, lambda v: size(v).between(15, 34) & mod97(v))
    ranked = F.transform(
        good, lambda v: F.struct(F.coalesce(size(v) == known, F.lit(False)).alias("own"), size(v).alias("n"), v.alias("v"))
    )
    return F.array_max(ranked)["v"]


def confirmed(kind: str, value: Column) -> Column:
    """The test that a match of a kind must pass."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9..)|-00-|0000$")
    return F.lit(True)


BLOCK = 64


def _running(items: Column, zero: Column, step, kind: str) -> Column:
    """The state of a fold before each item, by blocks.

    A fold copies its state at every step, so a list that grows with the items would cost
    their square; here no state holds more than a block, or one entry for each block.
    """
    state = lambda now: F.struct(now.alias("now"), F.array().cast(f"array<{kind}>").alias("seen"))
    seen = lambda s: F.concat(s["seen"], F.array(s["now"])).alias("seen")
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))

    def firsts(blocks: Column) -> Column:
        add = lambda s, block: F.struct(F.aggregate(block, s["now"], step).alias("now"), seen(s))
        return F.aggregate(blocks, state(zero), add, lambda s: s["seen"])

    def within(blocks: Column, starts: Column) -> Column:
        add = lambda s, x: F.struct(step(s["now"], x).alias("now"), seen(s))
        states = F.transform(
            blocks, lambda block, k: F.aggregate(block, state(F.get(starts, k)), add, lambda s: s["seen"])
        )
        return F.flatten(states)

    return let(cut, lambda blocks: let(firsts(blocks), lambda starts: within(blocks, starts)))


SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"


def confirmed_of(text: Column, kind: Kind) -> Column:
    """All confirmed spans of one kind, from left to right, scored without their context."""
    parts = F.struct(
        F.split(text, kind.pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"),
    )
    if kind.ahead:
        pattern = F.lit(f"{kind.pattern}(?=({kind.ahead}|))")
        parts = parts.withField("ahead", F.regexp_extract_all(text, pattern, F.lit(1)))
    none = F.array().cast(SPAN)

    def placed(parts: Column) -> Column:
        pairs = F.transform(
            parts["hits"],
            lambda hit, k: F.struct(
                hit.alias("hit"),
                F.get(parts["gaps"], k).alias("gap"),
                (account(F.concat(hit, F.get(parts["ahead"], k))) if kind.ahead else F.when(confirmed(kind.name, hit), hit)).alias("value"),
            ),
        )
        return let(pairs, lambda p: let(_running(p, start, passed, "struct<at:int,free:int>"), lambda states: chosen(p, states)))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"))

    def passed(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        new = pair["value"].isNotNull() & (begin >= state["free"])
        return F.struct(
            (begin + F.length(pair["hit"])).alias("at"),
            F.when(new, begin + F.length(pair["value"])).otherwise(state["free"]).alias("free"),
        )

    def chosen(pairs: Column, states: Column) -> Column:
        def span(pair: Column, k: Column) -> Column:
            begin = F.get(states, k)["at"] + F.length(pair["gap"])
            new = F.struct(
                F.lit(kind.name).alias("kind"),
                begin.alias("start"),
                (begin + F.length(pair["value"])).alias("end"),
                F.lit(kind.certainty).cast("double").alias("score"),
                pair["value"].alias("value"),
            )
            return F.when(pair["value"].isNotNull() & (begin >= F.get(states, k)["free"]), new)

        return F.filter(F.transform(pairs, span), lambda s: s.isNotNull())

    return F.when(text.rlike(kind.needs), let(parts, placed)).otherwise(none)


def _piece(signs: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(signs, start + 1, end - start), "")


def _weighed(signs: Column, spans: Column) -> Column:
    """The spans whose score, with the words on both sides of each, reaches the threshold."""

    def weigh(span: Column) -> Column:
        before = _piece(signs, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), span["start"])
        after = _piece(signs, span["end"], span["end"] + CONTEXT_CHARS)
        bonus = F.lit(0.0)
        for kind in KINDS:
            near = (span["kind"] == kind.name) & (before.rlike(kind.context) | after.rlike(kind.context))
            bonus = F.when(near, kind.bonus).otherwise(bonus)
        return span.withField("score", span["score"] + bonus)

    return F.filter(F.transform(spans, weigh), lambda s: s["score"] >= THRESHOLD)


def _with_spans(text: Column, use, otherwise: Column) -> Column:
    """Hand the text's characters and its spans to ``use``; texts without a confirmed match are ``otherwise``."""
    spans = F.concat(*[confirmed_of(text, kind) for kind in KINDS])
    return let(
        spans,
        lambda s: F.when(F.size(s) > 0, let(F.split(text, ""), lambda c: let(_weighed(c, s), lambda w: use(c, w)))).otherwise(otherwise),
    )


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: every confirmed span with its score and value, by kind and place."""
    return docs.withColumn("spans", _with_spans(text_of(text), lambda signs, spans: spans, F.array().cast(SPAN)))


def _areas(spans: Column) -> Column:
    """The parts of a text that spans cover, from left to right: ``start, end, label``.

    Spans that overlap are one area under the label of the first kind.
    """
    rank = F.create_map(*[F.lit(x) for n, kind in enumerate(KINDS) for x in (kind.name, n)])
    area = lambda start, end, label: F.struct(start.alias("start"), end.alias("end"), label.alias("label"))
    label = lambda s: F.struct(rank[s["kind"]].alias("rank"), F.upper(s["kind"]).alias("name"))
    ordered = F.array_sort(F.transform(spans, lambda s: area(s["start"], s["end"], label(s))))

    def joined(spans: Column, reached: Column) -> Column:
        """A span that starts where all before it have ended begins an area; what follows it belongs there."""
        places = F.sequence(F.lit(0), F.size(spans) - 1)
        begins = F.filter(places, lambda k: F.get(spans, k)["start"] >= F.get(reached, k))

        def whole(at: Column, k: Column, begins: Column) -> Column:
            own = F.slice(spans, at + 1, F.coalesce(F.get(begins, k + 1), F.size(spans)) - at)
            ends, labels = F.transform(own, lambda x: x["end"]), F.transform(own, lambda x: x["label"])
            return area(F.get(spans, at)["start"], F.array_max(ends), F.array_min(labels))

        return let(begins, lambda b: F.transform(b, lambda at, k: whole(at, k, b)))

    empty = F.array().cast("array<struct<start:int,end:int,label:struct<rank:int,name:string>>>")
    furthest = lambda now, x: F.greatest(now, x["end"])
    areas = let(ordered, lambda o: let(_running(o, F.lit(0), furthest, "int"), lambda r: joined(o, r)))
    return F.when(F.size(spans) > 0, areas).otherwise(empty)


def _hidden(signs: Column, spans: Column) -> Column:
    def shown(areas: Column) -> Column:
        end = lambda k: F.coalesce(F.get(areas, k)["end"], F.lit(0))
        parts = F.transform(
            areas, lambda a, k: F.concat(_piece(signs, end(k - 1), a["start"]), F.lit("["), a["label"]["name"], F.lit("]"))
        )
        return F.concat(F.array_join(parts, ""), _piece(signs, end(F.size(areas) - 1), F.size(signs)))

    return let(_areas(spans), shown)


def masked(text: Column) -> Column:
    """The text with every confirmed span replaced by its kind, as in ``[EMAIL]``.

    Spans are those of ``found``, sought in the text as given. Overlapping spans are masked
    together, under the first kind.
    """
    return let(text, lambda t: _with_spans(t, _hidden, t))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    shown = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(shown, ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``n_chars``, where present, counted anew; null stays null."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), masked(text_of("text")).alias("shown"))
    shown = F.when(F.col("row.text").isNotNull(), F.col("shown"))
    new = {"text": shown, "n_chars": F.length(shown).cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
