"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression over the row's own text, so the operator needs no
shuffle and its cost follows the length of the text.

Defined results. A null or blank text has no words: all counts are 0 and the base fails.
Repeated rows are judged one by one. Other columns pass through untouched; the operator adds
only the columns named by ``measured`` and ``judged``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import SPACE, let, text_of, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il je la le les ne nous ou par pas pour qui que "
    "sa se son sur un une vous "
    "aber als auch auf aus bei das dem den der die ein eine er es für ich im ist man mit nicht "
    "sich sie sind und von war wie wir zu zum "
    "al con del el esta este lo los las mi más no para pero por si sin su sus ue y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when ``low <= measure <= high``; an open side is None."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.06),
    Rule("duplicate_line_ratio", high=0.5),
    Rule("capital_ratio", high=0.5),
)


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more.

    Windows are compared by a 64-bit hash. Positions are sorted by hash, so that equal
    windows are neighbours, and only texts with a repeat pay for the sort.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        steps = lambda p: F.transform(
            p, lambda i, k: F.coalesce(F.least(F.lit(width), F.get(p, k + 1) - i), F.lit(width))
        )
        return F.aggregate(let(F.sort_array(twice), steps), F.lit(0).cast("long"), lambda a, n: a + n)

    hashes = F.when(
        F.size(ws) >= width,
        F.transform(F.sequence(F.lit(1), F.size(ws) - (width - 1)), lambda i: F.xxhash64(F.slice(ws, i, width))),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios that the rules compare."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words(t),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            repeated_words(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    line_counts = let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        ),
    )
    chars = F.struct(
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    out = docs.withColumn("_m", F.struct(counts.alias("w"), line_counts.alias("l"), chars.alias("c")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    w, ln, c = F.col("_m.w"), F.col("_m.l"), F.col("_m.c")
    return out.withColumns(
        {
            "n_words": w["n_words"],
            "word_chars": c["word_chars"],
            "n_symbols": c["n_symbols"],
            "n_dup_lines": ln["n_dup_lines"],
            "n_repeat_words": w["n_repeat_words"],
            "mean_word_chars": ratio(c["word_chars"], w["n_words"]),
            "symbol_ratio": ratio(c["n_symbols"], w["n_words"]),
            "stop_word_ratio": ratio(w["n_stop_words"], w["n_words"]),
            "duplicate_line_ratio": ratio(ln["n_dup_lines"], ln["n_lines"]),
            "capital_ratio": ratio(c["n_capitals"], c["word_chars"]),
        }
    ).drop("_m")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as one expression."""
    broken = []
    for rule in rules:
        value = F.col(rule.measure)
        tests = [value < rule.low] if rule.low is not None else []
        tests += [value > rule.high] if rule.high is not None else []
        for test in tests:
            broken.append(F.when(test, F.lit(rule.measure)))
    return F.array_compact(F.array(*broken))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the measures, ``base_failed``, ``broken_rules`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    return (
        measured(docs, text)
        .withColumn("base_failed", failed)
        .withColumn("broken_rules", compiled(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )


def passed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns untouched, whatever their names.

    The verdict goes through a generator: a plain filter would be pushed below the measures,
    which would then be computed once per rule.
    """
    rows = judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    verdict = F.array(F.struct("row", "kept"))
    return rows.select(F.inline(F.filter(verdict, lambda v: v["kept"]))).select("row.*")
