"""Language identification as a mixture.

Each language is a distribution over hashed three-byte grams of lower-case text, counted over
all labelled rows of the learning fold. For a document, expectation-maximisation estimates the
shares of the languages that make its grams likeliest. Languages are then removed, smallest
share first, as long as the likelihood with a penalty for each language rises; the language
with the largest share of the chosen set is the answer.

The model holds ``GRAMS`` numbers per language, whatever the size of the corpus.

Defined results. A null text or one without a letter is ``und`` with score 0 and no shares.
Rows without ``lang`` teach nothing. Without any labelled row every text is ``und``. Repeated
rows are answered one by one. Other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import UPPER_TO_LOWER, column, remainder, shipped

GRAMS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 30
ENOUGH = 1e-3
PENALTY = 4.0
"""Per language of a set, in units of half the logarithm of the number of grams."""
FOLDS = 3
HELD_OUT = 1
UNKNOWN = "und"
HELD_AT_ONCE = 64


def grams(text: str) -> np.ndarray:
    """Hashed grams of a text between two spaces; one for each byte."""
    plain = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
    signs = np.frombuffer(plain.translate(UPPER_TO_LOWER), np.uint8).astype(np.uint32)
    codes = (signs[:-2] << 16) | (signs[1:-1] << 8) | signs[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray
    """Of each gram (row) in each language (column)."""


def trained(labelled: DataFrame) -> Model:
    """Count the grams of each language over all rows of ``labelled`` (``text``, ``lang``)."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, numbers in held.items():
                some = np.nonzero(numbers)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(numbers[some])],
                    ["lang", "gram", "n"],
                )

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held:
                    if len(held) >= HELD_AT_ONCE:
                        yield from rows()
                        held.clear()
                    held[lang] = np.zeros(GRAMS, np.int64)
                held[lang] += np.bincount(grams(text), minlength=GRAMS)
        yield from rows()

    read = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    counted = read.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = table.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    numbers = np.zeros((GRAMS, len(languages)))
    at = {lang: k for k, lang in enumerate(languages)}
    if names:
        numbers[column(table, "gram"), [at[x] for x in names]] = column(table, "n")
    smooth = numbers + SMOOTHING
    return Model(languages, smooth / smooth.sum(axis=0))


def fitted(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns) that fit the counted grams (rows) best, and the log-likelihood."""
    total = counts.sum()
    shares = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    if len(shares) > 1:
        for _ in range(ROUNDS):
            weight = counts / (likelihood @ shares)
            new = shares * (weight @ likelihood) / total
            moved = np.abs(new - shares).max()
            shares = new
            if moved < ENOUGH:
                break
    return shares, float(counts @ np.log(likelihood @ shares))


def mixture(model: Model, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The chosen languages, their shares, and the shares with all languages admitted."""
    found, counts = np.unique(grams(text), return_counts=True)
    rows = model.likelihood[found]
    # A gram's likelihoods matter only in proportion; scaling keeps the numbers in range.
    scale = rows.max(axis=1)
    rows, base = rows / scale[:, None], float(counts @ np.log(scale))
    price = PENALTY * 0.5 * np.log(counts.sum())
    chosen = list(range(rows.shape[1]))
    shares, fit = fitted(rows, counts)
    everything = shares
    value = base + fit - price * len(chosen)
    while len(chosen) > 1:
        fewer = [c for k, c in enumerate(chosen) if k != int(shares.argmin())]
        other, fit = fitted(rows[:, fewer], counts)
        if base + fit - price * len(fewer) < value:
            break
        chosen, shares, value = fewer, other, base + fit - price * len(fewer)
    return chosen, shares, everything


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` for each row of ``docs`` (``doc_id``, ``text``).

    ``score`` is the answer's share with all languages admitted, ``languages`` the chosen set
    with its shares.
    """
    sent = shipped(docs.sparkSession, model)

    def answer(batches):
        model = pickle.loads(sent.value)
        for batch in batches:
            best, scores, sets = [], [], []
            for text in batch.column(1).to_pylist():
                if not text or not model.languages or not any(map(str.isalpha, text)):
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    sets.append("")
                    continue
                chosen, shares, everything = mixture(model, text)
                top = chosen[int(shares.argmax())]
                best.append(model.languages[top])
                scores.append(float(min(1.0, everything[top])))
                order = np.argsort(-shares, kind="stable")
                sets.append(",".join(f"{model.languages[chosen[k]]}:{shares[k]:.2f}" for k in order))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(answer, "doc_id bigint, lang_pred string, score double, languages string")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the folds that are not held out, answer for all rows."""
    model = trained(docs.filter(remainder("doc_id", FOLDS) != HELD_OUT))
    answers = predicted(docs, model)
    return answers.withColumn("held_out", remainder("doc_id", FOLDS) == HELD_OUT)
