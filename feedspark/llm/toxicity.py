"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is read
in windows of letters inside its words; a window is compressed with either dictionary, and the
saved share of its length says which it resembles. Windows are written as overlapping triples
of letters, so that a few letters are long enough for lengths in whole bytes to differ.

Labels belong to documents, while only a few of a toxic document's words are toxic. The toxic
dictionary is therefore trained on windows with letter groups that toxic texts hold
significantly more often than ordinary ones. How many windows exceed each of several
thresholds, and the largest difference, give the score through a logistic curve that is fitted
on labelled rows not used for the dictionaries.

The dictionaries and the curve are fitted on at most ``SAMPLE`` rows of each class, taken in
the order of a hash of their ids. Everything else reads all rows and whole texts.

Defined results. A null or empty text, or one without letters, has no windows and gets the
curve's value for none. Without labelled rows of both classes every score is 0. Ids labelled
more than once count as toxic if any label is. Repeated rows are scored one by one. Other
columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import remainder, shipped

FOLDS, HELD_OUT = 5, 0
SAMPLE = 3_000
WIDTH, STRIDE, GROUP = 7, 3, 5
LEAST_TEXTS, SIGNIFICANCE = 5, 3.5
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 4_096, 32_768, 12
ORDINARY_WINDOWS = 60_000
EDGES = (0.2, 0.25, 0.3, 0.35, 0.4)
REMEMBERED = 300_000
STEPS, RIDGE = 50, 1e-2

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + WIDTH] for k in range(0, max(1, len(marked) - WIDTH + STRIDE), STRIDE)]


def _groups(piece: str) -> set[str]:
    return {piece[k : k + GROUP] for k in range(max(1, len(piece) - GROUP + 1))}


def _spread(window: str) -> bytes:
    return " ".join(window[k : k + 3] for k in range(max(1, len(window) - 2))).encode("utf-8", "surrogatepass")


def _typical(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    """Letter groups in significantly more toxic texts than their share of ordinary texts lets expect."""
    held = lambda texts: Counter(g for ws in texts for g in set().union(*[_groups(f"^{w}$") for w in set(ws)], set()))
    bad, good = held(toxic), held(ordinary)
    scale = len(toxic) / max(1, len(ordinary))
    out = set()
    for group, n in bad.items():
        expected = scale * (good[group] + 0.5)
        if n >= LEAST_TEXTS and (n - expected) / np.sqrt(expected + 1) >= SIGNIFICANCE:
            out.add(group)
    return out


@dataclass
class Meter:
    """Compresses windows with both dictionaries and remembers words."""

    toxic: bytes
    ordinary: bytes

    def __post_init__(self):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )

        def compressor(content):
            book = zstandard.ZstdCompressionDict(content)
            book.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(compression_params=params, dict_data=book)

        self.compressors = compressor(self.toxic), compressor(self.ordinary)
        self.known: dict[str, tuple] = {}
        self.windows: dict[str, float] = {}

    def saved(self, window: str) -> float:
        got = self.windows.get(window)
        if got is None:
            if len(self.windows) > REMEMBERED:
                self.windows.clear()
            plain = _spread(window)
            toxic, ordinary = (len(c.compress(plain)) for c in self.compressors)
            got = self.windows[window] = (ordinary - toxic) / ordinary
        return got

    def of_word(self, word: str) -> tuple:
        """Windows, the largest difference, and windows above each edge, None if none is."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            values = [self.saved(w) for w in windows(word)]
            most = max(values)
            over = np.array([sum(v > e for v in values) for e in EDGES], float) if most > EDGES[0] else None
            got = self.known[word] = (len(values), most, over)
        return got

    def features(self, text: str | None) -> np.ndarray:
        total, most, over = 0, 0.0, np.zeros(len(EDGES))
        for word, times in Counter(words(text)).items():
            n, largest, above = self.of_word(word)
            total += n * times
            if above is not None:
                over += above * times
                most = max(most, largest)
        return np.concatenate([over / max(1, total) * 20, np.log1p(over), [np.log1p(total), most]])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    centre: np.ndarray
    width: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> float:
        z = np.append((features - self.centre) / self.width, 1.0) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by Newton's steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    ridge = RIDGE * len(x) * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge @ weights
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[str, int]]:
    """Up to ``sample`` labelled texts of each class, in the order of a hash of the id."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(marks, "doc_id")
    out = []
    for toxic in (1, 0):
        ids = marks.filter((F.col("toxic") != 0) == F.lit(bool(toxic))).filter(remainder("doc_id", FOLDS) != HELD_OUT)
        some = ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        held = rows.join(F.broadcast(some), "doc_id", "left_semi").select("doc_id", "text")
        out += [(r["text"], toxic) for r in held.orderBy(F.xxhash64("doc_id"), "text").limit(sample).collect()]
    return out


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled rows of the learning folds; None without both classes."""
    rows = list(dict.fromkeys((" ".join(words(text)), toxic) for text, toxic in _sampled(docs, labels, sample)))
    both = [[text.split() for text, toxic in rows if toxic == k] for k in (1, 0)]
    if min(map(len, both)) < 8:
        return None
    # Of every five texts, three make the dictionaries and two the curve.
    parts = lambda texts, own: [ws for k, ws in enumerate(texts) if (k % 5 < 3) == own]
    toxic, ordinary = parts(both[0], True), parts(both[1], True)
    typical = _typical(toxic, ordinary)
    bad = [_spread(w) for ws in toxic for word in ws for w in windows(word) if _groups(w) & typical]
    good = [_spread(w) for ws in ordinary for word in ws for w in windows(word)]
    good = good[:: max(1, len(good) // ORDINARY_WINDOWS)]
    bad = bad or [_spread(w) for ws in toxic for word in ws for w in windows(word)]
    books = []
    for size, samples in ((TOXIC_BYTES, bad), (ORDINARY_BYTES, good)):
        try:
            books.append(zstandard.train_dictionary(size, samples).as_bytes())
        except zstandard.ZstdError:
            # Too little text to train on: the samples themselves serve as content.
            books.append(b"\n".join(dict.fromkeys(samples))[-size:])
    meter = Meter(*books)
    x, y = [], []
    for k in (0, 1):
        for ws in parts(both[k], False):
            x.append(meter.features(" ".join(ws)))
            y.append(1.0 - k)
    x, y = np.array(x), np.array(y)
    centre, width = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(*books, centre, width, _curve((x - centre) / width, y))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id``, ``text``)."""
    model = trained(docs, labels, sample)
    sent = shipped(docs.sparkSession, model)

    def score(batches):
        model = pickle.loads(sent.value)
        meter = Meter(model.toxic, model.ordinary) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = [model.score(meter.features(t)) if model else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = rows.mapInArrow(score, "doc_id bigint, score double")
    return out.select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
