"""Spelling variants: edits of every word, probed against Bloom filters, verified by a join.

Words are counted where texts are read. Every word then proposes its neighbours: each string
with one letter left out, and each with one letter replaced by a greater one of the corpus's
alphabet. Two words that differ by one inserted, deleted or replaced letter are met exactly
once that way, from the longer word or from the one with the smaller letter. A polynomial
hash gives the hash of every edit from the hashes of a word's prefixes and suffixes, so edits
are spelled out only if a filter admits them.

Filters are blocked: the words of one length share a shard, a word sets ``PROBES`` bits within
one 512-bit block of it. Shards are dealt to passes of at most ``PASS_BYTES``; a shard larger
than that is divided by hash, and an edit is probed in the pass that holds its part. So what
is broadcast is bounded, whatever the vocabulary; results do not depend on the passes. Only
admitted edits are shuffled to the exact join with the vocabulary, which drops the false ones.

A word's form is its most frequent neighbour, if that is ``RATIO`` times as frequent; the root
is the end of the chain of forms. Frequencies grow tenfold along it, so pointers are doubled a
few times only.

Defined results. Null and empty texts have no words. A null id is spelled as empty text. Rows
count one by one, repeated ones too. Ties between forms go to the smallest word in code-point
order. Texts and words of any length are read whole. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import column, dropped, stored, text_of

LETTERS = "[A-Za-zÀ-ÿ]+"
DAMAGED = 31
LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10
PASS_BYTES = 32 << 20
BITS_PER_WORD = 24
PROBES = 6
BLOCK_BITS = 512
EDITS_AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words that count, after damage; pre-aggregated before the shuffle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(F.translate(text_of("text"), upper, lower), F.lit(LETTERS), 0)
    long_runs = F.filter(runs, lambda w: F.char_length(w) >= LEAST_CHARS)
    tokens = docs.select(name.alias("name"), F.explode(long_runs).alias("run"))
    hashed = tokens.select("run", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, int(h % char_length(run))), substring(run, int(h % char_length(run)) + 2))")
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.char_length("word") >= LEAST_CHARS) & (F.col("n") >= LEAST_COUNT))


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _BASE)]), dtype=np.uint64)


def _coded(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, one row each, plus one so that no letter is 0."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


def _by_length(batches):
    """The words of a task, a bounded number at a time, by length."""
    waiting: dict[int, list] = {}
    for batch in batches:
        for word in batch.column(0).to_pylist():
            group = waiting.setdefault(len(word), [])
            group.append(word)
            if len(group) >= 4096:
                yield len(word), waiting.pop(len(word))
    yield from waiting.items()


class Shards:
    """Where the words of each length lie: first block, number of blocks, and passes."""

    def __init__(self, counts: dict[int, int], bytes_per_pass: int):
        self.at: dict[int, tuple[int, int]] = {}
        total = 0
        for length, n in sorted(counts.items()):
            blocks = -(-n * BITS_PER_WORD // BLOCK_BITS)
            self.at[length] = (total, blocks)
            total += blocks
        self.blocks = total
        self.per_pass = max(1, bytes_per_pass * 8 // BLOCK_BITS)
        self.passes = -(-total // self.per_pass)

    def held(self, length: int, number: int) -> bool:
        """Whether a pass holds a part of the shard of one length."""
        first, blocks = self.at.get(length, (0, 0))
        return first < (number + 1) * self.per_pass and first + blocks > number * self.per_pass and blocks > 0

    def place(self, length: int, scrambled: np.ndarray) -> np.ndarray:
        """The block of each hash; blocks of one length are a shard."""
        first, blocks = self.at[length]
        return np.uint64(first) + (scrambled >> np.uint64(40)) % np.uint64(blocks)


def _bits(scrambled: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit of a hash inside its block, from two halves of its low part."""
    one, two = scrambled & np.uint64(0xFFFF), (scrambled >> np.uint64(16)) & np.uint64(0xFFFF) | np.uint64(1)
    return (one + np.uint64(k) * two + np.uint64(k * k)) % np.uint64(BLOCK_BITS)


def _filter(vocab: DataFrame, shards: Shards, number: int) -> np.ndarray:
    """The blocks of one pass as an array of 64-bit words; bounded by ``PASS_BYTES``."""
    low, high = number * shards.per_pass, min(shards.blocks, (number + 1) * shards.per_pass)
    per_block = BLOCK_BITS // 64

    def set_bits(batches):
        for length, words in _by_length(batches):
            if not shards.held(length, number):
                continue
            codes = _coded(words, length)
            hashed = _scrambled((codes * _powers(length)[:length]).sum(axis=1, dtype=np.uint64))
            block = shards.place(length, hashed)
            own = (block >= low) & (block < high)
            hashed, block = hashed[own], block[own] - np.uint64(low)
            for k in range(PROBES):
                bit = _bits(hashed, k)
                at = block * np.uint64(per_block) + (bit >> np.uint64(6))
                mask = np.uint64(1) << (bit & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    sums = vocab.select("word").mapInArrow(set_bits, "at bigint, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    table = sums.toArrow()
    bits = np.zeros((high - low) * per_block, np.uint64)
    bits[column(table, "at")] = column(table, "mask").view(np.uint64)
    return bits


def _admitted(vocab: DataFrame, shards: Shards, number: int, alphabet: list[int]) -> DataFrame:
    """``a, b``: words and those of their edits that the filter of one pass admits."""
    low, high = number * shards.per_pass, (number + 1) * shards.per_pass
    per_block = BLOCK_BITS // 64
    shipped = vocab.sparkSession.sparkContext.broadcast(_filter(vocab, shards, number))
    letters = np.array(sorted(alphabet), np.uint64)

    def probe(length: int, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be words of ``length``."""
        filled = shipped.value
        mixed = _scrambled(hashes)
        block = shards.place(length, mixed)
        index = np.flatnonzero((block >= low) & (block < high))
        for k in range(PROBES):
            bit = _bits(mixed[index], k)
            at = (block[index] - np.uint64(low)) * np.uint64(per_block) + (bit >> np.uint64(6))
            index = index[(filled[at] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        return index

    def edits(batches):
        for length, words in _by_length(batches):
            step = max(1, EDITS_AT_ONCE // (length * len(letters)))
            for start in range(0, len(words), step):
                part = words[start : start + step]
                codes, power = _coded(part, length), _powers(length)
                terms = codes * power[:length]
                whole = terms.sum(axis=1, dtype=np.uint64)
                found: list[tuple[str, str]] = []
                # A greater letter at each place.
                if shards.held(length, number):
                    for i in range(length):
                        greater = letters[None, :] > codes[:, i, None]
                        row, letter = np.nonzero(greater)
                        hashes = whole[row] + (letters[letter] - codes[row, i]) * power[i]
                        for hit in probe(length, hashes).tolist():
                            word = part[row[hit]]
                            found.append((word, word[:i] + chr(int(letters[letter[hit]])) + word[i + 1 :]))
                # A letter left out; of equal neighbours only the first.
                if shards.held(length - 1, number):
                    before = np.zeros(len(part), np.uint64)
                    behind = (codes[:, 1:] * power[: length - 1]).sum(axis=1, dtype=np.uint64)
                    for i in range(length):
                        own = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(part))
                        for hit in probe(length - 1, (before + behind)[own]).tolist():
                            word = part[own[hit]]
                            found.append((word, word[:i] + word[i + 1 :]))
                        before = before + terms[:, i]
                        if i + 1 < length:
                            behind = behind - codes[:, i + 1] * power[i]
                a, b = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.string()), pa.array(list(b), pa.string())], ["a", "b"])

    return vocab.select("word").mapInArrow(edits, "a string, b string")


def near_pairs(vocab: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``a, b, na, nb``: every two words of a stored vocabulary one edit apart, once."""
    lengths = vocab.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()
    shards = Shards({r["length"]: r["n"] for r in lengths}, pass_bytes)
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = [ord(r["c"]) for r in letters.collect()]
    left = vocab.select(F.col("word").alias("a"), F.col("n").alias("na"))
    right = vocab.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    proposed = [_admitted(vocab, shards, k, alphabet) for k in range(shards.passes)]
    if not proposed:
        return left.join(right, F.lit(False))
    edits = proposed[0]
    for more in proposed[1:]:
        edits = edits.unionAll(more)
    return edits.join(right, "b").join(left, "a").select("a", "b", "na", "nb")


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form, by doubling pointers; ``forms`` is ``word, form``."""
    jumps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(jumps.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        dropped(jumps)
        jumps = after.drop("moved")
        if not after.filter("moved").limit(1).count():
            return jumps


def grouped(docs: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    vocab = stored(vocabulary(docs))
    pairs = near_pairs(vocab, pass_bytes)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")),
    )
    both = pairs.select(F.inline(sides))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= F.col("n") * RATIO
    words = stored(
        vocab.join(found, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = rooted(words.filter("form IS NOT NULL").select("word", "form"))
    out = words.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
