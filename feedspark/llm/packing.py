"""Packing by best fit of tokens, under two slack capacities.

Texts are tokenized where they are read; only the lengths of the pieces are shuffled. Pieces
are dealt to blocks of bounded size, and each block is packed by itself: in order of length,
a piece goes to the open sequence that it fills best. A sequence has three capacities, tokens,
documents and attention cost (the sum of squared lengths); no piece enters one that any of the
three forbids. At the values below the attention capacity admits whatever the tokens admit, and
the number of documents binds only for pieces of under four tokens on average. At most the last
sequence of a block is badly filled.

Defined results. A null or empty text is the closing token alone. Repeated rows and repeated
ids are packed row by row. A text is cut only if it is longer than a sequence. Other columns
are not read.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import stored

CAPACITY = 4096
END = 1
MOST_DOCUMENTS = 1024
ATTENTION = CAPACITY * CAPACITY
BLOCK_TOKENS = 8_000_000
BLOCK_PIECES = 60_000
WORDS_KEPT = 500_000
STEMS_KEPT = 1_500_000
"""Words and stems that a process remembers; beyond that it starts anew, which costs time only."""
WORDS_AT_ONCE = 4_000
CHARS_AT_ONCE = 1 << 20
MARKS = (".", ",", ";", ":", "!", "?", "%%%", "...", "!?", "'", "\"", ")", "$")
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

_SEPARATORS = re.compile("[\x1c-\x1f]")
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


class Tokenizer:
    """Encodes a text word by word and remembers the ids of the words.

    The tokenizer drops white space before it merges, so the ids of a text are those of its
    words. Words that are not remembered are encoded by the tokenizer itself. A word of Latin
    letters and a run of ASCII marks behind them needs no normalizing but lower case and no
    splitting but before the marks, so its letters go to the merges at once; spellings that
    differ in case or marks share them. The constructor tries whether that holds for the file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as File
        from tokenizers.pre_tokenizers import ByteLevel

        self.file = File.from_file(path)
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.marks = {"": b""}
        letters = [chr(k) for k in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if chr(k).isalpha()]
        probes = [a + b + mark for a, b, mark in zip(letters, letters[7:] + letters[:7], MARKS * len(letters), strict=False)]
        self.plain = all(self._simple(p) == self._encoded(p) for p in [*probes, "Wordlike", "Ähnliches,", "ÉCOLE"])

    def _encoded(self, text: str) -> bytes:
        return np.asarray(self.file.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _simple(self, word: str) -> bytes | None:
        """The ids of a word of letters and a run of marks; None for other words."""
        found = _SIMPLE.fullmatch(word)
        if found is None:
            return None
        stem = found[1].lower()
        ids = self.stems.get(stem)
        if ids is None:
            merged = [t.id for t in self.file.model.tokenize(stem.translate(self.spelled))]
            ids = self.stems[stem] = struct.pack(f"<{len(merged)}I", *merged)
        marks = self.marks.get(found[2])
        if marks is None:
            marks = self.marks[found[2]] = self._encoded(found[2])
        return ids + marks

    @classmethod
    def of_process(cls, path: str) -> "Tokenizer":
        """One tokenizer per worker process: later tasks find the file read and the words known."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_kept_by_path", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts; the words that none of them shares with earlier texts are encoded together."""
        # Python takes four control characters for white space, which the tokenizer does not.
        split = [text.split(" ") if _SEPARATORS.search(text) else text.split() for text in texts]
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        if len(self.stems) > STEMS_KEPT:
            self.stems.clear()
            self.marks = {"": b""}
        new = list(set().union(*split).difference(known))
        if self.plain:
            rest = []
            for word in new:
                ids = self._simple(word)
                if ids is None:
                    rest.append(word)
                else:
                    known[word] = ids
            new = rest
        for at in range(0, len(new), WORDS_AT_ONCE):
            self.learn(new[at : at + WORDS_AT_ONCE])
        return [b"".join([known[w] for w in words]) for words in split]

    def learn(self, words: list[str]) -> None:
        """Encode many words in one call; each takes the tokens that start within it."""
        code = self.file.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.fromiter((start for start, _ in code.offsets), np.int64, len(code.ids))
        cuts = np.searchsorted(starts, ends) * 4
        ids = np.asarray(code.ids, "<u4").tobytes()
        before = 0
        for word, cut in zip(words, cuts.tolist(), strict=True):
            self.known[word] = ids[before:cut]
            before = cut


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenize and cut: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    last = np.array([end], "<u4").tobytes()

    def encode(batches):
        tokenizer = Tokenizer.of_process(path)

        def encoded(batch):
            rows, size = [], 0
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(row)
                size += len(row[1] or "")
                if size >= CHARS_AT_ONCE:
                    yield from zip([r[0] for r in rows], tokenizer.ids([r[1] or "" for r in rows]), strict=True)
                    rows, size = [], 0
            yield from zip([r[0] for r in rows], tokenizer.ids([r[1] or "" for r in rows]), strict=True)

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, codes in encoded(batch):
                codes += last
                for number, at in enumerate(range(0, len(codes), 4 * capacity)):
                    part = codes[at : at + 4 * capacity]
                    row = (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<u4"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            k = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out[:k], kinds[:k], strict=True)], names[:k]
            )

    schema = SCHEMA + (", ids array<bigint>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(encode, schema)


def best_fit(lengths: np.ndarray, capacity: int, most: int, attention: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length.

    Residuals are kept as shares of the three capacities. Among the sequences that can take a
    piece, the one with the smallest norm of what would be left is chosen; pieces come in
    descending order.
    """
    order = np.argsort(-lengths, kind="stable")
    number = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    room = np.zeros((3, 1024), np.float64)
    ids = np.zeros(1024, np.int64)
    full = np.array([capacity, most, attention], np.float64)
    scale = 1 / full
    opened = live = 0
    least = int(lengths.min()) if len(lengths) else 0
    for at in order.tolist():
        length = int(lengths[at])
        need = np.array([length, 1, length * length], np.float64)
        best = -1
        if length + least <= capacity and live:
            left = room[:, :live] - need[:, None]
            fits = (left >= 0).all(axis=0)
            if fits.any():
                norm = ((left * scale[:, None]) ** 2 * np.array([[1.0], [0.01], [0.01]])).sum(axis=0)
                norm[~fits] = np.inf
                best = int(norm.argmin())
        if best < 0:
            number[at], offset[at] = opened, 0
            if length + least <= capacity:
                if live == room.shape[1]:
                    room = np.concatenate([room, np.zeros_like(room)], axis=1)
                    ids = np.concatenate([ids, np.zeros_like(ids)])
                room[:, live], ids[live] = full - need, opened
                live += 1
            opened += 1
            continue
        number[at], offset[at] = ids[best], capacity - int(room[0, best])
        room[:, best] -= need
        if room[0, best] < least or room[1, best] < 1 or room[2, best] < least * least:
            live -= 1
            room[:, best], ids[best] = room[:, live], ids[live]
    return number, offset


def packed(
    cut: DataFrame, capacity: int = CAPACITY, most: int = MOST_DOCUMENTS, attention: int = ATTENTION
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces."""
    total = cut.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    blocks = max(1, -(-(total["tokens"] or 0) // BLOCK_TOKENS), -(-total["n"] // BLOCK_PIECES))
    # Rows are dealt out in turn, so repeated ids or texts cannot fill one block.
    place = F.monotonically_increasing_id()
    dealt = cut.withColumn("block", F.pmod(F.xxhash64(place), F.lit(blocks)))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        number, offset = best_fit(block["length"].to_numpy(), capacity, most, attention)
        base = int(block["block"].iloc[0]) << 32
        return block.drop(columns="block").assign(sequence_id=base + number, offset=offset)

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields]
    schema = ", ".join([*names, "sequence_id bigint", "offset bigint"])
    return dealt.groupBy("block").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (``doc_id``, ``text``)."""
    return packed(stored(pieces(docs, path)))
