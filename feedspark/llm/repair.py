"""Repair of conversations by lightest derivations.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its rows may be kept,
given another role or deleted, and empty turns may be inserted, each at a cost. A repair is a
derivation: an item says how many rows are used and which role came last, an edit is a further
antecedent, and the conclusion weighs (cost, audit), the audit being the initials of the edits
so far. Both parts only grow, and of two weights of one item the smaller stays the smaller
whatever is appended: with equal costs neither audit is the beginning of the other, since a
longer one would hold inserted turns at a cost. So the agenda may finalise items in the order
of their weights (Knuth's generalisation of Dijkstra's search), and it ends with the goals.

A conversation may hold a third of all rows. Rows are numbered, and blocks of ``BLOCK`` rows
are searched by themselves, wherever they lie, from each role that may come before the block.
What a block leaves is at most sixteen weights; the same agenda then chains the blocks of a
conversation. Only roles, flags and digests go there. Texts meet the audit in a sorted stream
that holds one row at a time.

Defined results. A null in any column is one space, also in the text that decides on damage;
a null ``conv_id`` is a conversation of its own. Rows are ordered by turn, nulls first, then by
role and text, so repeated rows and ties have one result. Empty roles and other initials than
s, u, a fit nowhere and are given another role or deleted. Texts of any length are read whole.
Further columns are not read; without rows there is no result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import stored
from feedspark.operators.ranking import positions

BLOCK = 512
DAMAGE = 20
DROP, EMPTY, UNSTOP, REPEAT, USER = range(5)

# What edits cost, and which initials may follow each other.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
START = ""
STATES = (START, "s", "u", "a")
GOALS = (START, "a")
ROLES = {"u": "user", "a": "assistant"}
BATCH_CHARS = 1 << 22

Weight = tuple[int, str]


def _spelled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the damage that the checksum of a row decides."""
    kind = F.pmod(F.crc32(F.concat(_spelled("conv_id"), F.lit(":"), _spelled("turn")).cast("binary")), F.lit(DAMAGE))
    rows = conversations.select("conv_id", "turn", _spelled("role").alias("role"), _spelled("text").alias("text"), kind.alias("_kind"))
    text = (
        F.when(F.col("_kind") == EMPTY, "")
        .when(F.col("_kind") == UNSTOP, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    times = F.array_repeat(F.lit(0), F.when(F.col("_kind") == REPEAT, 2).otherwise(1))
    return rows.filter(F.col("_kind") != DROP).select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == USER, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.posexplode(times).alias("copy", "_zero"),
    ).drop("_zero")


def _key() -> Column:
    """Conversations as text, so that null is a key that joins."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")


def ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the faults (``key, pos, initial, fault``) and of the numbered rows."""
    plain = rows.select(_key(), "turn", _spelled("role").alias("role"), _spelled("text").alias("text"))
    placed = positions(plain, ["key"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "pos")
    marked = stored(
        placed.select(
            "*",
            F.substring("role", 1, 1).alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("unfinished"),
            F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256).alias("digest"),
        )
    )
    firsts = marked.groupBy("key", "digest").agg(F.min("pos").alias("first"))
    flags = marked.select("key", "pos", "digest", "initial", "blank", "unfinished").join(firsts, ["key", "digest"])
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("pos"), "duplicate").when(F.col("unfinished"), "truncated")
    return stored(flags.select("key", "pos", "initial", fault.alias("fault"))), marked


def lightest(
    axioms: Iterable[tuple[Weight, object]],
    conclusions: Callable[[object], Iterable[tuple[object, int, str]]],
    goals: set,
) -> dict[object, Weight]:
    """Final weights of the goals: items leave the agenda in the order of (cost, audit)."""
    agenda = [(cost, audit, k, item) for k, ((cost, audit), item) in enumerate(axioms)]
    heapq.heapify(agenda)
    best: dict = {}
    final: dict = {}
    missing = set(goals)
    number = len(agenda)
    while agenda and missing:
        cost, audit, _, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        missing.discard(item)
        for to, more, step in conclusions(item):
            weight = (cost + more, audit + step)
            if to not in final and (to not in best or weight < best[to]):
                best[to] = weight
                number += 1
                heapq.heappush(agenda, (*weight, number, to))
    return {item: final[item] for item in goals if item in final}


def _next(state: str) -> str:
    return "a" if state == "u" else "u"


def _fits(state: str, initial: str) -> bool:
    return initial in ("s", "u") if state == START else state + initial in LEGAL


def searched(rows: list[tuple[str, str | None]], entry: str) -> dict[str, Weight]:
    """The lightest way through a block of (initial, fault) rows, for each role it may end with."""

    def conclusions(item):
        used, state = item
        yield (used, _next(state)), INSERT, "I"
        if used == len(rows):
            return
        initial, fault = rows[used]
        yield (used + 1, state), DELETE, "D"
        if fault in ("blank", "duplicate"):
            return
        more = TRUNCATED if fault == "truncated" else 0
        yield (used + 1, _next(state)), REROLE + more, "R"
        if _fits(state, initial):
            yield (used + 1, initial), more, "K"

    goals = {(len(rows), state) for state in STATES}
    found = lightest([((0, ""), (0, entry))], conclusions, goals)
    return {state: weight for (_, state), weight in found.items()}


_MOVES = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_SUMMARY = "key string, block bigint, first string, last string, illegal bigint, moves array<struct<entry:string,exit:string,cost:bigint,audit:string>>"


def _runs(batches, keys: int):
    """Rows of sorted batches, grouped by their first columns; a group is gathered as it ends."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def _summarised(batches):
    for (key, block), rows in _runs(batches, 2):
        own = [(initial, fault) for _, initial, fault in rows]
        entries = STATES if block else (START,)
        moves = [
            {"entry": entry, "exit": state, "cost": cost, "audit": audit}
            for entry in entries
            for state, (cost, audit) in searched(own, entry).items()
        ]
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(own, own[1:], strict=False))
        columns = [[key], [block], [own[0][0]], [own[-1][0]], [illegal]]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array([moves], _MOVES)]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "block", "first", "last", "illegal", "moves"])


def _chained(batches):
    """Walk the blocks of each conversation in order, keeping one weight per last role."""

    def step(front: dict[str, Weight], moves) -> dict[str, Weight]:
        by_entry: dict[str, list] = {}
        for move in moves:
            by_entry.setdefault(move["entry"], []).append(move)

        def conclusions(item):
            side, state = item
            if side == 0:
                for move in by_entry.get(state, []):
                    yield (1, move["exit"]), move["cost"], move["audit"]

        axioms = [(weight, (0, state)) for state, weight in front.items()]
        found = lightest(axioms, conclusions, {(1, state) for state in STATES})
        return {state: weight for (_, state), weight in found.items()}

    def result():
        cost, audit = min(front[state] for state in GOALS if state in front)
        arrays = [pa.array([key]), pa.array([illegal], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit])]
        return pa.RecordBatch.from_arrays(arrays, ["key", "illegal", "cost", "audit"])

    key, front, illegal, before = None, {}, 0, None
    for batch in batches:
        for own, _, first, last, inside, moves in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != key:
                if key is not None:
                    yield result()
                key, front, illegal, before = own, {START: (0, "")}, 0, None
            illegal += inside + (before is not None and before + first not in LEGAL)
            before = last
            front = step(front, moves)
    if key is not None:
        yield result()


def audited(flags: DataFrame) -> DataFrame:
    """``key, illegal, cost, audit`` of every conversation with rows."""
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    rows = flags.select("key", block, "pos", "initial", "fault")
    blocks = rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos").mapInArrow(_summarised, _SUMMARY)
    chains = blocks.repartition("key").sortWithinPartitions("key", "block")
    return chains.mapInArrow(_chained, "key string, illegal bigint, cost bigint, audit string")


def _edited(batches):
    """Apply audits to the rows that follow them."""
    names, out, size = ["key", "place", "role", "text"], [], 0

    def flush():
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    key, audit, at, state, place = None, "", 0, START, 0

    def put(role: str, text: str):
        nonlocal state, place, size
        out.append((key, place, role, text))
        state, place, size = role[:1], place + 1, size + len(text) + 64

    def insert():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(ROLES[_next(state)], "")
            at += 1

    for batch in batches:
        for own, _, role, text, given in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if given is not None:
                insert()
                key, audit, at, state, place = own, given, 0, START, 0
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(role if edit == "K" else ROLES[_next(state)], text)
            if size >= BATCH_CHARS:
                yield flush()
                out.clear()
                size = 0
    insert()
    yield flush()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``key, place, role, text``, in order within a partition.

    ``rows`` are the numbered rows, ``audits`` the result of ``audited``; an audit leads the
    rows of its conversation.
    """
    none = F.lit(None).cast("string")
    heads = audits.select("key", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit")
    both = rows.select("key", "pos", "role", "text", none.alias("audit")).unionByName(heads)
    sorted_ = both.repartition("key").sortWithinPartitions("key", "pos")
    return sorted_.mapInArrow(_edited, "key string, place bigint, role string, text string")


def _hashed(batches):
    key, whole = None, None

    def result():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([whole.hexdigest()])], ["key", "repaired_sha256"])

    for batch in batches:
        for own, place, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != key:
                if key is not None:
                    yield result()
                key, whole = own, hashlib.sha256()
            line = f"{role}:{text}"
            whole.update((line if place == 0 else "\n" + line).encode("utf-8", "surrogatepass"))
    if key is not None:
        yield result()


def digests(turns: DataFrame) -> DataFrame:
    """``key, repaired_sha256`` of the conversations in the order in which ``repaired`` leaves them."""
    return turns.mapInArrow(_hashed, "key string, repaired_sha256 string")


def reported(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults of ``rows``, and their repair."""
    flags, numbered = ordered(rows)
    audits = stored(audited(flags))
    shas = digests(repaired(numbered, audits))
    faults = flags.groupBy("key").agg(
        *[F.count_if(F.col("fault") == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")]
    )
    turn = F.col("turn").cast("long")
    spans = numbered.groupBy("key").agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    every = conversations.select("conv_id").distinct().select("conv_id", _key())
    out = every
    for part in (spans, faults, audits, shas):
        out = out.join(part, "key", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    empty = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id",
        *[zero(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
