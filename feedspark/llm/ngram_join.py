"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order: those of few texts first, frequent ones last. Two
texts above the threshold share an n-gram among the first quarter of each, so only that
prefix of every text is shuffled. The order is cut into fragments; the overlap of a pair is
counted fragment by fragment and summed, so that no row holds a whole long text.

Texts with equal n-gram sets are one node from the start, so exact copies cost nothing. A
large group of near copies is not expanded into pairs: each text is compared with one hub of
its group first, and only texts that are still in different components are compared with
each other. That loses no link that matters to a component: a pair that is skipped is
connected already.

Defined results. A null or blank text has no n-grams, size 0, and is its own component. A
text with fewer words than ``n`` has one n-gram, the whole sequence. Repeated rows each get a
row. A null id takes part, but is never the smallest id. Other columns are not read.
N-grams and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import UPPER_TO_LOWER, column, dropped, row_key, stored, text_of
from feedspark.llm.components import components
from feedspark.session import materialize

N = 5
PERCENT = 75
FRAGMENTS = 8
FREQUENT_AT = 8
"""An n-gram found in so many texts comes last in the global order."""
FREQUENT_MOST = 500_000
"""Only the most frequent ones are sent to the tasks; the order of the rest changes no result."""
CHUNK = 1_000_000
FIRST_COLUMNS = ["row_key", "doc_id", "n_shingles", "sig", "gram", "texts"]
WORDS_CACHED = 200_000
ROWS_AT_ONCE = 1_000
FILTER_BITS = 1 << 26
GRAM_BITS = 1 << 27
"""Sizes of the two bitmaps: 8 and 16 MB in every task, whatever the input."""


class _WordHashes(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_digest(word)
        return value


# Odd factors, one for each place in an n-gram, from powers of a fixed odd number.
def _factors(n: int) -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(n)], np.uint64)


def _grams(text: bytes | None, n: int, cache: _WordHashes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    words = text.translate(UPPER_TO_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > WORDS_CACHED:
        cache.clear()
    h = np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint64)
    width = min(n, len(h))
    factors = _factors(width)
    total = h[: len(h) - width + 1] * factors[0]
    for k in range(1, width):
        total += h[k : len(h) - width + 1 + k] * factors[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _signature(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(grams.tobytes()))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_of("text").cast("binary").alias("text"))


def _cut(batches, n: int, at: int = 0):
    """For some rows at a time: the batch, and the n-grams of each text (column ``at``)."""
    cache = _WordHashes()
    for batch in _sliced(batches):
        yield batch, [_grams(text, n, cache) for text in batch.column(at).to_pylist()]


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds from one reading of the texts, stored.

    Per row of ``docs``: key, id, set size and the set's signature, null for an empty set. And
    ``gram, texts`` of n-grams that texts of one task share: each task counts its own rows, every
    different text once, and passes on what two or more of them share.
    """

    def cut(batches):
        seen, held, size = set(), [], 0

        def rows_of(batch, sizes, marks):
            nulls = pa.nulls(batch.num_rows, pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), nulls, nulls]
            return pa.RecordBatch.from_arrays(columns, FIRST_COLUMNS)

        def shared():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts > 1
            nulls = pa.nulls(int(keep.sum()), pa.int64())
            columns = [nulls] * 4 + [pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, FIRST_COLUMNS)

        for batch, sets in _cut(batches, n, 2):
            marks = [_signature(grams) if len(grams) else None for grams in sets]
            yield rows_of(batch, [len(grams) for grams in sets], marks)
            for mark, grams in zip(marks, sets, strict=True):
                if mark is None or mark in seen:
                    continue
                seen.add(mark)
                held.append(grams)
                size += len(grams)
                if size >= CHUNK:
                    yield shared()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield shared()

    rows = docs.select(
        row_key().alias("row_key"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").cast("binary")
    )
    return stored(rows.mapInArrow(cut, ", ".join(f"{name} bigint" for name in FIRST_COLUMNS)))


def _sliced(batches):
    """Smaller batches, so that a task's arrays stay small beside the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that many texts share, sorted, and the place of each by its count, least first.

    Only texts of one task are seen to share an n-gram (``_first_pass``). The counts steer the
    order only, never the result.
    """
    top = (
        counted.groupBy("gram")
        .agg(F.sum("texts").alias("texts"))
        .filter(F.col("texts") >= FREQUENT_AT)
        .orderBy(F.desc("texts"), "gram")
        .limit(FREQUENT_MOST)
    )
    values = column(top.select("gram").toArrow(), "gram").view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - 1 - order).astype(np.int32)


def _place(values: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where n-grams stand in the global order: -1 for all that are not frequent, which follow their hashes."""
    known, places = frequent
    if not len(known):
        return np.full(len(values), -1, np.int32)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, places[at], np.int32(-1))


def _prefix_grams(docs: DataFrame, n: int, percent: int, frequent, bitmap: np.ndarray | None = None) -> DataFrame:
    """``gram, sig, n, at, often, rare, part, rank``: the first n-grams of every set in the global order, those with a bit if a bitmap is given.

    ``at`` is the n-gram's place in its set, from 0, ``often`` whether it is one of the frequent
    ones, ``rare`` how many of the set are not, and ``part`` the signature of those that are.

    ``rank`` tells how many of a thousand have a bit: an original shares more with its altered
    copies than they share with each other.
    """
    context = docs.sparkSession.sparkContext
    sent, bits = context.broadcast(frequent), context.broadcast(bitmap)

    def cut(batches):
        for _, sets in _cut(batches, n):
            firsts, spots, counts, ranks, often, rares, parts = [], [], [], [], [], [], []
            sets = [grams for grams in sets if len(grams)]
            for grams in sets:
                keep = len(grams) - -(-percent * len(grams) // 100) + 1
                place = _place(grams, sent.value)
                chosen = np.argsort(place, kind="stable")[:keep]
                first, common = grams[chosen], place[chosen] >= 0
                parts.append(_signature(grams[place >= 0]))
                rares.append(int((place < 0).sum()))
                whole = len(first)
                spot = np.arange(whole, dtype=np.int32)
                if bits.value is not None:
                    hit = _has_bit(bits.value, first.view(np.int64))
                    first, spot, common = first[hit], spot[hit], common[hit]
                firsts.append(first)
                spots.append(spot)
                often.append(common)
                counts.append(len(first))
                ranks.append(1000 * len(first) // whole)
            marks = np.array([_signature(grams) for grams in sets], np.int64)
            sizes = np.array([len(grams) for grams in sets], np.int32)
            flat = np.concatenate(firsts) if firsts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat.view(np.int64)),
                    pa.array(np.repeat(marks, counts)),
                    pa.array(np.repeat(sizes, counts)),
                    pa.array(np.concatenate(spots) if spots else np.empty(0, np.int32)),
                    pa.array(np.concatenate(often) if often else np.empty(0, bool)),
                    pa.array(np.repeat(np.array(rares, np.int32), counts)),
                    pa.array(np.repeat(np.array(parts, np.int64), counts)),
                    pa.array(np.repeat(np.array(ranks, np.int32), counts)),
                ],
                ["gram", "sig", "n", "at", "often", "rare", "part", "rank"],
            )

    schema = "gram bigint, sig bigint, n int, at int, often boolean, rare int, part bigint, rank int"
    return _texts(docs).mapInArrow(cut, schema)


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each key (one bigint column); its size is fixed, so it may be sent to every task."""
    at = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    rows = (
        keys.select(F.floor(at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("ones"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[column(rows, "word")] = column(rows, "ones")
    return out


def _has_bit(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % (len(bitmap) * 64)
    return (bitmap[at // 64] >> (at % 64)) & 1 == 1


def _shared(docs: DataFrame, n: int, percent: int, frequent) -> DataFrame:
    """``gram, sig, n, at, often, rare, part, hub`` of the prefix n-grams that two or more sets have in their prefixes.

    The hub of an n-gram is the one of its sets whose prefix is shared most.

    Most n-grams occur once. A bitmap of the others, of fixed size, keeps them out of the
    second shuffle; a full bitmap would only let more rows through to the exact test.
    """
    grams = _prefix_grams(docs, n, percent, frequent).select("gram")
    bitmap = _bitmap(grams.groupBy("gram").count().filter("count > 1").select("gram"), GRAM_BITS)
    rows = stored(_prefix_grams(docs, n, percent, frequent, bitmap).distinct())
    hubs = rows.groupBy("gram").agg(
        F.max(F.struct("rank", "sig", "n")).alias("hub"), F.min("sig").alias("least"), F.max("sig").alias("most")
    )
    several = hubs.filter("least <> most").select("gram", F.struct("hub.sig", "hub.n").alias("hub"))
    out = stored(rows.drop("rank").join(several, "gram"))
    dropped(rows)
    return out


def _segments(docs: DataFrame, n: int, pairs: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """The sets of some pairs, cut by fragments of the global order: rare n-grams by hash range, then frequent ones.

    Only one text of each set that a pair names is cut again. They are known by a bitmap of their
    rows' keys, which has a fixed size; what it lets through beyond them is not joined.
    """
    context = docs.sparkSession.sparkContext
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    keys = sets.join(ends, "sig", "left_semi").groupBy("sig").agg(F.min("row_key").alias("row_key"))
    sent, bits = context.broadcast(frequent), context.broadcast(_bitmap(keys.select("row_key"), FILTER_BITS))

    def wanted(batches):
        for batch in batches:
            yield batch.filter(pa.array(_has_bit(bits.value, batch.column(0).to_numpy())))

    def cut(batches):
        for _, held in _cut(wanted(batches), n, 1):
            out, numbers, parts = [], [], []
            for grams in held:
                if not len(grams):
                    continue
                mark = _signature(grams)
                zone = (grams >> np.uint64(56)).astype(np.int64) * (FRAGMENTS - 1) // 256
                zone[_place(grams, sent.value) >= 0] = FRAGMENTS - 1
                for k in np.unique(zone).tolist():
                    out.append(mark)
                    numbers.append(k)
                    parts.append(grams[zone == k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.int64()), pa.array(numbers, pa.int32()), _lists(parts)], ["sig", "fragment", "grams"]
            )

    rows = docs.select(row_key().alias("row_key"), text_of("text").cast("binary").alias("text"))
    cuts = rows.mapInArrow(cut, "sig bigint, fragment int, grams array<bigint>")
    return cuts.groupBy("sig", "fragment").agg(F.first("grams").alias("grams"))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs above the threshold: overlaps counted by fragment, summed by pair."""
    left = segments.select(F.col("sig").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("sig").alias("b"), "fragment", F.col("grams").alias("gb"))
    # One exchange of the segments serves their sum and both joins: all three go by set and fragment.
    cut = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    partial = (
        cut.join(left, ["a", "fragment"])
        .join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("shared"))
    )
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("o"))
    return total.filter(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def _overlap(na: str, nb: str, percent: int) -> Column:
    """The least overlap of two sets above the threshold; whole numbers only, so nothing is rounded."""
    over = 100 + percent
    return F.expr(f"(({na} + {nb}) * {percent}L + {over - 1}L) div {over}L")


def _least_shared(percent: int, na: str = "na", nb: str = "nb") -> Column:
    """How many n-grams two sets above the threshold have in common within both prefixes, at least."""
    larger = F.expr(f"(greatest({na}, {nb}) * {percent}L + 99L) div 100L")
    return F.greatest(F.lit(1), _overlap(na, nb, percent) + 1 - larger)


def _needed(percent: int, na: str = "na", nb: str = "nb") -> Column:
    """The number ``k`` of common n-grams that a pair must show: half of the least, and one at least.

    Two sets with overlap ``o`` have ``k`` of it among the first ``n - o + k`` of each, so
    nothing beyond these places needs to be met.
    """
    return F.greatest(F.lit(1), F.floor(_least_shared(percent, na, nb) / 2))


def _hub_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Each set with the hub that most of its prefix names: the set of each n-gram that shares most.

    Hubs are a shortcut; pairs that they miss are found among the open pairs.
    """
    named = (
        prefixes.filter(f"sig <> hub.sig AND 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
        .groupBy(F.col("sig").alias("a"), F.col("hub.sig").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
        .count()
        .filter(F.col("count") * 2 >= _least_shared(percent))
    )
    best = named.groupBy("a", "na").agg(F.max_by(F.struct("b", "nb"), F.struct("count", "b")).alias("hub"))
    return best.select("a", "hub.b", "na", "hub.nb")


def _open_pairs(prefixes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may reach the threshold, as many as connectedness needs.

    Of each n-gram's texts, those outside its largest component are compared with others.

    Two linked sets share an n-gram among the first ``n - overlap + 1`` of each. Few texts share a
    rare n-gram, and all of these are compared; among some more places they share ``k``, and
    where these places hold rare ones only, fewer are not enough. A frequent n-gram is met among
    the first ``n - overlap + 1`` places only: near copies that differ too much to be linked
    have their own, rare n-grams there, while a few more places would make pairs of all of them.

    Rare n-grams come first, so two sets that meet there by frequent ones alone have no other
    in common. The frequent part of a set is the same for many.
    Of the sets with one frequent part the smallest stands for all of them: let x and y be
    linked by frequent n-grams alone, m and k stand for their parts, and m be no larger than
    k. Then m is no larger than y either, and shares all that x and y share with both, so
    both are linked with m. So by frequent n-grams only pairs with such a set are formed.
    """
    placed = prefixes.join(roots, prefixes.sig == roots.node, "left").select(
        "gram", "sig", "n", "at", "often", "rare", "part", F.coalesce("root", "sig").alias("root")
    )
    sizes = placed.groupBy("gram", "root").count()
    mains = sizes.groupBy("gram").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")
    )
    live = materialize(placed.join(mains.filter("parts > 1").drop("parts"), "gram"))
    common = live.filter("often")
    smallest = common.groupBy("part").agg(F.min(F.struct("n", "sig")).alias("least")).select("part", F.col("least.sig").alias("stands"))
    common = common.join(smallest, "part").withColumn("stands", F.col("stands") == F.col("sig"))
    overlap, needed = _overlap("nx", "ny", percent), _needed(percent, "nx", "ny")
    # What stands before and behind the common n-gram bounds the overlap of both sets.
    most = F.least("ax", "ay") + F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))

    def met(left: DataFrame, right: DataFrame, once: Column, k: Column) -> DataFrame:
        """Pairs that share an n-gram early enough; ``once`` leaves one of the two orders."""
        names = {"sig": "", "n": "n", "at": "a", "root": "r", "rare": "f", "stands": "s"}
        side = lambda rows, end: rows.select(
            "gram", *["main"] * (end == "x"), *[F.col(c).alias(short + end) for c, short in names.items() if c in rows.columns]
        )
        first = F.col("x") < F.col("y")
        return (
            side(left.filter("root <> main"), "x").join(side(right, "y"), "gram").filter(
                (F.col("rx") != F.col("ry"))
                & once
                & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
                & (F.col("ax") < F.col("nx") - overlap + k)
                & (F.col("ay") < F.col("ny") - overlap + k)
                & (most >= overlap)
            )
            .withColumn("only_rare", (F.col("nx") - overlap + needed <= F.col("fx")) | (F.col("ny") - overlap + needed <= F.col("fy")))
            .select(
                F.least("x", "y").alias("a"),
                F.greatest("x", "y").alias("b"),
                F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"),
                F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"),
                "only_rare",
            )
        )

    ordered = (F.col("ry") == F.col("main")) | (F.col("x") < F.col("y"))
    seldom, ends = live.filter("NOT often"), ["a", "b", "na", "nb"]
    rare = met(seldom, seldom, ordered, needed).groupBy(*ends).agg(F.count("*").alias("count"), F.bool_or("only_rare").alias("only_rare"))
    rare = rare.filter(~F.col("only_rare") | (F.col("count") >= _needed(percent))).select(*ends)
    # With one that stands for its part, from either side; two such ones meet once.
    one = met(common, common.filter("stands"), ~F.col("sx") | ordered, F.lit(1))
    two = met(common.filter("stands"), common.filter("NOT stands"), F.col("ry") == F.col("main"), F.lit(1))
    return rare.unionByName(one.unionByName(two).select(*ends)).distinct()


def _grouped(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``row_key, doc_id, n_shingles, sig`` of all rows, and ``node, root`` of the signatures that are linked.

    The n-grams of all texts take more room than the texts. They are cut anew for each of
    three passes, and those of the sets in question for two more, and never stored; ``docs``
    should be a table that is cheap to read.
    """
    passed = _first_pass(docs, n)
    sets = passed.filter("gram IS NULL").select("row_key", "doc_id", "n_shingles", "sig")
    frequent = _frequent(passed.filter("gram IS NOT NULL").select("gram", "texts"))
    prefixes = _shared(docs, n, percent, frequent)
    hubs = materialize(_hub_pairs(prefixes, percent))
    first = materialize(_linked(hubs, _segments(docs, n, hubs, sets, frequent), percent))
    roots = materialize(components(first))
    others = materialize(_open_pairs(prefixes, roots, percent))
    second = materialize(_linked(others, _segments(docs, n, others, sets, frequent), percent))
    dropped(prefixes)
    return sets, components(first.unionByName(second))


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id``, ``text``)."""
    sets, roots = _grouped(docs, n, percent)
    lone = sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = sets.filter("n_shingles > 0").select("doc_id", "n_shingles", "sig")
    lowest = full.groupBy("sig").agg(F.min("doc_id").alias("least_id"))
    rooted = lowest.join(roots, lowest.sig == roots.node, "left").select(
        "sig", "least_id", F.coalesce("root", "sig").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("sig", "component_id")
    return full.join(named, "sig").select("doc_id", "n_shingles", "component_id").unionByName(lone)


def deduplicated(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the smallest id; columns untouched.

    Texts without words are linked with nothing and all stay. Of repeated rows one stays.
    """
    sets, roots = _grouped(docs, n, percent)
    rows = sets.filter("n_shingles > 0").groupBy("sig", "row_key").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("rank")
    )
    placed = rows.join(roots, rows.sig == roots.node, "left").withColumn("root", F.coalesce("root", "sig"))
    best = placed.groupBy("root").agg(F.min("rank").alias("best"), F.sum("copies").alias("size")).filter("size > 1")
    surplus = placed.join(best, "root").select(
        "row_key", (F.col("row_key") == F.col("best.row_key")).alias("stays"), "copies"
    )
    touched = materialize(surplus.filter("NOT stays OR copies > 1"))
    keyed = docs.select(row_key().alias("row_key"), F.struct(*docs.columns).alias("row"))
    others = keyed.join(touched, "row_key", "left_anti")
    repeated = keyed.join(touched.filter("stays").select("row_key"), "row_key", "left_semi")
    single = repeated.groupBy("row_key").agg(F.first("row").alias("row"))
    return others.unionByName(single).select("row.*")
