"""Benchmark decontamination by spaced seeds.

A mask looks at some of the tokens in a window and ignores the rest, so a copy with words
replaced still agrees with the test item wherever a replaced word falls on an ignored place.
Seeds of the corpus are tested against a bitmap of all test seeds while the text is read;
only those that pass are joined with the test seeds. Each hit fixes an alignment of item and
text. The hit is extended along it in both directions, while tokens that disagree do not
outweigh those that agree, into a local overlap. Overlaps that follow each other in item and
text, as around an inserted word, form a chain. A text holds an item if a chain has
``OVERLAP`` agreeing tokens, however long the item is, or if all overlaps together, or the
best alignment of the whole item, reach the least share of the item.

Defined results. A null or empty text or item has no tokens and matches nothing. An item
shorter than a mask is sought whole, by a mask of its own length without ignored places. One
row per id and item is returned, however often the row or the passage is repeated. Items with
equal text each match. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import let, row_key, stored, text_of

# The masks; 1 looks at a token, 0 ignores it.
MASKS = ("1110101011", "11010001101", "110011000011")
MIN_SHARE = 0.5
"""Least share of an item's tokens that agree, over all alignments."""
MIN_TOKENS = 6
OVERLAP = 13
"""Agreeing tokens in one place that are enough whatever the item's length."""
DROP = 3
"""An extension ends where it has lost so many points, one for each token, from its best."""
GAP = 4
"""Tokens that may lie between two overlaps of a chain."""
BITS_PER_SEED = 64
MOST_BITS = 1 << 26
BROADCAST_SEEDS = 1_000_000
SPACE_BETWEEN = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    tokens = F.array_remove(F.split(F.lower(text), SPACE_BETWEEN), "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _windows(df: DataFrame, masks: list[str]) -> DataFrame:
    """Explode rows with ``hashes`` into one row per place and mask: the columns, ``pos``, ``mask``, ``seed``.

    The neighbours of a place are read from the row's array, which stays in memory while its
    places are generated. A window ends inside the text, ignored places included.
    """
    keep = df.columns
    token = lambda k: F.get("hashes", F.col("pos") + k)
    seeds = []
    for number, mask in enumerate(masks):
        looked = [token(k) for k, bit in enumerate(mask) if bit == "1"]
        fits = F.col("pos") + len(mask) <= F.size("hashes")
        seeds.append(F.when(fits, F.xxhash64(F.lit(number), *looked)))
    placed = df.select(*keep, F.posexplode("hashes").alias("pos", "token"))
    return placed.select(*keep, "pos", F.posexplode(F.array(*seeds)).alias("mask", "seed")).filter("seed IS NOT NULL")


def _masks_for(items: DataFrame) -> list[str]:
    """The fixed masks, and a full one for each item length that no fixed mask fits."""
    shortest = min(map(len, MASKS))
    lengths = items.filter((F.col("len") > 0) & (F.col("len") < shortest)).select("len").distinct().collect()
    return list(MASKS) + ["1" * r["len"] for r in sorted(lengths)]


def _bitmap(seeds: DataFrame, bits: int) -> Column:
    """One array of words with the bits of all seeds set, as a scalar."""
    at = F.pmod(F.col("seed"), F.lit(bits))
    twice = seeds.select(F.explode(F.array(at, F.pmod(F.shiftright("seed", 32), F.lit(bits)))).alias("at"))
    words = (
        twice.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))").alias("ones"))
    )
    every = seeds.sparkSession.range(bits // 64, numPartitions=1).withColumnRenamed("id", "word")
    dense = every.join(words, "word", "left").select("word", F.coalesce("ones", F.lit(0)).alias("ones"))
    packed = dense.agg(F.sort_array(F.collect_list(F.struct("word", "ones"))).alias("a"))
    return packed.select(F.transform("a", lambda x: x["ones"]).alias("bits")).scalar()


def _may_hold(bitmap: Column, seed: Column, bits: int) -> Column:
    def probe(at: Column) -> Column:
        word = F.get(bitmap, F.shiftright(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return probe(F.pmod(seed, F.lit(bits))) & probe(F.pmod(F.shiftright(seed, 32), F.lit(bits)))


def _reach(agree: Column) -> Column:
    """How many tokens an extension over ``agree``, ones and zeros outward from a seed, takes in."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("score"), F.lit(0).alias("best"), F.lit(0).alias("at"))

    def add(state: Column, one: Column) -> Column:
        score = state["score"] + one * 2 - 1
        more = state["score"] >= state["best"] - DROP
        better = more & (score > state["best"])
        return F.struct(
            (state["n"] + 1).alias("n"),
            F.when(more, score).otherwise(state["score"]).alias("score"),
            F.when(better, score).otherwise(state["best"]).alias("best"),
            F.when(better, state["n"] + 1).otherwise(state["at"]).alias("at"),
        )

    return F.aggregate(agree, start, add, lambda state: state["at"])


OVERLAPS = "array<struct<doc_from:int,doc_to:int,item_from:int,item_to:int,held:array<int>>>"


def _local(agree: Column, hits: Column, skip: Column, origin: Column) -> Column:
    """The local overlaps of one alignment: its seeds extended, from left to right.

    A seed that lies in an overlap found before is passed over. It would extend to the same
    end, as the best place of an extension is the best for every later start, and no further
    to the left. ``origin`` is the text's place of the first token of ``agree``.
    """
    start = F.struct(F.lit(-1).alias("to"), F.array().cast(OVERLAPS).alias("out"))

    def extended(first: Column, wide: Column) -> Column:
        left = _reach(F.reverse(F.slice(agree, F.lit(1), first)))
        right = _reach(F.slice(agree, first + wide + 1, F.size(agree)))
        return F.struct((first - left).alias("begin"), (first + wide - 1 + right).alias("end"))

    def with_new(state: Column, ends: Column) -> Column:
        places = F.filter(F.sequence(ends["begin"], ends["end"]), lambda k: F.get(agree, k) == 1)
        overlap = F.struct(
            (origin + ends["begin"]).alias("doc_from"),
            (origin + ends["end"]).alias("doc_to"),
            (skip + ends["begin"]).alias("item_from"),
            (skip + ends["end"]).alias("item_to"),
            F.transform(places, lambda k: k + skip).alias("held"),
        )
        return F.struct(ends["end"].alias("to"), F.concat(state["out"], F.array(overlap)).alias("out"))

    def add(state: Column, hit: Column) -> Column:
        first = hit["item_pos"] - skip
        inside = first + hit["wide"] - 1 <= state["to"]
        return F.when(inside, state).otherwise(let(extended(first, hit["wide"]), lambda ends: with_new(state, ends)))

    return F.aggregate(hits, start, add, lambda state: state["out"])


CHAIN = "struct<doc_to:int,item_to:int,held:array<int>,longest:int>"


def _longest_chain(found: Column) -> Column:
    """The most agreeing tokens of an item in overlaps that follow each other in item and text."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).alias("doc_to"), F.lit(None).alias("item_to"), none.alias("held"), F.lit(0).alias("longest"))

    def add(state: Column, x: Column) -> Column:
        near = (x["doc_from"] <= state["doc_to"] + GAP + 1) & (x["item_from"] <= state["item_to"] + GAP + 1)
        on = F.coalesce(near, F.lit(False))
        held = F.when(on, F.array_union(state["held"], x["held"])).otherwise(x["held"])
        return let(
            held,
            lambda h: F.struct(
                F.when(on, F.greatest(state["doc_to"], x["doc_to"])).otherwise(x["doc_to"]).alias("doc_to"),
                F.when(on, F.greatest(state["item_to"], x["item_to"])).otherwise(x["item_to"]).alias("item_to"),
                h.alias("held"),
                F.greatest(state["longest"], F.size(h)).alias("longest"),
            ),
        )

    return F.aggregate(F.array_sort(found), start.cast(CHAIN), add, lambda state: state["longest"])


def overlaps(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``row_key, doc_id, item_id, item_tokens, matched_tokens, share`` of contaminated pairs.

    ``matched_tokens`` are the item's places that agree in any overlap, or along the best
    alignment of the whole item if these are more.
    ``row_key`` is a hash of id and text, for callers whose ids may be null or repeated.
    """
    tested = items.select(F.col("item_id").cast("bigint").alias("item_id"), token_hashes(text_of("text")).alias("hashes"))
    tested = tested.withColumn("len", F.size("hashes")).filter("len > 0")
    tested = tested.withColumn("item", F.xxhash64("item_id", "hashes")).dropDuplicates(["item"])
    masks = _masks_for(tested)
    own_length = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    seeds = (
        _windows(tested, masks)
        .filter((F.col("mask") < len(MASKS)) | (F.col("len") == own_length))
        .select("item", F.col("pos").alias("item_pos"), "mask", "seed")
    )
    count = seeds.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (max(1, count) * BITS_PER_SEED - 1).bit_length()))
    bitmap = _bitmap(seeds.select("seed"), bits)

    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    read = rows.select("row_key", "doc_id", token_hashes(F.col("text")).alias("hashes"))
    found = _windows(read, masks).filter(_may_hold(bitmap, F.col("seed"), bits)).drop("hashes")
    # A seed is four numbers, and the seeds are counted above; beyond the bound the join shuffles.
    side = F.broadcast(seeds) if count <= BROADCAST_SEEDS else seeds
    hit = F.struct("item_pos", F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1).alias("wide"))
    # One row per alignment, with its seeds in order: at most a few for each token of the item.
    aligned = (
        found.join(side, ["mask", "seed"])
        .groupBy("row_key", "doc_id", "item", (F.col("pos") - F.col("item_pos")).alias("start"))
        .agg(F.sort_array(F.collect_set(hit)).alias("hits"))
    )
    # Written, so that its size is known where the texts of the rows with hits are fetched.
    aligned = stored(aligned)
    texts = rows.select("row_key", "text").join(aligned.select("row_key").distinct(), "row_key", "left_semi")
    texts = texts.dropDuplicates(["row_key"]).select("row_key", token_hashes(F.col("text")).alias("hashes"))
    whole = tested.select("item", "item_id", "len", F.col("hashes").alias("tokens"))
    along = aligned.join(texts, "row_key").join(whole, "item")
    skip = F.greatest(-F.col("start"), F.lit(0))
    there = F.slice("hashes", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len") - skip)
    here = F.slice("tokens", skip + 1, F.col("len") - skip)
    agree = F.zip_with(there, here, lambda a, b: F.when(a == b, 1).otherwise(0))
    # Places count from the first token of the item that lies within the text.
    matched = along.select(
        "row_key",
        "doc_id",
        "item_id",
        F.col("len").alias("item_tokens"),
        let(
            agree,
            lambda g: F.struct(
                F.aggregate(g, F.lit(0), lambda n, x: n + x).alias("aligned"),
                _local(g, F.col("hits"), skip, F.col("start") + skip).alias("found"),
            ),
        ).alias("m"),
    ).select("row_key", "doc_id", "item_id", "item_tokens", "m.aligned", "m.found")
    best = matched.groupBy("row_key", "doc_id", "item_id", "item_tokens").agg(
        F.max("aligned").alias("aligned"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")
    )
    every = F.size(F.array_distinct(F.flatten(F.transform("found", lambda x: x["held"]))))
    total = best.select(
        "row_key",
        "doc_id",
        "item_id",
        "item_tokens",
        F.greatest("aligned", every).alias("matched_tokens"),
        _longest_chain(F.col("found")).alias("longest"),
    )
    share = F.col("matched_tokens") / F.col("item_tokens")
    needed = F.least(F.col("item_tokens"), F.lit(MIN_TOKENS))
    whole = (share >= min_share) & (F.col("matched_tokens") >= needed)
    return total.withColumn("share", share).filter(whole | (F.col("longest") >= OVERLAP)).drop("longest")


def contaminated(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, item_id, item_tokens, matched_tokens, share``, one row per pair."""
    pairs = overlaps(docs, items, min_share)
    return (
        pairs.groupBy("doc_id", "item_id", "item_tokens")
        .agg(F.max("matched_tokens").alias("matched_tokens"))
        .withColumn("share", F.col("matched_tokens") / F.col("item_tokens"))
    )


def clean(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all their columns untouched."""
    bad = overlaps(docs, items, min_share).select("row_key").distinct()
    rows = docs.select(row_key().alias("row_key"), F.struct(*docs.columns).alias("row"))
    return rows.join(bad, "row_key", "left_anti").select("row.*")
