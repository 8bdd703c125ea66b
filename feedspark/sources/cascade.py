"""From raw documents to entries: declared feeds first, then templates, JSON-LD, articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedspark.session import materialize, stored
from feedspark.sources import html
from feedspark.sources.dispatch import entries_of, parse_feeds
from feedspark.sources.raw import detect_kind

MAX_HOPS = 3
"""Links followed from one page unless a caller says otherwise."""
# Strategies in order of preference within one document.
FEED, TEMPLATE, JSONLD, ARTICLES = "feed", "template", "jsonld", "articles"
STRATEGIES = (FEED, TEMPLATE, JSONLD, ARTICLES)


def _edges(pages: DataFrame) -> DataFrame:
    """``at, to, steps, best, least`` of every link to another known page; null links stay out of the join."""
    target = pages.select(
        F.col("source_url").alias("to"),
        F.when(F.col("outcome").isNotNull(), F.struct("source_url", "outcome")).alias("best"),
    )
    linked = pages.filter("feed_url IS NOT NULL AND feed_url <> source_url")
    moved = linked.select(F.col("source_url").alias("at"), F.col("feed_url").alias("to")).join(target, "to")
    return moved.select("at", "to", F.lit(1).cast("long").alias("steps"), "best", F.col("to").alias("least"))


def _beyond(chain: DataFrame, jumps: DataFrame) -> DataFrame:
    """Every chain prolonged by a jump from where it stands; ended chains stay as they are.

    ``best`` is the deepest document with an outcome, ``least`` the least URL met.
    """
    next_ = jumps.select(
        F.col("at").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("best").alias("_best"), F.col("least").alias("_least")
    )
    return chain.join(next_, "to", "left").select(
        "at",
        F.coalesce("_to", "to").alias("to"),
        (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
        F.coalesce("_best", "best").alias("best"),
        F.least("least", "_least").alias("least"),
        F.col("_to").isNull().alias("ended"),
    )


def _to_the_end(edges: DataFrame) -> DataFrame:
    """Chains of links without a cycle, followed to their ends by doubling the jumps."""
    jumps = edges
    while True:
        after = stored(_beyond(jumps, jumps))
        jumps = after.drop("ended")
        if not after.filter(~F.col("ended")).limit(1).count():
            return jumps


def _cycles(edges: DataFrame) -> DataFrame:
    """``at, least`` of the pages on cycles, with the least URL of the cycle.

    After as many steps as there are links, every chain has ended or stands on a cycle, and
    the pages of a cycle are where such chains stand.
    """
    jumps, reached, links = edges, 1, edges.count()
    while reached < links:
        after = stored(_beyond(jumps, jumps))
        jumps, reached = after.drop("ended"), reached * 2
        if not after.filter(~F.col("ended")).limit(1).count():
            return jumps.select("at", "least").limit(0)
    standing = jumps.select(F.col("to").alias("at")).distinct().join(edges.select("at"), "at", "left_semi")
    return stored(jumps.select("at", "least").join(standing, "at", "left_semi"))


def _chained(pages: DataFrame, hops: int) -> DataFrame:
    """``at, steps, best`` after at most ``hops`` links: one join for each bit of the number."""
    jumps = _edges(pages)
    none = F.lit(None).cast(jumps.schema["best"].dataType)
    chain = pages.select(F.col("source_url").alias("at"), F.col("source_url").alias("to"), F.lit(0).cast("long").alias("steps"), none.alias("best"), F.lit(None).cast("string").alias("least"))
    while hops:
        if hops & 1:
            chain = _beyond(chain, jumps).drop("ended")
        hops >>= 1
        if hops:
            jumps = _beyond(jumps, jumps).drop("ended")
    return chain.select("at", "steps", "best")


def _unending(pages: DataFrame) -> DataFrame:
    """``at, steps, best`` of whole chains; one that comes back to a page ends before it."""
    edges = stored(_edges(pages))
    cycles = _cycles(edges)
    on_cycle = cycles.select("at")
    own = pages.select(
        F.col("source_url").alias("at"), F.when(F.col("outcome").isNotNull(), F.struct("source_url", "outcome")).alias("own")
    )
    # A cycle is opened before its least page. Behind its end come the pages before the start.
    opened = edges.join(cycles.select("at", F.col("least").alias("first")), "at").filter("to <> first").drop("first")
    ends = _to_the_end(stored(opened))
    ring = cycles.join(own, "at").join(ends.select("at", "steps", "best"), "at", "left")
    place = Window.partitionBy("least").orderBy(F.coalesce("steps", F.lit(0)).desc())
    wrapped = F.last("own", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1))
    size = F.count("*").over(Window.partitionBy("least"))
    rings = stored(ring.select("at", (size - 1).alias("steps"), F.coalesce(wrapped, "best", "own").alias("best")))
    # Chains outside of cycles, up to their last page or the last before a cycle.
    outside = edges.join(on_cycle, "at", "left_anti")
    straight = outside.join(on_cycle.withColumnRenamed("at", "to"), "to", "left_anti").select(*edges.columns)
    enters = outside.join(rings.select(F.col("at").alias("to"), F.col("steps").alias("_steps"), F.col("best").alias("_best")), "to")
    doors = enters.select(F.col("at").alias("to"), (F.col("_steps") + 1).alias("_steps"), "_best")
    none = F.lit(None).cast(edges.schema["best"].dataType)
    start = own.join(on_cycle, "at", "left_anti").select("at", F.col("at").alias("to"), F.lit(0).cast("long").alias("steps"), none.alias("best"), F.lit(None).cast("string").alias("least"))
    walked = _beyond(start, _to_the_end(stored(straight))).join(doors, "to", "left")
    tails = walked.select("at", (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_best", "best").alias("best"))
    return tails.unionByName(rings)


def follow_links(pages: DataFrame, max_hops: int | None = MAX_HOPS) -> DataFrame:
    """Follow declared feed links through the documents table.

    ``pages`` holds source_url, feed_url (null when none is declared) and outcome (null
    when nothing could be extracted). Every page gets the deepest document of its chain
    that has an outcome, so a failing link falls back to the page before it. A chain has
    at most ``max_hops`` links, or goes on to its end if that is None. The joins carry URLs
    only, their number grows with the logarithm of the chain, and the right side has one row
    per document.
    """
    links = pages.select("source_url", "feed_url", "outcome")
    chains = _unending(links) if max_hops is None else _chained(links, max_hops)
    own = links.select(F.col("source_url").alias("at"), F.when(F.col("outcome").isNotNull(), F.struct("source_url", "outcome")).alias("own"))
    best = F.coalesce("best", "own")
    return own.join(chains, "at").select(
        F.col("at").alias("origin"), F.col("steps").alias("hops"), best["source_url"].alias("source_url"), best["outcome"].alias("strategy")
    )


def _outcomes(entries: DataFrame, strategy: str) -> DataFrame:
    return entries.select("source_url").distinct().withColumn("outcome", F.lit(strategy))


def _arrived(state: DataFrame, documents: DataFrame) -> DataFrame:
    """Declared links name requested URLs; each is replaced by the URL where its document was found."""
    moved = final_urls(documents).filter("requested_url <> final_url")
    linked, bare = state.filter("feed_url IS NOT NULL"), state.filter("feed_url IS NULL")
    found = linked.join(moved, linked.feed_url == moved.requested_url, "left")
    return found.select(
        "source_url", F.coalesce("final_url", "feed_url").alias("feed_url"), "outcome"
    ).unionByName(bare)


def final_urls(documents: DataFrame) -> DataFrame:
    """One final URL for each requested one."""
    known = documents.filter("requested_url IS NOT NULL AND final_url IS NOT NULL")
    return known.groupBy("requested_url").agg(F.min("final_url").alias("final_url"))


def extract(
    documents: DataFrame, templates: DataFrame | None, max_hops: int | None = MAX_HOPS
) -> tuple[DataFrame, DataFrame]:
    """Entries of every document by its best strategy, and rejects.

    Documents are split by kind, so feeds never reach the HTML reader. The page scan is
    the expensive step and feeds four strategies: it is checkpointed once. A document
    with an ``explicit_template`` is read by it alone and its links are not followed.
    Documents go by ``final_url``; where there is a ``requested_url``, declared links are
    looked up by it.
    """
    explicit = "explicit_template" in documents.columns
    kinds = documents.withColumn("kind", detect_kind(F.col("content_type"), F.col("body")))
    taken = ["final_url", "body", *(["explicit_template"] if explicit else [])]
    pages = kinds.filter("kind = 'html'").select(*taken)
    parsed = parse_feeds(kinds.filter("kind <> 'html'").select("final_url", "body"))
    parsed = materialize(parsed)
    scanned = materialize(html.scan_pages(pages, templates))

    by_strategy = {
        FEED: entries_of(parsed).drop("format"),
        TEMPLATE: html.template_entries(scanned),
        JSONLD: html.jsonld_entries(scanned),
        ARTICLES: html.article_entries(scanned),
    }
    entries = None
    for strategy, rows in by_strategy.items():
        tagged = rows.withColumn("strategy", F.lit(strategy))
        entries = tagged if entries is None else entries.unionByName(tagged)
    entries = materialize(entries)

    rank = F.array_position(F.lit(list(STRATEGIES)), F.col("strategy"))
    won = entries.groupBy("source_url").agg(F.min_by("strategy", rank).alias("outcome"))
    read = parsed.filter("problem IS NULL").select("source_url", F.lit(FEED).alias("feed_outcome"))
    links = html.feed_links(scanned).unionByName(
        parsed.select("source_url", F.lit(None).cast("string").alias("feed_url"))
    )
    state = (
        links.join(won, "source_url", "left")
        .join(read, "source_url", "left")
        .select("source_url", "feed_url", F.coalesce("outcome", "feed_outcome").alias("outcome"))
    )
    if "requested_url" in documents.columns:
        state = _arrived(state, documents)
    chosen = follow_links(state, max_hops)
    if explicit:
        forced = pages.filter("explicit_template IS NOT NULL").select(F.col("final_url").alias("origin"))
        own = forced.select(
            "origin", F.lit(0).alias("hops"), F.col("origin").alias("source_url"), F.lit(TEMPLATE).alias("strategy")
        )
        chosen = chosen.join(forced, "origin", "left_anti").unionByName(own)
    out = chosen.filter("strategy IS NOT NULL").join(entries, ["source_url", "strategy"])
    out = out.withColumnRenamed("source_url", "document_url").withColumnRenamed("origin", "source_url")
    rejects = chosen.filter("strategy IS NULL").select(
        F.lit("extract").alias("stage"),
        F.col("origin").alias("key"),
        F.lit("no feed could be extracted").alias("reason"),
    )
    return out, rejects
