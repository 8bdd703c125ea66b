"""URL filters: rules first, then trust and distrust that spread over host links.

A rule names a host, which stands for all its subdomains, and a beginning of the path; the
longest rule that fits decides. Hosts that no rule decides are judged by two walks over the
host graph: personalised PageRank from hosts with allowed pages along the links, and the same
from hosts with blocked pages against them. A host is blocked when it has more distrust than
trust and more than ``THRESHOLD`` times an even share.

Host edges are the links of the pages to other hosts, and an edge both ways between a host
and the site it belongs to (its name without the first label, if three labels remain).

Defined results. A null url or one without ``://`` has an empty host and path; no rule and no
walk applies to it, and it is allowed, as are all pages of hosts that neither walk reaches.
Null html has no links. Repeated rows are judged one by one, and each of their links counts.
Other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import text_of
from feedspark.session import materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING = 0.85
ROUNDS = 12
ROUNDS_STORED = 4
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, AFTER_SCHEME, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, AFTER_SCHEME, 2)


def _fits(rule: Rule) -> Column:
    inside = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return inside & F.col("path").startswith(rule.path)


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``rule_verdict``; the last two null where no rule fits."""
    out = pages.withColumns({"host": host_of(text_of(url)), "path": path_of(text_of(url))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        rule = F.when(_fits(r), r.name).otherwise(rule)
        verdict = F.when(_fits(r), r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def _site(host: Column) -> Column:
    """The name without its first label, null unless three labels remain."""
    return F.when(host.rlike(r"^[^.]+\.[^.]+\.[^.]+\.[^.]"), F.regexp_extract(host, r"^[^.]+\.(.*)$", 1))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` of links between different hosts (``host`` and ``html`` of pages)."""
    linked = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    hosts = F.transform(linked, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("x:"), u)).otherwise(u)))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(hosts).alias("dst"))
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    named = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host")))
    named = named.unionByName(pages.select("host")).filter("host <> ''").distinct()
    sites = named.select("host", _site(F.col("host")).alias("site")).filter("site IS NOT NULL")
    both = F.explode(
        F.array(
            F.struct(F.col("host").alias("src"), F.col("site").alias("dst")),
            F.struct(F.col("site").alias("src"), F.col("host").alias("dst")),
        )
    )
    members = sites.select(both.alias("e")).select("e.*", F.lit(1.0).alias("weight"))
    all_edges = links.unionByName(members).filter("src <> dst AND dst <> ''")
    return all_edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def walks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``walk, host, rank`` after ``rounds`` steps; ``seeds`` holds the restart shares of each walk.

    Walk 0 follows the edges, walk 1 goes against them. Both take each step in one join and one
    sum. Rank of a host without a way out is lost, which lowers all shares alike.
    """
    ways = F.explode(
        F.array(
            F.struct(F.lit(0).alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b")),
            F.struct(F.lit(1).alias("walk"), F.col("dst").alias("a"), F.col("src").alias("b")),
        )
    )
    steps = edges.select(ways.alias("w"), "weight").select("w.*", "weight")
    out = steps.groupBy("walk", "a").agg(F.sum("weight").alias("total"))
    steps = steps.join(out, ["walk", "a"]).select("walk", "a", "b", (F.col("weight") / F.col("total")).alias("share"))
    steps = materialize(steps)
    seeds = materialize(seeds.select("walk", "host", "rank"))
    ranks = seeds
    for number in range(rounds):
        moved = ranks.select("walk", F.col("host").alias("a"), "rank").join(steps, ["walk", "a"])
        moved = moved.select("walk", F.col("b").alias("host"), (F.col("rank") * F.col("share") * DAMPING).alias("rank"))
        back = seeds.select("walk", "host", (F.col("rank") * (1 - DAMPING)).alias("rank"))
        ranks = moved.unionByName(back).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        if (number + 1) % ROUNDS_STORED == 0:
            ranks = materialize(ranks)
    return ranks


def judged_hosts(pages: DataFrame) -> DataFrame:
    """``host, trust, distrust, blocked`` from pages with ``host``, ``rule_verdict`` and ``html``."""
    by_host = materialize(
        pages.filter("host <> ''")
        .groupBy("host")
        .agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    )
    sums = by_host.agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    split = F.explode(
        F.array(
            F.struct(F.lit(0).alias("walk"), (F.col("good") / F.lit(float(sums["good"] or 1))).alias("rank")),
            F.struct(F.lit(1).alias("walk"), (F.col("bad") / F.lit(float(sums["bad"] or 1))).alias("rank")),
        )
    )
    seeds = by_host.select("host", split.alias("s")).select("s.walk", "host", "s.rank").filter("rank > 0")
    ranks = walks(host_edges(pages), seeds)
    even = float(sums["n"] or 1)
    side = lambda k: F.sum(F.when(F.col("walk") == k, F.col("rank")).otherwise(0.0)) * even
    scored = ranks.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))
    # Sums of fractions are rounded before they are compared, since their order may differ.
    scored = scored.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
    return scored.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") > THRESHOLD))


RESULTS = ("host", "path", "rule", "verdict", "trust", "distrust")


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` (``url``, ``html``) with ``host, path, rule, verdict, trust, distrust`` behind their columns.

    Columns of other names pass through untouched; one named like a result is replaced by it.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row")
    marked = ruled(pages.select(whole, "url", "html"), rules)
    hosts = judged_hosts(marked.select("host", "rule_verdict", "html"))
    scores = hosts.select(F.col("host").alias("_host"), "trust", "distrust", "blocked")
    out = marked.join(scores, marked.host == scores._host, "left")
    walked = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    out = out.withColumn("verdict", F.coalesce("rule_verdict", walked))
    kept = [F.col("_row").getField(c).alias(c) for c in pages.columns if c not in RESULTS]
    return out.select(*kept, *RESULTS)
