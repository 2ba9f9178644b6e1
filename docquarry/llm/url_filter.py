"""URL filters: rules first, then trust and distrust propagated over the host graph.

A rule names a host and a path prefix and an action. It fits the host and all its
subdomains where the url's path starts with its own; the longest rule (host and path)
wins. Hosts whose pages the rules allow seed trust, hosts whose pages they block seed
distrust. Personalised PageRank spreads trust along host links, and distrust against them:
linking to a blocked host is suspicious. A page without a rule gets its host's verdict.

DataFrame functions only. The edge list is aggregated by host pair before it is shuffled
again; a rank is one row a host.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import stable

DAMPING = 0.85
#: Ranks are iterated until their total change is at most this.
TOLERANCE = 1e-6
#: The fixed number of steps that the query's SQL unrolls, having no loop.
ITERATIONS = 8
#: A host is blocked when its distrust exceeds this many times its trust.
THRESHOLD = 1.0


@dataclass(frozen=True)
class Rule:
    """``target``: host, a slash and the start of a path. ``action``: allow or block."""

    action: str
    target: str

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The target and action of the longest rule that fits, else nulls."""
    target, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.target), r.target)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        target = F.when(fits, F.lit(r.target)).otherwise(target)
        action = F.when(fits, F.lit(r.action)).otherwise(action)
    return target, action


def host_edges(pages: DataFrame) -> DataFrame:
    """From (host, html): src, dst and links, the number of absolute links to other hosts."""
    href = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(href), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    pairs = links.select(F.col("host").alias("src"), host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("links"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """PageRank over weighted ``edges`` (src, dst, links) restarting at ``seeds`` (host, mass).

    Returns host, rank for hosts that any mass reaches. What a host without outgoing links
    holds goes back to nowhere: ranks add up to 1 at most. Steps go on until the ranks change
    by ``tolerance`` in all, or as many as bound the remaining mass, damping ** steps, by it.
    """
    total = edges.groupBy("src").agg(F.sum("links").alias("out"))
    moves = stable(edges.join(total, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")))
    seeds = stable(seeds)
    start = seeds.select("host", ((1 - damping) * F.col("mass")).alias("rank"))
    if moves.isEmpty():
        return seeds.select("host", F.col("mass").alias("rank"))
    rank = seeds.select("host", F.col("mass").alias("rank"))
    for _ in range(math.ceil(math.log(tolerance / 2) / math.log(damping))):
        before = rank
        moved = rank.join(moves, rank["host"] == moves["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        rank = stable(start.unionByName(moved).groupBy("host").agg(F.sum("rank").alias("rank")))
        signed = rank.unionByName(before.select("host", (-F.col("rank")).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("change"))
        if (signed.agg(F.sum(F.abs("change"))).first()[0] or 0.0) <= tolerance:
            break
    return rank


def _seed(marks: DataFrame, action: str) -> DataFrame:
    own = marks.where(F.col(action) > 0).select("host", F.col(action).cast("double").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    return own.crossJoin(F.broadcast(total)).select("host", (F.col("n") / F.col("total")).alias("mass"))  # total: one row


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    tolerance: float = TOLERANCE, threshold: float = THRESHOLD,
) -> DataFrame:
    """Every row of ``pages`` as id, host, path, rule, verdict, trust, distrust.

    A null url has empty host and path, no rule and no seeds: allowed. A null html has no
    links. Hosts that neither trust nor distrust reaches, and ties, are allowed. Repeated
    rows are judged each (and count as pages each); ids may be null; other columns aren't
    read; an empty table gives no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    target, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = named.withColumn("rule", target).withColumn("action", action)
    marks = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("action") == "allow", 1)).alias("allow"),
        F.count(F.when(F.col("action") == "block", 1)).alias("block"),
    )
    marks = stable(marks)
    edges = stable(host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html"))))
    trust = personalised_rank(edges, _seed(marks, "allow"), tolerance).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = personalised_rank(back, _seed(marks, "block"), tolerance).withColumnRenamed("rank", "distrust")
    verdicts = trust.join(distrust, "host", "full_outer").where(F.coalesce("distrust", F.lit(0.0)) + F.coalesce("trust", F.lit(0.0)) > 0)
    out = judged.join(verdicts, "host", "left")
    blocked = F.coalesce("distrust", F.lit(0.0)) > threshold * F.coalesce("trust", F.lit(0.0))
    return out.select(
        "id", "host", "path", "rule",
        F.coalesce("action", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust",
    )
