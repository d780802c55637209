"""URL filters: rules first, then trust and distrust over the graph of hosts.

A rule names a host and the start of a path and holds for subdomains too; the longest rule
that fits a page decides it. Every other page is judged by its host. Seeds are the shares of a
host's pages that rules allow (trusted) and block, so no number of pages outweighs another host.
Trust is personalised PageRank from the trusted seeds along links, each host passing on
``damping`` of its trust by its shares of links. Distrust is the same propagation from the blocked
seeds against the links, to whoever links there: a host receives ``damping`` of what it links
to, by its own shares of links, so other linkers take nothing from it and links of
pages that rules decide say nothing. A host is blocked where its distrust exceeds its trust by
more than ``threshold``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemeter.llm.common import lower_ascii
from grovemeter.scratch import stage, unstage

DAMPING = 0.85
TOLERANCE = 1e-5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """A struct (name, verdict) of the longest rule that fits, NULL where none does."""
    fitting = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        fitting = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def host_edges(
    pages: DataFrame, url_column: str = "url", html_column: str = "html", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(src, dst, links, parts): the number of pages of one host that link to another.

    ``parts`` counts pages that no rule decides, each split evenly over its targets. Links within
    a host say nothing about others and are left out, as are links from pages without a host.
    Each page counts a target once.
    """
    host = host_of(F.col(url_column))
    verdict = longest_rule(host, path_of(F.col(url_column)), rules)["verdict"]
    targets = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.col(html_column), F.lit(LINK), F.lit(1)),
            lambda link: host_of(F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link)),
        )
    )
    found = pages.select(host.alias("src"), verdict.alias("verdict"), F.array_remove(targets, "").alias("all")).where("src <> ''")
    found = found.withColumn("all", F.array_remove("all", F.col("src")))
    is_open = F.col("verdict").isNull()
    return found.select("src", "verdict", F.size("all").alias("degree"), F.explode("all").alias("dst")).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("links"),
        F.sum(F.when(is_open, 1 / F.col("degree")).otherwise(0.0)).alias("parts"),
    )


def spread(seeds: DataFrame, weighted: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, score): the seed and ``damping`` of what other hosts pass on, as a fixed point.

    ``seeds`` is (host, seed), ``weighted`` (src, dst, share) in rows or columns that sum to 1 at
    most, so that every round shrinks the changes by ``damping`` and the loop ends. What has
    nowhere to go is lost (PageRank divided by 1 - damping). Rounds are sums over edges, written
    to shared tables, and stop when no score changes by TOLERANCE. Seeds of 0 give no score.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and below 1")
    start = stage(seeds.where("seed > 0"), "url-seeds")
    scores = start.select("host", F.col("seed").alias("score"))
    if weighted.isEmpty() or start.isEmpty():
        return scores
    weighted = stage(weighted, "url-shares")
    previous = None
    while True:
        sent = weighted.join(scores.withColumnRenamed("host", "src"), "src").select(
            F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"), F.lit(0.0).alias("old")
        )
        given = start.select("host", "seed", F.lit(0.0))
        held = scores.select("host", F.lit(0.0), F.col("score"))
        following = stage(
            sent.union(given).union(held).groupBy("host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")), "url-scores"
        )
        if previous is not None:
            unstage(previous)
        scores, previous = following.select("host", "score"), following
        if following.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] < TOLERANCE:
            break
    unstage(weighted)
    unstage(start)
    return scores


def trust_shares(edges: DataFrame) -> DataFrame:
    """(src, dst, share): the shares of a host's links, for trust to follow."""
    out = edges.groupBy("src").agg(F.sum("links").alias("all_links"))
    return edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("all_links")).alias("share"))


def distrust_shares(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, share) against the links: how much of all pages of ``dst`` links to ``src``, where no rule decides."""
    return edges.where("parts > 0").join(judged.select(F.col("host").alias("src"), "pages"), "src").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("parts") / F.col("pages")).alias("share")
    )


def judge_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    rules: Sequence[Rule] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, trust, distrust.

    A NULL url or one without ``://`` has an empty host and path and no rule; such pages and
    hosts without trust or distrust are allowed. NULL html has no links. Rows repeat as they
    come; other columns are not read; an empty table gives an empty result.
    """
    parts = pages.select(
        F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path")
    ).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    judged = parts.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("allowed"),
        F.count_if(F.col("fit.verdict") == "block").cast("double").alias("blocked"),
    )
    judged = stage(judged, "url-judged")
    edges = stage(host_edges(pages, url_column, html_column, rules), "url-edges")
    trust = spread(judged.select("host", (F.col("allowed") / F.col("pages")).alias("seed")), trust_shares(edges))
    distrust = spread(judged.select("host", (F.col("blocked") / F.col("pages")).alias("seed")), distrust_shares(judged, edges))
    none = F.lit(0.0)
    scores = trust.select("host", F.col("score").alias("trust"), none.alias("distrust")).union(distrust.select("host", none, "score"))
    scores = stage(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "url-hosts")
    by_host = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return parts.join(judged.select("host").join(scores, "host"), "host", "left").select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.col("fit.name").alias("rule"),
        F.coalesce(F.col("fit.verdict"), by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
