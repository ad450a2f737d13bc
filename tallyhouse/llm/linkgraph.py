"""Verdicts on urls from rules and from trust that spreads over the links between hosts.

Method. Rules name a host and a path; a rule fits its host and all subdomains if the url's path starts with the rule's,
and the longest rule wins (of equally long ones the first in the alphabet; of equal ones ``block``). Hosts most of
whose pages a rule allows are trusted seeds, hosts most of whose pages a rule blocks are distrusted seeds, weighted by the share of such pages.
Links of pages to other hosts are edges between hosts. Personalised PageRank spreads trust from the trusted seeds along the
edges and distrust from the blocked seeds against them (who links to a blocked host is suspect), in rounds until what is
still to move is less than ``TOLERANCE`` and than ``PART`` of the least share that blocks a host. A host is
blocked if it has more distrust than trust and at least ``LEVEL`` times the mean share of a host; all other hosts are allowed.
A rule decides the urls it fits, the host's verdict decides all others.

Rank vectors and edges are tables by host; every round is one join and one aggregate, written to the shared folder.
Links are counted per pair of hosts before they move.

Defined results: a null url and one without ``://`` have an empty host and path, fit no rule and are allowed; a null
or empty page has no links; links inside one host and links without a host do not count; dead ends return their rank to the
seeds; without seeds or edges no host but the seeds has a rank. Repeated rows are judged alike (their links count again). Extra
columns are kept by ``judge``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.saved import saved

DAMPING = 0.85
ROUNDS = 250  # never reached: 0.85**250 is far below any tolerance
TOLERANCE = 1e-6
LEVEL = 0.5
PART = 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: str) -> tuple[F.Column, F.Column]:
    """Host (A-Z in lower case) and path of a url column; both empty if there is no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (rule, action) as a table: ``example.net/en/`` is the host before the first slash and the path from it on."""
    return spark.createDataFrame(rules, "rule string, action string").select(
        "rule", "action", F.substring_index("rule", "/", 1).alias("rule_host"),
        F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules of the host and of the domains above it, longest first. The list is as long as these domains have rules."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(domains).alias("rule_host")).join(rules, "rule_host")
    key = F.struct((-F.length("rule")).alias("n"), "rule", F.when(F.col("action") == "block", 0).otherwise(1).alias("o"), "action", "rule_path")
    return fits.groupBy("host").agg(F.array_sort(F.collect_set(key)).alias("rules"))


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links between different hosts: source, target, number. Needs the column ``host``."""
    found = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.expr(
        "regexp_extract_all({}, '{}', 1)".format(f"`{html}`", _LINK.replace("\\", "\\\\").replace("'", "\\'")))).alias("target"))
    target = F.translate("target", _UPPER, _LOWER)
    return found.select("source", target.alias("target")).where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, tolerance: float, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Rank by host from edges (source, target, n) and seeds (host, weight > 0), in all within ``tolerance`` of the limit.

    Hosts out of reach, or so far that their share is below the tolerance, may have no row.
    """
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"]
    seeds = saved(seeds.select("host", (F.col("weight") / (total or 1.0)).alias("weight")), "seeds")
    out = edges.groupBy("source").agg(F.sum("n").alias("all"))
    shares = saved(edges.join(out, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share")), "shares")
    rank = seeds.select("host", F.col("weight").alias("rank"))
    if not total or shares.isEmpty():
        return rank
    for _ in range(rounds):
        sent = shares.join(rank.withColumnRenamed("host", "source"), "source").groupBy(F.col("target").alias("host")).agg(
            F.sum(F.col("share") * F.col("rank")).alias("got"))
        moved = sent.join(seeds, "host", "full_outer").select("host", F.coalesce("got", F.lit(0.0)).alias("got"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
        moved = saved(moved, "rank")
        # What did not move along an edge (restarts and dead ends) returns to the seeds.
        arrived = moved.agg(F.sum("got").alias("g")).first()["g"] or 0.0
        new = moved.select("host", (F.lit(damping) * F.col("got") + F.lit(1 - damping * arrived) * F.col("weight")).alias("rank"))
        old = rank.withColumnRenamed("rank", "old")
        change = new.join(old, "host", "full_outer").agg(
            F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("c")).first()["c"]
        rank = new
        # Each later round changes at most the damped change of the one before.
        if change * damping / (1 - damping) < tolerance:
            return rank
    raise RuntimeError(f"ranks have not settled to {tolerance} in {rounds} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", level: float = LEVEL) -> DataFrame:
    """All rows with host, path, rule, verdict, and the trust and distrust of their host (null where it has none)."""
    spark = pages.sparkSession
    host, path = host_and_path(url)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    fitting = saved(rules_of_hosts(hosts.where("host <> ''"), rule_table(spark, rules)), "rules")
    fit = F.try_element_at(F.filter("__th_rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(1))
    ruled = rows.join(fitting.withColumnRenamed("rules", "__th_rules"), "host", "left").withColumn("__th_fit", fit).drop("__th_rules")
    by_host = saved(ruled.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("__th_fit.action") == "allow").alias("good"), F.count_if(F.col("__th_fit.action") == "block").alias("bad")), "hosts")
    edges = saved(host_links(rows, html), "edges")
    seeds = by_host.where("host <> ''")
    known = by_host.select("host").union(edges.select("target")).distinct()
    least = level / max(1, known.count())
    near = min(TOLERANCE, PART * least)
    trust = personalised_rank(edges, seeds.where("2 * good > pages").select("host", (F.col("good") / F.col("pages")).alias("weight")), near)
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    distrust = personalised_rank(reverse, seeds.where("2 * bad > pages").select("host", (F.col("bad") / F.col("pages")).alias("weight")), near)
    scored = by_host.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    blocked = (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))) & (F.coalesce("distrust", F.lit(0.0)) >= F.lit(least))
    verdicts = saved(scored.withColumn("__th_verdict", F.when(blocked, "block").otherwise("allow")), "verdicts")
    return ruled.join(verdicts, "host", "left").select(
        *kept, "host", "path", F.col("__th_fit.rule").alias("rule"),
        F.coalesce("__th_fit.action", "__th_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
