"""URL verdicts by rules, then by trust and distrust that spread over the links between hosts.

Rules judge a url by host and path. For the rest, a host is a seed by the share of its pages that the rules allow (trust) and
block (distrust). Trust follows links (personalised PageRank); distrust goes against them, from
blocked seeds to the hosts that link to them. Both are linear fixed points, t = (1 - d) * seed + d * (what neighbours pass on), not
scaled to sum to one, so a host's score doesn't shrink as the graph grows. A host whose distrust is over its trust and at least
MIN_DISTRUST, that of a host without links half of whose pages are blocked, is blocked; others are allowed.

Host edges are counted from the absolute links of the pages and added up before anything iterates; iterations go on
until no score is further than TOLERANCE from the fixed point. A host with many outgoing edges is split by salt, SALT_EDGES to each. In
the graph, hosts have neither user nor port, those of pages as those of links.

Defined cases: a null url or one without :// has empty host and path, fits no rule and is allowed; null html has no links; links within
a host don't count; repeated rows count each; page_id keeps its type; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .neardup import sized_broadcast

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, TOLERANCE, MIN_DISTRUST, CHECKPOINT_EVERY, SALT_EDGES = 0.85, 1e-6, 0.075, 10, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute link of an <a>, with or without a scheme.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), host), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def node_of(host: Column) -> Column:
    """A host as the graph knows it: no user, no port, lower case."""
    return F.translate(F.regexp_replace(host, r"^.*@|:\d*$", ""), _UPPER, _LOWER)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another."""
    links = pages.select(node_of(host_of(F.col("url"))).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select("src", node_of(F.col("to")).alias("dst"))
    return links.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """(host, score) from the seeds along edges (src, dst, n), an edge passing on its share of what leaves src."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / SALT_EDGES).alias("salts"))
    share = (F.col("n") / F.col("all")).alias("share")
    shares = stage(edges.join(out, "src").select("src", F.pmod(F.xxhash64("dst"), "salts").alias("salt"), "dst", share), "shares")
    start = hosts.join(out.select(F.col("src").alias("host"), "salts"), "host", "left")
    score = start.select("host", F.coalesce("salts", F.lit(0)).alias("salts"), F.col(seed).alias("seed"), ((1 - DAMPING) * F.col(seed)).alias("score"))
    if not shares.limit(1).count():
        return score.select("host", "score")
    score = stage(score, "scores")
    while True:
        for turn in range(CHECKPOINT_EVERY):
            each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
            sent = score.where("salts > 0 and score != 0").select(F.col("host").alias("src"), each, "score")
            got = shares.join(sent, ["src", "salt"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
            score = score.join(got, score["host"] == got["dst"], "left").select(
                "host", "salts", "seed", ((1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("was")
            )
        score = stage(score, "scores")
        moved = score.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0
        # a step moves no more in all than d times the one before, so what is left is at most d / (1 - d) of the last; single hosts' changes may grow again
        if moved * DAMPING / (1 - DAMPING) < TOLERANCE:
            return score.select("host", "score")


def host_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, trust, distrust, blocked for each host with pages or links."""
    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    verdict = rule_for(F.col("host"), F.col("path"), rules)["verdict"]
    share = lambda kind: F.avg(F.coalesce((verdict == kind).cast("double"), F.lit(0.0)))
    seeds = urls.where("host != ''").groupBy(node_of(F.col("host")).alias("host")).agg(share("allow").alias("good"), share("block").alias("bad"))
    edges = stage(host_edges(pages), "edges")
    named = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    hosts = stage(seeds.join(named, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")), "hosts")
    trust = spread(hosts, edges, "good").withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(hosts, back, "bad").withColumnRenamed("score", "distrust")
    both = trust.join(distrust, "host")
    # rounding must not decide at the limit
    return both.withColumn("blocked", (F.col("distrust") >= MIN_DISTRUST - TOLERANCE) & (F.col("distrust") > F.col("trust")))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages, with the scores of its host where it has any."""
    scores = host_scores(pages, rules).where("trust > 0 or distrust > 0")
    scores = sized_broadcast(stage(scores.withColumnRenamed("host", "_node"), "scores"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("_at", node_of(F.col("host")))
    rows = rows.join(scores, F.col("_at") == F.col("_node"), "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
