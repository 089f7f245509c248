"""URL verdicts: longest-match rules, then link-graph trust and distrust per host.

Hosts that the rules mostly allow are trusted seeds, hosts that they mostly block are blocked seeds. Personalised PageRank
runs from the trusted seeds along the host edges (trust) and from the blocked seeds against them (distrust); beside them, the
PageRank that starts from every host alike runs both ways and gives the scale. All four are one iteration over an edge table that
is pre-aggregated to one row per pair of hosts. A url that no rule fits is judged by its host: of all score that comes to it over
links, trust_share is the part that comes from trusted seeds, distrust_share, against the links, from blocked ones; seeds have 1.
It is blocked if its distrust_share reaches the threshold and exceeds its trust_share. Shares do not fall as the crawl grows.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the (empty)
host's score; null html has no links; links without a host and links to the own host are no edges; an empty table gives an
empty result; repeated rows are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, lower_ascii, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, BLOCK_AT, CUT_EVERY = 0.85, 0.15, 4
#: How near the scores are to their limits.
TOLERANCE = 1e-6
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is the outermost test
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust, along, against, trust_share, distrust_share). hosts: (host, trusted, blocked); edges: (src, dst, n),
    one row per pair.

    Trust follows links, distrust goes from a link's target to its source; along and against are the same with every host as a
    seed. Scores are those of PageRank over 1 - damping: a seed that nothing reaches has 1. Without rounds, the iteration goes
    on until no trust or distrust can change by TOLERANCE, and what is missing of the other two is below TOLERANCE of them."""
    both = edges.select(F.lit("t").alias("way"), "src", "dst", "n").unionByName(edges.select(F.lit("d").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    flags = {"t": F.col("trusted"), "d": F.col("blocked"), "a": F.lit(True), "b": F.lit(True)}
    seeds = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(w).alias("way"), c.alias("seed")) for w, c in flags.items()])).alias("x")).select("host", "x.way", F.col("x.seed").cast("double").alias("seed"))
    given = both.join(both.groupBy("way", "src").agg(F.sum("n").alias("total")), ["way", "src"]).select("way", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share"))
    ways = F.when(F.col("way") == "t", F.array(F.lit("t"), F.lit("a"))).otherwise(F.array(F.lit("d"), F.lit("b")))
    shares = durable(given.withColumn("way", F.explode(ways)), "url-shares")
    score = seeds.select("host", "way", F.col("seed").alias("score"))
    # scores only rise, and what a round adds to all of one way is at most damping times what the round before it added
    mass = lambda d: {r.way: r.m for r in d.groupBy("way").agg(F.sum("score").alias("m")).collect()}
    k, before, on = 0, mass(score) if rounds is None else {}, not shares.isEmpty()
    while on and k != rounds:
        got = score.join(shares, ["host", "way"]).groupBy(F.col("dst").alias("host"), "way").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = seeds.join(got, ["host", "way"], "left").select("host", "way", (F.col("seed") + F.coalesce("got", F.lit(0.0)) * damping).alias("score"))
        k += 1
        if k % CUT_EVERY == 0:
            score = durable(score, "url-score")
            if rounds is None:
                now = mass(score)
                most = {w: max(TOLERANCE, 1e-13 * m) if w in "td" else TOLERANCE * m for w, m in now.items()}
                on, before = any((m - before[w]) * damping / (1 - damping) > most[w] for w, m in now.items()), now
    names = {"t": "trust", "d": "distrust", "a": "along", "b": "against"}
    out = score.groupBy("host").agg(*[F.max(F.when(F.col("way") == w, F.col("score"))).alias(name) for w, name in names.items()]).join(hosts, "host")
    # of what comes over links, a host's own start left out; the greatest values bound what rounding may do
    part = lambda own, every, seed: F.when(F.col(seed), 1.0).when(F.col(every) > 1, F.least(F.lit(1.0), F.col(own) / (F.col(every) - 1))).otherwise(0.0)
    return out.select("host", *names.values(), part("trust", "along", "trusted").alias("trust_share"), part("distrust", "against", "blocked").alias("distrust_share"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_at: float = BLOCK_AT, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust, trust_share, distrust_share) per page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("_fixed", fixed)
    hosts = durable(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_fixed") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("_fixed") == "block", 1).otherwise(0)).alias("b")).select("host", (2 * F.col("a") > F.col("n")).alias("trusted"), (2 * F.col("b") > F.col("n")).alias("blocked")), "url-hosts")
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1))).alias("dst")).withColumn("dst", lower_ascii(F.col("dst"))).where("src <> dst")
    edges = durable(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "url-edges")
    linked = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").select("host", F.lit(False).alias("trusted"), F.lit(False).alias("blocked"))
    scores = propagate(hosts.unionByName(linked), edges)
    out = judged.join(scores, "host", "left")
    bad = (F.coalesce("distrust_share", F.lit(0.0)) >= block_at) & (F.coalesce("distrust_share", F.lit(0.0)) > F.coalesce("trust_share", F.lit(0.0)))
    return out.select(id_col, "host", "path", "rule", F.coalesce("_fixed", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust", "trust_share", "distrust_share")


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_trust": op2_url_trust}
SQL: dict[str, str] = {}
