"""URL verdicts from rules and, for the rest, from link-graph propagation; DataFrame functions only.

Rules: (host, path) pairs that fit a host with its subdomains and paths that begin with the rule's; the
longest that fits wins. Hosts are matched by their suffixes through a join, so rule lists may be long.

Method for pages without a rule: hosts with allowed and no blocked pages are trusted seeds, hosts all of whose
pages are blocked are distrusted seeds (a rule for one path does not condemn a host). Personalised PageRank spreads trust along host links, and
distrust against them (who links to a blocked host gets its distrust). A host is blocked if its distrust is at
least SHARE of trust and distrust together; a host that neither reaches is allowed.

Null urls, and urls without ://, have an empty host and path, fit no rule and get the method's verdict for
the empty host (allow). Null html has no links. Repeated rows are judged alike and count as pages each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.session import cut_lineage

#: The contract's rules: text of the rule, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING, ROUNDS, SETTLED, SHARE = 0.85, 30, 1e-6, 0.5
#: A reached host has at least the smallest rank a double holds; walks with less than NOTHING no longer count as a change.
_SMALLEST, NOTHING = 5e-324, 1e-300
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _CAPITALS, _SMALL)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, rule_host, rule_path, verdict; the path begins with the rule's first slash."""
    table = spark.createDataFrame(rules, "rule string, verdict string").dropDuplicates(["rule"])
    slash = F.instr("rule", "/")
    return table.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("rule_host"), F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("rule_path"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules of its suffixes: host, rules (longest first)."""
    parts = F.split("host", r"\.")
    suffixes = hosts.where("host <> ''").select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    fit = suffixes.join(rules, "rule_host").groupBy("host")
    # a host has few suffixes; what is listed are the rules of those
    return fit.agg(F.sort_array(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "rule_path", "verdict")), asc=False).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts with their number: src, dst, weight. pages: host, html. Only hosts are shuffled."""
    link = F.regexp_extract_all("html", F.lit(r"""(?i)<(?:a|area|link)\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.select(F.col("host").alias("src"), F.explode(link).alias("url"))
    dst = F.translate(F.regexp_extract("url", r"//([^/?#]*)", 1), _CAPITALS, _SMALL)
    return found.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def personalised_rank(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """host, rank: share of walks from the seeds (host) that end at the host, where a walk goes on with probability
    damping if there is a link to follow; hosts that no walk reaches are absent. A round adds the walks that are one link
    longer and is written to the checkpoint folder. It ends when a round reaches no new host and either adds less than
    settled of its rank to every host, or is the last of rounds rounds and of twice those that the farthest host took; this
    depends neither on the number of seeds nor on a longest path."""
    seeds = seeds.select("host").distinct()
    count = seeds.count()
    start = seeds.withColumn("rank", F.lit((1 - damping) / max(count, 1)))
    if not count or links.isEmpty():
        return start
    outward = links.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = cut_lineage(links.join(outward, "src").select("src", "dst", (damping * F.col("weight") / F.col("total")).alias("share")))
    state = cut_lineage(start.select("host", "rank", F.col("rank").alias("added"), F.lit(True).alias("fresh")))
    k = farthest = 0
    while True:
        k += 1
        onward = state.where("added IS NOT NULL").select(F.col("host").alias("src"), F.col("added").alias("walks"))
        moved = moves.join(onward, "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("walks") * F.col("share")).alias("more"))
        known = state.select("host", F.col("rank").alias("old"))
        fresh = F.col("old").isNull()
        added = F.when(fresh, F.greatest("more", F.lit(_SMALLEST))).otherwise(F.col("more"))
        state = cut_lineage(known.join(moved, "host", "full").select("host", (F.coalesce("old", F.lit(0.0)) + F.coalesce(added, F.lit(0.0))).alias("rank"), added.alias("added"), fresh.alias("fresh")))
        reached, change = state.where("added IS NOT NULL").agg(F.max("fresh"), F.max(F.when(F.col("added") > NOTHING, F.col("added") / F.col("rank")).otherwise(0.0))).first()
        if reached:
            farthest = k
        elif change is None or change < settled or k >= max(rounds, 2 * farthest):
            return state.select("host", "rank")


def host_scores(ruled: DataFrame, pages: DataFrame) -> DataFrame:
    """host, trust, distrust. ruled: host and rule verdict (or null) of each page; pages: host, html."""
    ruled = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"), F.count(F.lit(1)).alias("pages"))
    ruled = cut_lineage(ruled)
    links = cut_lineage(host_links(pages))
    trust = personalised_rank(links, ruled.where("allowed > 0 AND blocked = 0"))
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(against, ruled.where("blocked = pages"))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, share: float = SHARE) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict, trust and distrust of every row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    fit = cut_lineage(host_rules(split.select("host").distinct(), rule_table(spark, rules)))

    best = F.get(F.filter("rules", lambda r: F.startswith("path", r["rule_path"])), F.lit(0))
    ruled = split.join(fit, "host", "left").withColumn("best", best).drop("rules")
    scores = host_scores(ruled.select("host", F.col("best.verdict").alias("ruled")), pages.select(host.alias("host"), F.col("html").cast("string").alias("html")))
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= share * (F.col("trust") + F.col("distrust")))
    judged = ruled.join(scores, "host", "left")
    method = F.when(F.coalesce(bad, F.lit(False)), F.lit("block")).otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
