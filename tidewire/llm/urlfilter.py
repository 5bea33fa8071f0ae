"""URL filters: rules, then a path-template tree.

Rules decide where one fits. What they decide also labels urls; every other
url is judged by a tree of path templates grown per host, on counts only:

1. A segment that is a number, a date, a hexadecimal id or a very long token
   becomes a wildcard; urls are then counted by (host, template), which is all
   the tree ever sees.
2. Level by level, the children of a node become one wildcard when they are
   many and mostly seen once (they vary; they do not name a section).
3. A branch whose share of blocked labels does not differ from its parent's by
   ``z`` standard errors is merged with it and takes its statistics. A branch
   without labels has nothing to differ by and is merged as well, so what lies
   below it takes the statistics of its nearest labelled ancestor.
4. A template is rejected when its smoothed purity (blocked + a x prior) /
   (labelled + a) reaches ``purity``. prior is the share of blocked among all
   labels; a host without any label has the prior itself.

So a host where a rule blocks enough of the labelled urls is blocked whole,
but for branches whose labels say otherwise.

The tree has at most ``DEPTH`` levels; what lies deeper, and very long urls, go
to the node at that level. A host with a third of all urls is one key only
after counting; joins back to urls are on (host, template), which adaptive
execution splits.

Rows: a null url, or one without ``://``, has empty host and path and is judged
like any other (no rule fits an empty path). Of rules that fit, the longest
wins, of equally long ones the first in order. Repeated rows give equal
results. An empty table gives an empty result; without labels all is allowed.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stash, tidy

#: The query's rules, longest first: verdict, host, path.
RULES = (("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("block", "net", "/"), ("allow", "org", "/fr/"))
DEPTH = 6
#: A node's children vary when they are at least so many, with at most so many urls each on average.
MANY_CHILDREN, FEW_URLS = 12, 3.0
PURITY, STRENGTH, Z = 0.8, 2.0, 1.96
_VARIABLE = r"^(?:\d+(?:[-_.]\d+)*|[0-9a-f]{8,}|[0-9a-f-]{32,}|.{40,})(?:\.[a-z0-9]{1,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or end, A-Z lower-cased; then up to ? # or end."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def apply_rules(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    if rule is None or verdict is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def template(path: Column, depth: int = DEPTH) -> Column:
    """The first ``depth`` segments of a path, variable ones as ``*``."""
    parts = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth)
    return F.transform(parts, lambda s: F.when(F.lower(s).rlike(_VARIABLE), F.lit("*")).otherwise(s))


def grow(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """counts(host, t, n, blocked, labelled) with tree: the template after statistical wildcards."""
    tree = counts.withColumn("tree", F.col("t"))
    deepest = counts.agg(F.max(F.size("t"))).first()[0] or 0
    for level in range(1, min(depth, deepest) + 1):
        here = tree.where(F.size("tree") >= level)
        children = here.groupBy("host", F.slice("tree", 1, level - 1).alias("up"), F.element_at("tree", level).alias("seg")).agg(F.sum("n").alias("n"))
        varying = children.where("seg <> '*'").groupBy("host", "up").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where((F.col("k") >= MANY_CHILDREN) & (F.col("total") <= FEW_URLS * F.col("k")))
        varying = stash(varying.select(F.col("host").alias("_h"), F.col("up").alias("_u")), "varying")
        joined = tree.join(maybe_broadcast(varying), (F.col("host") == F.col("_h")) & (F.slice("tree", 1, level - 1) == F.col("_u")) & (F.size("tree") >= level), "left")
        wild = F.concat(F.slice("tree", 1, level - 1), F.array(F.lit("*")), F.slice("tree", level + 1, depth))
        tree = joined.select("host", "t", "n", "blocked", "labelled", F.when(F.col("_h").isNotNull(), wild).otherwise(F.col("tree")).alias("tree"))
        if level % 3 == 0:
            tree = stash(tree, "tree")
    return stash(tree, "tree")


def judge(tree: DataFrame, purity: float = PURITY, strength: float = STRENGTH, z: float = Z) -> DataFrame:
    """(host, t, rejected) for every counted template."""
    prior = tree.agg(F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1))).first()[0] or 0.0
    nodes = stash(
        tree.select("host", "blocked", "labelled", F.explode(F.sequence(F.lit(0), F.size("tree"))).alias("level"), "tree")
        .groupBy("host", F.slice("tree", F.lit(1), F.col("level")).alias("node"))
        .agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")),
        "nodes",
    )
    # top down: a branch keeps its own statistics only if it has some that differ from its parent's
    rate = nodes.where(F.size("node") == 0).select("host", "node", "b", "l")
    done = rate
    deepest = nodes.agg(F.max(F.size("node"))).first()[0] or 0
    for level in range(1, deepest + 1):
        up = rate.select(F.col("host").alias("_h"), F.col("node").alias("_u"), F.col("b").alias("pb"), F.col("l").alias("pl"))
        own = nodes.where(F.size("node") == level).join(up, (F.col("host") == F.col("_h")) & (F.slice("node", 1, level - 1) == F.col("_u")))
        p = F.col("pb") / F.greatest(F.col("pl"), F.lit(1))
        spread = F.sqrt(p * (1 - p) / F.greatest(F.col("l"), F.lit(1)) + F.lit(1e-9))
        like = (F.col("l") == 0) | (F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - p) <= z * spread)
        rate = stash(own.select("host", "node", F.when(like, F.col("pb")).otherwise(F.col("b")).alias("b"), F.when(like, F.col("pl")).otherwise(F.col("l")).alias("l")), "rate")
        done = done.unionByName(rate)
    smoothed = (F.col("b") + strength * prior) / (F.col("l") + strength)
    verdicts = stash(done.select(F.col("host").alias("_h"), F.col("node").alias("_n"), (smoothed >= purity).alias("rejected")), "verdicts")
    return stash(tree.join(verdicts, (F.col("host") == F.col("_h")) & (F.col("tree") == F.col("_n"))).select("host", "t", "rejected"), "rejected")


@tidy
def filter_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), template(F.col("path")).alias("t"))
    counts = stash(
        ruled.groupBy("host", "t").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count("by_rule").alias("labelled")),
        "counts",
    )
    found = judge(grow(counts)).where("rejected").select(F.col("host").alias("_h"), F.col("t").alias("_t"))
    found = maybe_broadcast(stash(found, "bad"))
    out = ruled.join(found, (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("_h").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
