"""URL filters by link-graph propagation, in DataFrame operations only.

Rules decide the urls that they fit. For the others, trust flows along the
links between hosts by personalised PageRank from hosts that rules mostly
allow, and distrust flows against the links from hosts that rules mostly block;
a host is blocked when distrust is more than its share of both. Links are
aggregated to weighted host edges first, and every round is written to the
shared folder, its predecessor dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import Scratch, ascii_lower

#: (verdict, host, path beginning)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, CLOSE = 0.85, 1e-6
#: Rounds at most; the damping alone brings the change below CLOSE in about 90.
MOST_ROUNDS = 200
#: Share of distrust in trust and distrust from which a host is blocked.
THRESHOLD = 0.5
_HREF = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    rest = F.get(F.split(F.coalesce(url, F.lit("")), "://", 2), 1)
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.get(F.split(F.coalesce(url, F.lit("")), "://", 2), 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; null without one."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    out = none
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last, longest one is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` of the links between different hosts; ``pages`` has host and html."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1))
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(targets).alias("url"))
    absolute = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    links = links.select("src", host_of(absolute).alias("dst")).where("dst != '' and dst != src")
    return links.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagated(scratch: Scratch, nodes: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """``(host, score)`` by PageRank personalised to the column ``seed`` of ``nodes``; scores sum to 1.

    What hosts without links on would pass on returns to the seeds. Without
    seeds every score is 0. Rounds end when all scores together move by less than ``CLOSE``.
    """
    total = nodes.agg(F.sum(seed).alias("s")).first()["s"] or 0
    start = (F.col(seed) / F.lit(float(total)) if total else F.lit(0.0)).cast("double")
    seeds = scratch.save(nodes.select("host", start.alias("seed")))
    now = seeds.select("host", F.col("seed").alias("score"))
    if not total:
        return now
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = scratch.save(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    if shares.isEmpty():
        return now
    old = None
    for _ in range(MOST_ROUNDS):
        moved = shares.join(now.withColumnRenamed("host", "src"), "src").groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        moved = scratch.save(moved.withColumnRenamed("dst", "host"))
        passed = moved.agg(F.sum("in").alias("s")).first()["s"] or 0.0
        back = 1.0 - DAMPING * passed  # the jump, and what hosts without links held
        new = seeds.join(moved, "host", "left").select(
            "host", (F.lit(back) * F.col("seed") + DAMPING * F.coalesce("in", F.lit(0.0))).alias("score")
        )
        new = scratch.save(new)
        gap = new.join(now.withColumnRenamed("score", "was"), "host").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("g")).first()["g"]
        scratch.drop(moved)
        if old is not None:
            scratch.drop(old)
        now = old = new
        if gap < CLOSE:
            return now
    raise RuntimeError(f"scores still move by {gap} after {MOST_ROUNDS} rounds")


def judged(spark: SparkSession, pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages`` (page_id, url, html).

    Urls that no rule fits get the verdict of their host: ``block`` when
    distrust / (trust + distrust) is above ``threshold``, else ``allow``; hosts
    that neither reaches, and urls without host, are allowed. Null and empty
    urls have no host, null and empty pages no links. Repeated rows come
    back repeated, an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(spark, "urls")
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    ruled = scratch.save(rows.select("page_id", "host", "path", "found"))
    edges = scratch.save(host_edges(rows))
    verdict = F.col("found.verdict")
    hosts = ruled.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(verdict == "allow", 1)).alias("good"), F.count(F.when(verdict == "block", 1)).alias("bad")
    )
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host"))
    nodes = hosts.join(linked.distinct(), "host", "full").na.fill(0, ["n", "good", "bad"])
    nodes = scratch.save(
        nodes.select(
            "host", F.when(2 * F.col("good") > F.col("n"), F.col("good")).otherwise(0).alias("trusted"),
            F.when(2 * F.col("bad") > F.col("n"), F.col("bad")).otherwise(0).alias("blocked"),
        )
    )
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagated(scratch, nodes, edges, "trusted").withColumnRenamed("score", "trust")
    distrust = propagated(scratch, nodes, reverse, "blocked").withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host")
    out = ruled.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    own = F.when((F.col("distrust") > 0) & (share > threshold), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(verdict, own).alias("verdict"), "trust", "distrust")
