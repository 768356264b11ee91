"""Repository map: personalised PageRank over definitions, and a budgeted listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeway.functions import constants as K
from lodeway.operators.traverse import fanout
from lodeway.sources.scratch import saver

ALPHA, HUB = 0.85, 10


def nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(file, name, type, line_start)`` of the definitions to rank, one of each (file, name)."""
    rows = entities.where(F.col("type").isin(K.MAP_TYPES))
    defined = relations.where("relation = 'defines' and from_name = file").select("file", F.col("to_name").alias("name")).distinct()
    rows = rows.join(defined, ["file", "name"], "left_semi")
    return rows.groupBy("file", "name").agg(F.max_by("type", "type").alias("type"), F.max_by("line_start", "type").alias("line_start"))


def edges(ranked: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: parallel references between nodes, each to the definition in its own file or else the first; hubs are skipped."""
    few = fanout(entities).where(F.col("files") < HUB).select("name")
    defs = ranked.groupBy("name").agg(F.collect_set("file").alias("def_files")).join(few, "name").withColumnRenamed("name", "to_name")
    own = ranked.select("file", F.col("name").alias("from_name"))
    # Dealt by what refers, once: the count and the first join keep that order.
    refs = relations.where(F.col("relation") != "defines").select("file", "from_name", "to_name").repartition("file", "from_name")
    refs = refs.groupBy("file", "from_name", "to_name").agg(F.count("*").alias("weight")).join(own, ["file", "from_name"]).join(defs, "to_name")
    def_file = F.when(F.array_contains("def_files", F.col("file")), F.col("file")).otherwise(F.array_min("def_files"))
    ends = [F.concat_ws("\n", "file", "from_name").alias("src"), F.concat_ws("\n", def_file, "to_name").alias("dst")]
    return refs.select(*ends, "weight").where("src != dst")


def pagerank(ranked: DataFrame, links: DataFrame, focus_files: list[str] = (), focus_names: list[str] = (), rounds: int = 100, tolerance: float = 1e-6, save=None) -> DataFrame:
    """``(node, score)``: PageRank that restarts at every node, at focus files 10 and focus names 50 times more often.

    ``save`` writes and rereads the state of a round, which cuts its lineage;
    rounds stop when scores move by less than ``tolerance`` a node.
    """
    save, written = save or saver(ranked.sparkSession), saver(ranked.sparkSession, keep=2)  # of the rounds only the last two stay
    bonus = F.lit(1.0)
    if focus_files:
        bonus = bonus + F.when(F.col("file").rlike("|".join(f"\\Q{f}\\E" for f in focus_files)), 10.0).otherwise(0.0)
    if focus_names:
        bonus = bonus + F.when(F.col("name").isin(list(focus_names)), 50.0).otherwise(0.0)
    base = ranked.select(F.concat_ws("\n", "file", "name").alias("node"), bonus.alias("p"))
    total = base.agg(F.sum("p").alias("t"), F.count("*").alias("n"))
    out = F.sum("weight").over(W.partitionBy("src"))
    shares = save(links.select("src", "dst", (F.col("weight") / out).alias("share")))  # written once, so that links are found once
    linked = shares.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    base = base.crossJoin(F.broadcast(total)).join(linked, "node", "left")
    base = base.select("node", (F.col("p") / F.col("t")).alias("p"), (1.0 / F.col("n")).alias("start"), F.col("out").isNull().alias("dangling"))
    base = save(base)
    now = base.select("node", "p", "dangling", F.col("start").alias("score"))
    n, lost = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("start"))), F.lit(0.0)).alias("lost")).first()
    for _ in range(rounds):
        moved = now.join(shares.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        score = ALPHA * (F.coalesce("in", F.lit(0.0)) + F.lit(float(lost)) * F.col("p")) + (1 - ALPHA) * F.col("p")
        new = now.join(moved, "node", "left").select("node", "p", "dangling", score.alias("score"), F.col("score").alias("was"))
        seen = Observation()  # what the next round needs is summed as this one is written
        new = new.observe(
            seen, F.coalesce(F.sum(F.abs(F.col("score") - F.col("was"))), F.lit(0.0)).alias("gap"),
            F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("lost"),
        )
        now, lost = written(new).drop("was"), seen.get["lost"]
        if seen.get["gap"] < n * tolerance:
            break
    return now.select("node", "score")


def budgeted(ranked: DataFrame, scores: DataFrame, tokens: int = 8000, chars_per_token: int = 4) -> DataFrame:
    """``(file, name, line, score)`` of the listing: the best first, skipping lines that do not fit, up to 95 % of the budget.

    A line costs at least three characters, so no more than a third of the
    budget's characters in rows is looked at on the driver.
    """
    budget = max(1000, tokens * chars_per_token)
    rows = ranked.withColumn("node", F.concat_ws("\n", "file", "name")).join(scores, "node")
    line = F.concat(F.col("type"), F.lit(" "), F.col("name"), F.coalesce(F.concat(F.lit(":"), F.col("line_start")), F.lit("")))
    rows = rows.select("file", "name", line.alias("line"), "score").orderBy(F.desc("score"), "file", "name").limit(budget // 3)
    used, kept = 0, []
    for r in rows.toLocalIterator():
        cost = len(r["line"]) + 2
        if used + cost <= budget:
            used += cost
            kept.append(tuple(r))
        if used >= 0.95 * budget:
            break
    return ranked.sparkSession.createDataFrame(kept, "file string, name string, line string, score double")


def in_degree(ranked: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, score)``: the weight of the references to each node, a plain ranking where none converges."""
    into = links.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").cast("double").alias("score"))
    base = ranked.select(F.concat_ws("\n", "file", "name").alias("node"))
    return base.join(into, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def by_file(listing: DataFrame) -> DataFrame:
    """``(file, best, lines)`` of a budgeted listing: files by their best score, lines by line number."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("line", r":(\d+)$", 1), F.lit("999999999")).cast("long"), F.lit(0))
    rows = listing.groupBy("file").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct(number.alias("at"), "line"))).alias("rows"))
    rows = rows.select("file", "best", F.array_join(F.transform("rows", lambda r: F.concat(F.lit("  "), r["line"])), "\n").alias("lines"))
    return rows.orderBy(F.desc("best"), "file")
