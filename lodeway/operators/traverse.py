"""Bounded traversal of the name graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeway.sources.scratch import saver


def fanout(entities: DataFrame) -> DataFrame:
    return entities.groupBy("name").agg(F.countDistinct("file").alias("files"))


def subgraph(entities: DataFrame, relations: DataFrame, start: str, depth: int = 2, cap: int = 50, hub: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(edges, nodes)`` around ``start``: ``(from_name, relation, to_name)`` and ``(name, hop, state)``.

    Names up to ``depth`` hops are expanded, at most ``cap`` relations each (in
    order of file, from, relation, to); past the first hop, names defined in
    ``hub`` files or more are not. The state is expanded, truncated or hub.
    The frontier's size is bounded by cap and depth, the rounds by depth.
    """
    spark = relations.sparkSession
    both = relations.select(F.col("from_name").alias("node"), F.col("to_name").alias("next"), "file", "from_name", "relation", "to_name")
    back = relations.where("from_name != to_name").select(F.col("to_name").alias("node"), F.col("from_name").alias("next"), "file", "from_name", "relation", "to_name")
    save = saver(spark)
    both = save(both.unionByName(back))
    spread = save(fanout(entities))
    frontier = spark.createDataFrame([(start,)], "node string")
    seen, edges, nodes = frontier, None, None
    order = W.partitionBy("node").orderBy("file", "from_name", "relation", "to_name")
    for hop in range(depth + 1):
        now = frontier.join(spread.withColumnRenamed("name", "node"), "node", "left").na.fill(0, ["files"])
        is_hub = (F.col("files") >= hub) if hop else F.lit(False)
        hubs = now.where(is_hub).select(F.col("node").alias("name"), F.lit(hop).alias("hop"), F.lit("hub").alias("state"))
        open_ = now.where(~is_hub).select("node")
        found = both.join(open_, "node").withColumn("rank", F.row_number().over(order)).withColumn("all", F.count("*").over(W.partitionBy("node")))
        found = save(found.where((F.col("rank") <= cap)))
        kept = found
        total = found.where("rank = 1").select("node", "all")
        state = F.when(F.coalesce("all", F.lit(0)) > cap, "truncated").otherwise("expanded")
        mine = open_.join(total, "node", "left").select(F.col("node").alias("name"), F.lit(hop).alias("hop"), state.alias("state"))
        rows = hubs.unionByName(mine)
        nodes = rows if nodes is None else nodes.unionByName(rows)
        new = kept.select("from_name", "relation", "to_name")
        edges = new if edges is None else edges.unionByName(new)
        frontier = kept.select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = save(frontier)
        seen = seen.unionByName(frontier)
    return edges.distinct(), nodes
